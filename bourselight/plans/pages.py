"""Company and index pages as frames over the whole universe; one page is the same frame with a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselight.functions.figures import range_position
from bourselight.operators.normalise import HORIZONS
from bourselight.operators.spread import exact_medians, lookup, numbered, top_n
from bourselight.plans.screen import KEY_RATIO_COLUMNS

# Indices that readers know, in display order.
WELL_KNOWN = (
    "NIF50", "NIFTY50", "SENSEX", "BSESN", "NIF100", "NIF200", "NIF500", "BSE100", "BSE200", "BSE500",
    "NIFTYNEXT50", "NIFMIDCAP100", "NIFSMLCAP100", "NIFBANK", "NIFTYIT", "SNSXLRGCAP",
)

# Broad indices whose members are downloaded first.
PRIORITY_INDICES = ("NIF50", "NIFTY50", "SNSXLRGCAP", "NIF100", "NIF500", "BSE500", "BSE100", "BSE200")

PEER_MEDIANS = ("pe", "market_cap", "dividend_yield", "returnonequity", "returnoncapital")
PEER_COLUMNS = (
    "name", "current_price", "pe", "market_cap", "dividend_yield", "net_profit", "sales", "returnoncapital",
    "returnonequity",
)
INDEX_MEDIANS = ("pe", "pb", "dividend_yield", "returnonequity")
POSITIVE_ONLY = ("pe", "pb")
MEMBER_COLUMNS = (
    "current_price", "market_cap", "pe", "pb", "dividend_yield", "returnonequity", "returnoncapital",
    "net_profit", "sales", "change_pct",
)


def zero_last(column: str) -> Column:
    """Descending, with a missing figure counted as zero."""
    return F.coalesce(F.col(column), F.lit(0.0)).desc()


# --- companies ------------------------------------------------------------------------------------------------


def search_rank(symbol: Column, name: Column, term: str) -> Column:
    """0 for the exact symbol, 1 and 2 for a symbol or name prefix, 3 for a match anywhere, NULL for none."""
    needle = term.strip().upper()
    s, n = F.upper(symbol), F.upper(name)
    return (
        F.when(s == needle, 0)
        .when(s.startswith(needle), 1)
        .when(n.startswith(needle), 2)
        .when(s.contains(needle) | n.contains(needle), 3)
    )


def search(company: DataFrame, quote: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Companies that match a term, best rank first, larger companies first within a rank."""
    found = company.select("symbol", "name", "sector").withColumn(
        "rank", search_rank(F.col("symbol"), F.col("name"), term) if term.strip() else F.lit(None).cast("int")
    )
    hits = found.where(F.col("rank").isNotNull())
    priced = hits.join(quote.select("symbol", "current_price", "market_cap"), "symbol", "left")
    return priced.orderBy("rank", zero_last("market_cap"), "symbol").limit(limit)


def company_indices(constituents: DataFrame, index_master: DataFrame) -> DataFrame:
    """Index memberships per company, largest index first. An edge is unique, so a company has at most one row
    per index."""
    edges = constituents.select("symbol", "index_symbol").distinct()
    named = lookup(edges, index_master.select("index_symbol", "index_name", "market_cap"),
                   ["index_symbol"], ["symbol"], how="inner")
    place = W.partitionBy("symbol").orderBy(F.col("market_cap").desc_nulls_last(), F.col("index_symbol"))
    return named.select("symbol", "index_symbol", "index_name", F.row_number().over(place).alias("position"))


def profiles(
    company: DataFrame, quote: DataFrame, snapshot: DataFrame, constituents: DataFrame, index_master: DataFrame
) -> DataFrame:
    """Identity, quote, key ratios and the names of a company's indices, one row per company."""
    places = company_indices(constituents, index_master)
    listed = places.groupBy("symbol").agg(
        F.count("*").alias("index_count"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "index_name"))), lambda s: s["index_name"]),
            "|",
        ).alias("indices"),
    )
    identity = company.select(
        "symbol", "name", "nse_code", "bse_code", "macro_sector", "industry", "sector", "sub_industry"
    )
    priced = identity.join(quote.drop("name"), "symbol", "left")
    ratios = snapshot.select("symbol", *KEY_RATIO_COLUMNS)
    joined = priced.join(ratios, "symbol", "left").join(listed, "symbol", "left")
    return joined.withColumn("index_count", F.coalesce("index_count", F.lit(0)))


def peer_group() -> Column:
    return F.coalesce("sub_industry", "sector", "industry")


def grouped_companies(snapshot: DataFrame, company: DataFrame) -> DataFrame:
    """Snapshot figures with the peer group of the company."""
    groups = company.select("symbol", peer_group().alias("peer_group"))
    return snapshot.select("symbol", *PEER_COLUMNS).join(groups, "symbol")


def peer_sets(snapshot: DataFrame, company: DataFrame, limit: int = 10) -> DataFrame:
    """The largest companies of every peer group."""
    grouped = grouped_companies(snapshot, company).where(F.col("peer_group").isNotNull())
    return top_n(grouped, ["peer_group"], [zero_last("market_cap"), F.col("symbol")], limit)


def peer_medians(peers: DataFrame) -> DataFrame:
    """Medians over the limited peer set, the multiple over profitable peers only."""
    return exact_medians(
        peers,
        ["peer_group"],
        {c: F.when(F.col(c) > 0, F.col(c)) if c == "pe" else F.col(c) for c in PEER_MEDIANS},
    )


def company_peers(snapshot: DataFrame, company: DataFrame, limit: int = 10) -> DataFrame:
    """Per company its peer group, the number of peers shown and their medians.

    The peer rows themselves depend on the group alone and are in `peer_sets`.
    """
    peers = peer_sets(snapshot, company, limit)
    summary = peers.groupBy("peer_group").agg(F.count("*").alias("peer_count")).join(
        peer_medians(peers), "peer_group"
    )
    own = company.select("symbol", peer_group().alias("peer_group"))
    return lookup(own, summary, ["peer_group"], ["symbol"]).withColumn(
        "peer_count", F.coalesce("peer_count", F.lit(0))
    )


def recent_prices(prices: DataFrame, limit: int = 2000) -> DataFrame:
    """The last sessions per symbol, with their place counted from the newest."""
    return top_n(prices, ["symbol"], [F.col("quote_date").desc()], limit, spread=["quote_date"])


def action_lists(actions: DataFrame) -> DataFrame:
    """Corporate actions per symbol and kind, newest first, as numbered rows.

    A list of all actions of a hot symbol would be one unbounded row, so the list is kept as rows with positions.
    """
    newest_day = -F.unix_date("ex_date")
    return numbered(
        actions, ["symbol", "action"], newest_day, [F.col("ex_date").desc(), F.col("subject")]
    )


def largest(company: DataFrame, quote: DataFrame, limit: int = 50) -> DataFrame:
    """The largest companies with the number of all companies."""
    joined = company.select("symbol", "name").join(quote.select("symbol", "market_cap"), "symbol")
    top = joined.orderBy(F.col("market_cap").desc_nulls_last(), "symbol").limit(limit)
    return top.withColumn("total", company.agg(F.count("*")).scalar())


def range_positions(quote: DataFrame) -> DataFrame:
    return quote.select("symbol", range_position("current_price", "low52", "high52").alias("position_52w"))


def download_order(company: DataFrame, constituents: DataFrame, quote: DataFrame) -> DataFrame:
    """Companies in download order: members of broad indices, of any index, of none; larger ones first."""
    flags = constituents.groupBy("symbol").agg(
        F.min(F.when(F.col("index_symbol").isin(*PRIORITY_INDICES), 0).otherwise(1)).alias("tier")
    )
    caps = quote.select("symbol", F.coalesce("market_cap", F.lit(0.0)).alias("cap"))
    return company.select("symbol").join(flags, "symbol", "left").join(caps, "symbol", "left").select(
        "symbol", F.coalesce("tier", F.lit(2)).alias("tier"), F.coalesce("cap", F.lit(0.0)).alias("cap")
    )


def trends(series: DataFrame, keys: list[str], period: str, value: str = "value") -> DataFrame:
    """First, last, lowest and highest figure of a series, whether it rises and whether it crosses zero.

    Series under three points say nothing about a direction and are left out.
    """
    present = series.where(F.col(value).isNotNull())
    out = present.groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.min_by(value, period).alias("first"),
        F.max_by(value, period).alias("last"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ).where(F.col("points") >= 3)
    return out.withColumns(
        {"rising": F.col("last") >= F.col("first"), "crosses_zero": (F.col("low") < 0) & (F.col("high") > 0)}
    )


# --- indices --------------------------------------------------------------------------------------------------


def well_known_rank(index_symbol: Column) -> Column:
    """Place among the well-known indices from 1, or one past the end."""
    place = F.array_position(F.array(*[F.lit(s) for s in WELL_KNOWN]), index_symbol)
    return F.when(place > 0, place).otherwise(len(WELL_KNOWN) + 1).cast("int")


def latest_index_quotes(index_quotes: DataFrame) -> DataFrame:
    """The newest valuation per index."""
    return newest_quotes(index_quotes, ["close_price", "change_pct", "pe", "pb", "div_yield"])


def newest_quotes(index_quotes: DataFrame, picked: list[str]) -> DataFrame:
    day = F.unix_date("quote_date")
    return index_quotes.groupBy("index_symbol").agg(*[F.max_by(c, day).alias(c) for c in picked])


def returns_by_horizon(index_returns: DataFrame, horizons=HORIZONS) -> DataFrame:
    pivot = index_returns.groupBy("index_symbol").pivot("horizon", list(horizons)).agg(F.max("return_pct"))
    return pivot.withColumnsRenamed({h: f"return_{h.lower()}" for h in horizons})


def listing(
    index_master: DataFrame,
    constituents: DataFrame,
    index_quotes: DataFrame,
    index_returns: DataFrame,
    index_type: str | None = None,
) -> DataFrame:
    """Every index with constituent count, newest quote and returns; `place` gives the display order."""
    chosen = index_master if index_type is None else index_master.where(F.col("index_type") == index_type)
    counts = constituents.groupBy("index_symbol").agg(F.count("*").alias("constituents"))
    joined = (
        chosen.join(counts, "index_symbol", "left")
        .join(latest_index_quotes(index_quotes), "index_symbol", "left")
        .join(returns_by_horizon(index_returns), "index_symbol", "left")
    )
    return joined.withColumn("constituents", F.coalesce("constituents", F.lit(0))).withColumn(
        "place", well_known_rank(F.col("index_symbol"))
    )


def listed_in_order(rows: DataFrame, limit: int = 300) -> DataFrame:
    """The first rows in display order, beside the number of all."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy("place", "index_name", "index_symbol").limit(limit).withColumn("total", total)


def filter_indices(index_master: DataFrame, exchange: str | None = None, term: str = "") -> DataFrame:
    """Indices of an exchange whose name or symbol contains the term, whatever the case."""
    needle = term.strip().lower()
    out = index_master if exchange is None else index_master.where(F.col("exchange") == exchange)
    if needle:
        out = out.where(F.lower("index_name").contains(needle) | F.lower("index_symbol").contains(needle))
    return out


def index_buckets(index_master: DataFrame) -> DataFrame:
    """Number of indices per sub-type, "Other" where it is blank."""
    bucket = F.coalesce(F.nullif(F.col("index_sub_type"), F.lit("")), F.lit("Other"))
    return index_master.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("indices"), F.min("index_symbol").alias("first_index")
    )


def index_members(constituents: DataFrame, snapshot: DataFrame, company: DataFrame) -> DataFrame:
    """Every constituent with its snapshot figures and whether it belongs to the universe.

    Members outside the universe (trusts, small listings) stay: they are genuine constituents.
    """
    known = snapshot.select("symbol", F.col("name").alias("_snapshot_name"), *MEMBER_COLUMNS)
    identity = company.select("symbol", F.col("name").alias("_company_name"), "sector", F.lit(True).alias("_known"))
    facts = identity.join(known, "symbol", "full_outer")
    edges = constituents.select("index_symbol", "symbol")
    # An edge is unique, so a symbol has at most one row per index: no key is hot.
    joined = edges.join(facts, "symbol", "left")
    return joined.select(
        "index_symbol",
        "symbol",
        F.coalesce("_snapshot_name", "_company_name").alias("name"),
        F.coalesce("_known", F.lit(False)).alias("in_universe"),
        *MEMBER_COLUMNS,
        "sector",
    )


def index_coverage(members: DataFrame) -> DataFrame:
    """Members, members with fundamentals, members outside the universe."""
    return members.groupBy("index_symbol").agg(
        F.count("*").alias("count"),
        F.count_if(F.col("net_profit").isNotNull()).alias("with_fundamentals"),
        F.count_if(~F.col("in_universe")).alias("outside_universe"),
    )


def index_medians(members: DataFrame) -> DataFrame:
    """Medians over members with a net profit; multiples over positive ones only."""
    def measure(column: str) -> Column:
        usable = F.col("net_profit").isNotNull()
        if column in POSITIVE_ONLY:
            usable = usable & (F.col(column) > 0)
        return F.when(usable, F.col(column))

    return exact_medians(members, ["index_symbol"], {c: measure(c) for c in INDEX_MEDIANS})


def index_details(
    index_master: DataFrame,
    constituents: DataFrame,
    index_quotes: DataFrame,
    index_returns: DataFrame,
    snapshot: DataFrame,
    company: DataFrame,
) -> DataFrame:
    """Per index its quote, returns, coverage and medians; the constituents are in `index_members`."""
    members = index_members(constituents, snapshot, company)
    out = index_master
    for part in (
        latest_index_quotes(index_quotes),
        returns_by_horizon(index_returns),
        index_coverage(members),
        index_medians(members),
    ):
        out = out.join(part, "index_symbol", "left")
    return out.fillna(0, ["count", "with_fundamentals", "outside_universe"])


def movers(index_quotes: DataFrame, index_master: DataFrame, limit: int = 10) -> DataFrame:
    """Best and worst indices by the change of their newest quote; `position` counts from the most extreme.

    An index whose newest quote has no change is left out.
    """
    moved = newest_quotes(index_quotes, ["close_price", "change_pct"]).where(F.col("change_pct").isNotNull())
    tie = [F.col("index_symbol")]
    sides = []
    for side, first in (("gainer", F.col("change_pct").desc()), ("loser", F.col("change_pct").asc())):
        top = moved.orderBy(first, *tie).limit(limit)
        place = F.row_number().over(W.partitionBy("side").orderBy(first, *tie))
        sides.append(top.withColumn("side", F.lit(side)).withColumn("position", place))
    both = sides[0].unionByName(sides[1])
    return both.join(index_master.select("index_symbol", "index_name"), "index_symbol").select(
        "side", "position", "index_symbol", "index_name", "close_price", "change_pct"
    )


def members_in_order(members: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """Constituents by any column, missing figures last in both directions."""
    key = F.col(column)
    return members.orderBy(
        "index_symbol", key.asc_nulls_last() if ascending else key.desc_nulls_last(), "symbol"
    )


def return_shares(index_returns: DataFrame) -> DataFrame:
    """Each return as a share of the index's largest absolute return, which counts as at least 1."""
    peaks = index_returns.groupBy("index_symbol").agg(
        F.greatest(F.max(F.abs("return_pct")), F.lit(1.0)).alias("peak")
    )
    joined = lookup(index_returns, peaks, ["index_symbol"], ["horizon"], how="inner")
    return joined.select(
        "index_symbol", "horizon", "return_pct",
        (F.abs("return_pct") / F.col("peak")).alias("share"),
        (F.col("return_pct") < 0).alias("negative"),
    )
