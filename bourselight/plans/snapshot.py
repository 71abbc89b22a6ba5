"""The wide company snapshot: one row per company with every catalog column.

Each source becomes one row per symbol by an aggregate that combines before its shuffle, and all are joined on
symbol. Nothing is collected, and no price or statement row takes part in a join with the companies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight import catalog
from bourselight.functions import figures
from bourselight.operators import latest

INDEX = catalog.resolve("Index").key
HOLDINGS = ("promoter_holding", "promoter_pledge", "public_holding")


def _pick(entry: catalog.CatalogColumn, group: str) -> Column:
    """The best-ranked figure of a catalog column; of several fields the first present one, scaled.

    Written as SQL text made from the catalog: one parsed expression instead of a dozen calls per column.
    """
    candidates = [
        f"max_by(value, CASE WHEN {group} = '{entry.group}' AND field_name = '{field}' THEN rank END)"
        for field in entry.fields
    ]
    return F.expr(f"coalesce({', '.join(candidates)}) * CAST({entry.scale!r} AS DOUBLE) AS {entry.key}")


def _wide(long: DataFrame, source: str, group: str, rank: Column) -> DataFrame:
    """One row per symbol from a long source, reading only the fields that the catalog names."""
    entries = catalog.of_source(source)
    fields = sorted({f for e in entries for f in e.fields})
    wanted = long.where(F.col("field_name").isin(*fields) & F.col("value").isNotNull())
    return wanted.withColumn("rank", rank).groupBy("symbol").agg(*[_pick(e, group) for e in entries])


def scaled_figures(long: DataFrame, source: str, group: str) -> DataFrame:
    """Long figures with the catalog column they feed and their value in its unit, as (..., key, unit, scaled).

    Fields that no catalog column of the source and group names are left out.
    """
    entries = [
        F.struct(
            F.lit(e.group).alias("g"), F.lit(f).alias("f"), F.lit(e.key).alias("key"), F.lit(e.unit).alias("unit"),
            F.lit(float(e.scale)).alias("scale"),
        )
        for e in catalog.of_source(source) for f in e.fields
    ]
    fed = F.filter(F.array(*entries), lambda e: (e["g"] == F.col(group)) & (e["f"] == F.col("field_name")))
    return long.withColumn("_to", F.explode(fed)).select(
        *long.columns, "_to.key", "_to.unit", (F.col("value") * F.col("_to.scale")).alias("scaled")
    )


def statement_columns(lines: DataFrame) -> DataFrame:
    return _wide(latest.usable_statement_lines(lines), "statement", "statement_code", F.col("rank"))


def basic_columns(basics: DataFrame) -> DataFrame:
    return _wide(basics, "basic", "statement_code", latest.series_rank())


def ratio_columns(ratios: DataFrame) -> DataFrame:
    return _wide(ratios, "ratio", "family", latest.series_rank())


def metric_columns(metrics: DataFrame) -> DataFrame:
    return _wide(metrics, "metric", "family", F.when(F.col("statement_type") == "c", 1).otherwise(0))


def _direct(df: DataFrame, source: str) -> DataFrame:
    """Catalog columns copied from the company or quote table."""
    present = set(df.columns)
    copied = [e for e in catalog.of_source(source) if e.fields[0] in present]
    return df.selectExpr("symbol", *[f"CAST({e.fields[0]} AS {e.spark_type}) AS {e.key}" for e in copied])


def computed_columns(df: DataFrame) -> DataFrame:
    """Yields, enterprise value and its multiple, distance from the year's extremes, cash conversion."""
    with_ev = df.withColumn(
        "enterprise_value", figures.enterprise_value("market_cap", "total_debt", "total_cash")
    )
    return with_ev.withColumns(
        {
            "dividend_yield": figures.dividend_yield("dividend", "current_price"),
            "ev_ebitda": figures.ev_to_ebitda("enterprise_value", "ebitda"),
            "earnings_yield": figures.earnings_yield("pe"),
            "down_from_52w_high": figures.down_from_high("current_price", "high52"),
            "up_from_52w_low": figures.up_from_low("current_price", "low52"),
            "cfo_to_pat": figures.cash_to_profit("cfo", "net_profit"),
        }
    )


def build(
    *,
    company: DataFrame,
    quote: DataFrame,
    lines: DataFrame,
    basics: DataFrame,
    ratios: DataFrame,
    metrics: DataFrame,
    prices: DataFrame,
    price_ratios: DataFrame,
    shareholding: DataFrame,
    actions: DataFrame,
    as_of: Column,
) -> DataFrame:
    """The snapshot in catalog order, without a timestamp so that equal inputs give equal rows."""
    sources = [
        _direct(quote, "quote"),
        statement_columns(lines),
        basic_columns(basics),
        ratio_columns(ratios),
        metric_columns(metrics),
        latest.annualised_returns(prices),
        latest.moving_figures(prices),
        latest.latest_valuation(price_ratios),
        latest.latest_shareholding(shareholding),
        latest.trailing_dividends(actions, as_of),
    ]
    joined = _direct(company, "company")
    for source in sources:
        joined = joined.join(source, "symbol", "left")
    # Puts the columns in order, adds those no source carries as NULL, and attaches labels and units.
    return computed_columns(joined).to(catalog.snapshot_schema())


def memberships(constituents: DataFrame, company: DataFrame) -> DataFrame:
    """Membership edges of known companies."""
    known = company.select("symbol").distinct()
    return constituents.select("symbol", "index_symbol").distinct().join(known, "symbol", "left_semi")


def with_indices(snapshot: DataFrame, links: DataFrame) -> DataFrame:
    """The snapshot with the sorted index symbols of each company in the catalog's `index` column.

    A company of no index has an empty array, never NULL, so a membership test is true or false and nothing else. Arrays
    are as long as there are indices at most. Stored with the snapshot, they make membership a predicate like any other.
    """
    lists = links.groupBy("symbol").agg(F.sort_array(F.collect_set("index_symbol")).alias(INDEX))
    joined = snapshot.drop(INDEX).join(lists, "symbol", "left")
    return joined.withColumn(INDEX, F.coalesce(INDEX, F.array().cast("array<string>")))


def snapshot_counts(snapshot: DataFrame, links: DataFrame) -> DataFrame:
    """Companies, companies with fundamentals, membership links and stored columns, as one row."""
    populated = F.col("net_profit").isNotNull() | F.col("sales").isNotNull()
    counts = snapshot.agg(
        F.count("*").alias("companies"), F.count_if(populated).alias("with_fundamentals")
    )
    return counts.select(
        "*",
        links.agg(F.count("*")).scalar().alias("index_links"),
        F.lit(len(catalog.stored())).cast("bigint").alias("columns"),
    )


