"""The benchmark tables as landed JSON: what an API would have sent for them.

Payloads are chunked by ranges of a unique key or by calendar spans, so each holds a bounded number of entries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight.operators.normalise import HORIZONS
from bourselight.sources.testbed import STATEMENT_FIELDS, BASIC_FIELDS
from workload.damage import damaged_prices, damaged_quotes

CHUNK = 100


def _landing(df: DataFrame, endpoint: Column | str, payload: Column, symbol: Column | str = "", **params) -> DataFrame:
    as_text = lambda v: v if isinstance(v, Column) else F.lit(v)
    pairs = [part for k, v in params.items() for part in (F.lit(k), as_text(v))]
    no_params = F.from_json(F.lit("{}"), "map<string,string>")
    return df.select(
        as_text(endpoint).alias("endpoint"),
        as_text(symbol).alias("symbol"),
        (F.create_map(*pairs) if pairs else no_params).alias("params"),
        payload.alias("payload"),
        F.lit("2024-01-01").cast("timestamp").alias("fetched_at"),
    )


def _path(call: str) -> Column:
    return F.concat(F.lit(f"/api/v1/{call}/"), F.col("symbol"))


def _listed(df: DataFrame, keys: list[str], item: Column, name: str) -> DataFrame:
    """The items of each group as a list.

    Rows are shuffled as they are, as lists would not shrink them, and the texts of an item are made behind the shuffle.
    """
    return df.repartition(*keys).select(*keys, item.alias("_item")).groupBy(*keys).agg(F.collect_list("_item").alias(name))


def symbols(t) -> DataFrame:
    """Symbol master in chunks; some symbols are blank and some names and codes are missing."""
    key, size = F.col("p_partkey"), F.col("p_size")
    item = F.struct(
        F.when(size == 50, "  ").otherwise(F.concat(F.lit(" "), key.cast("string"))).alias("symbol"),
        F.when(size % 4 != 0, F.col("p_name")).alias("name"),
        F.concat(F.lit("NSE"), key.cast("string")).alias("nse_code"),
        F.when(size % 3 == 0, (key + 500000).cast("string")).otherwise("").alias("bse_code"),
        (size % 2 == 0).alias("consolidated_ind"),
    )
    chunks = _listed(t.table("part").withColumn("_chunk", F.floor(key / CHUNK)), ["_chunk"], item, "items")
    return _landing(chunks, "/api/v1/stock-symbols", F.to_json("items"))


def profiles(t) -> DataFrame:
    body = F.to_json(
        F.struct(
            "name", "macro_sector",
            F.concat(F.lit(" "), F.col("sector"), F.lit(" ")).alias("sector"),
            "industry",
            F.coalesce("sub_industry", F.lit("  ")).alias("sub_industry"),
            F.lit("").alias("website"),
            F.concat(F.lit("About "), F.col("name")).alias("description"),
            F.when(F.col("market_cap").isNotNull(), F.format_number("market_cap", 2)).otherwise("N/A").alias("market_cap"),
        )
    )
    return _landing(t.company.join(t.quote, "symbol"), _path("company-profile"), body, F.col("symbol"))


def quotes(t) -> DataFrame:
    """Universe quote maps in chunks of symbols, with spoilt figures."""
    figures = F.struct(
        *[F.col(c).cast("string").alias(c) for c in ("current_price", "market_cap", "high52", "low52", "volume", "shares")],
        F.concat(F.col("change_pct").cast("string"), F.lit("%")).alias("change"),
        F.lit("15:30").alias("tradetime"),
    )
    chunk = F.floor(F.col("symbol").cast("bigint") / CHUNK)
    chunks = _listed(damaged_quotes(t).withColumn("_chunk", chunk), ["_chunk"], F.struct(F.col("symbol"), figures), "_entries")
    return _landing(chunks, "/api/v1/quote", F.to_json(F.map_from_entries("_entries")))


def _field_maps(fields: dict[str, dict[str, str]], *more: str) -> Column:
    """Periods as maps of texts, made after the grouping: what is shuffled are the figures of each period in `_rows`."""
    def made(of: dict[str, str]) -> str:
        pairs = ["'header', r.header", "'year', CAST(r.year AS STRING)", *[f"'{name}', r.{name}" for name in more]]
        for name, expression in of.items():
            figure = re.sub(r"\b([eqdt])\b", r"r.\1", expression)
            pairs.append(f"'{name}', CAST(CAST({figure} AS DOUBLE) AS STRING)")
        return f"transform(_rows, r -> map({', '.join(pairs)}))"

    return F.expr("CASE " + " ".join(f"WHEN statement_code = '{c}' THEN {made(of)}" for c, of in fields.items()) + " END")


def statements(t) -> DataFrame:
    """One payload per symbol, type, code and kind, with all its periods. Quarters come without a header."""
    keys = ["symbol", "statement_type", "statement_code", "period_kind"]
    header = F.when(F.col("period_kind") != "quarterly", F.col("header")).alias("header")
    end = F.date_format("period_end", "yyyyMMdd").alias("period_end")
    row = F.struct(header, "year", end, "e", "q", "d", "t")
    sent = _listed(t.statement_wide, keys, row, "_rows").withColumn("financials", _field_maps(STATEMENT_FIELDS, "period_end"))
    return _landing(
        sent, _path("financials"), F.to_json(F.struct("financials")), F.col("symbol"),
        statement_type=F.col("statement_type"), statement_code=F.col("statement_code"), period=F.col("period_kind"),
    )


def basics(t) -> DataFrame:
    keys = ["symbol", "statement_type", "statement_code"]
    yearly = t.statement_wide.where(F.col("period_kind") != "quarterly")
    row = F.struct("header", "year", "e", "q", "d", "t")
    sent = _listed(yearly, keys, row, "_rows").withColumn("ratios", _field_maps(BASIC_FIELDS))
    return _landing(
        sent, _path("basic-financials"), F.to_json(F.struct("ratios")), F.col("symbol"),
        statement_type=F.col("statement_type"), statement_code=F.col("statement_code"),
    )


def ratios(t) -> DataFrame:
    """Both groupings are by symbol, type and family at least, so one shuffle by these serves them."""
    keys = ["symbol", "statement_type", "family"]
    per_year = t.ratios.repartition(*keys).groupBy(*keys, "header", "year").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", F.col("value").cast("string")))).alias("figures")
    )
    tagged = F.map_concat(
        F.create_map(F.lit("header"), F.col("header"), F.lit("year"), F.col("year").cast("string")), F.col("figures")
    )
    sent = per_year.groupBy(*keys).agg(F.collect_list(tagged).alias("ratios"))
    return _landing(
        sent, _path("ratios"), F.to_json(F.struct("ratios")), F.col("symbol"),
        statement_type=F.col("statement_type"), ratio_type=F.col("family"),
    )


def metrics(t) -> DataFrame:
    """Point-in-time metrics; a missing one is sent as "NA"."""
    keys = ["symbol", "statement_type", "family"]
    figure = F.coalesce(F.col("value").cast("string"), F.lit("NA"))
    sent = _listed(t.metrics, keys, F.struct("field_name", figure.alias("value")), "_entries").withColumn(
        "financial_metrics", F.map_from_entries("_entries")
    )
    return _landing(
        sent, _path("financial-metrics"), F.to_json(F.struct("financial_metrics")), F.col("symbol"),
        statement_type=F.col("statement_type"), ratio_type=F.col("family"),
    )


def _valuations(t) -> DataFrame:
    """Daily valuation with a symbol's days in one partition; daily and annual payloads are both made from this one shuffle."""
    return t.price_ratios.repartition("symbol", "statement_type").withColumn("year", F.year("quote_date"))


def price_ratios_daily(t) -> DataFrame:
    keys = ["symbol", "statement_type", "year"]
    item = F.struct(
        F.date_format("quote_date", "yyyy-MM-dd").alias("quote_date"),
        *[F.col(c).cast("string").alias(c) for c in ("pe", "pb", "ptb", "ps", "pfcf")],
    )
    days = _valuations(t).select(*keys, item.alias("_item"))
    sent = days.groupBy(*keys).agg(F.collect_list("_item").alias("price_ratios"))
    return _landing(
        sent, _path("daily-price-ratios"), F.to_json(F.struct("price_ratios")), F.col("symbol"),
        statement_type=F.col("statement_type"),
    )


def price_ratios_annual(t) -> DataFrame:
    """Yearly valuation; a P/E that is not known is sent as 0."""
    keys = ["symbol", "statement_type"]
    yearly = _valuations(t).groupBy(*keys, "year").agg(
        F.max("ps").alias("average_price"), F.coalesce(F.max("pe"), F.lit(0.0)).alias("pe"), F.max("pb").alias("pb"),
        F.max("ptb").alias("ptb"), F.lit(0.0).alias("ps"), F.max("pfcf").alias("pfcf"),
    )
    item = F.struct(
        F.concat(F.lit("Mar "), F.col("year").cast("string")).alias("header"),
        *[F.col(c) for c in ("year", "average_price", "pe", "pb", "ptb", "ps", "pfcf")],
    )
    sent = yearly.groupBy(*keys).agg(F.collect_list(item).alias("price_ratios"))
    return _landing(
        sent, _path("annual-price-ratios"), F.to_json(F.struct("price_ratios")), F.col("symbol"),
        statement_type=F.col("statement_type"),
    )


def prices(t, parts: int | None = None) -> DataFrame:
    """Daily quotes per symbol and month, with sessions without trading and negative prices among them.

    With `parts` a symbol's payloads lie in one of so many partitions, which costs no shuffle of the payloads.
    """
    shown = ("open", "high", "low", "close")
    keys, quotes = ["symbol", "_month"], damaged_prices(t).withColumn("_month", F.trunc("quote_date", "month"))
    item = F.struct(
        F.date_format("quote_date", "yyyy-MM-dd HH:mm:ss").alias("quote_date"),
        *[F.col(c).alias(f"{c}_price") for c in shown], "volume",
    )
    days = quotes.repartition(*keys) if parts is None else quotes.repartition(parts, "symbol")
    sent = days.select(*keys, item.alias("_item")).groupBy(*keys).agg(F.collect_list("_item").alias("price"))
    return _landing(sent, _path("daily-quotes"), F.to_json(F.struct("price")), F.col("symbol"))


def _order_chunk() -> Column:
    return F.floor(F.col("subject").cast("bigint") / CHUNK)


def dividends(t) -> DataFrame:
    item = F.struct(
        F.date_format("ex_date", "d-MMM-yyyy").alias("date"), "amount", F.col("subject").alias("dividend_type")
    )
    paid = t.actions.where(F.col("action") == "dividend")
    sent = _listed(paid.withColumn("_chunk", _order_chunk()), ["symbol", "_chunk"], item, "dividend")
    return _landing(sent, _path("dividend"), F.to_json(F.struct("dividend")), F.col("symbol"))


def corporate_actions(t) -> DataFrame:
    item = F.struct(F.date_format("ex_date", "yyyyMMdd").alias("date"), F.col("subject").alias("action"), "amount")
    other = t.actions.where(F.col("action") != "dividend")
    sent = _listed(other.withColumn("_chunk", _order_chunk()), ["symbol", "action", "_chunk"], item, "items")
    path = F.concat(F.lit("/api/v1/corporate-actions/"), F.col("action"), F.lit("/"), F.col("symbol"))
    return _landing(sent, path, F.to_json(F.create_map("action", "items")), F.col("symbol"))


def shareholding(t) -> DataFrame:
    data = F.struct(
        F.col("shareholding_pct").alias("shareholdingPct"),
        F.col("total_shareholders").alias("totalShareholders"),
        F.col("pledged_pct").alias("pledgedSharesPct"),
    )
    group = F.struct(F.col("group_name").alias("group"), data.alias("data"))
    quarter = F.struct(F.col("period_label").alias("date_header"), F.collect_list(group).alias("distributions"))
    sent = t.shareholding.groupBy("symbol", "period_label").agg(quarter.alias("q"))
    return _landing(
        sent, _path("shareholdings/distribution"), F.to_json(F.struct(F.array("q").alias("distributions"))),
        F.col("symbol"),
    )


def index_master(t) -> DataFrame:
    """Index master with constituents, an index's list being sent in parts of at most 100 keys."""
    chunk = F.floor(F.col("symbol").cast("bigint") / CHUNK)
    keys = ["index_symbol", "_chunk"]
    listed = t.constituents.withColumn("_chunk", chunk).repartition(*keys).groupBy(*keys).agg(
        F.collect_set("symbol").alias("constituents")
    )
    item = F.struct(
        "index_symbol", "index_name", "exchange", "index_type", "index_sub_type",
        F.when(F.col("index_type") == "broad", 0.0).otherwise(F.col("market_cap")).alias("market_cap"), "constituents",
    )
    return _landing(listed.join(t.index_master, "index_symbol"), "/api/v1/index/master/all", F.to_json(F.array(item)))


def index_quotes(t) -> DataFrame:
    """One payload per day with the quotes of all indices."""
    figures = ("close_price", "change_pct", "pe", "pb", "div_yield", "market_cap")
    item = F.struct(
        "index_symbol", F.date_format("quote_date", "yyyy-MM-dd").alias("quote_date"),
        *[F.col(c).cast("string").alias(c) for c in figures],
    )
    sent = t.index_quotes.groupBy("quote_date").agg(F.collect_list(item).alias("items"))
    return _landing(sent, "/api/v1/index/quote/all", F.to_json("items"))


def index_returns(t) -> DataFrame:
    """One payload per index; horizons without history are sent as 0."""
    horizons = HORIZONS
    wide = t.index_returns.groupBy("index_symbol").pivot("horizon", list(horizons)).agg(F.max("return_pct"))
    item = F.struct(
        "index_symbol", *[F.coalesce(F.col(h), F.lit(0.0)).alias(h) for h in horizons],
        F.struct(F.lit("2001-11-04").alias("last_date")).alias("dates"),
    )
    return _landing(wide, "/api/v1/index/price-returns", F.to_json(F.array(item)))


def holidays(t) -> DataFrame:
    """A call without a normaliser: archived only."""
    return _landing(t.table("region"), "/api/v1/holidays-calendar", F.to_json(F.struct("r_name")))


# Every call, with one that has no normaliser.
ALL = (
    symbols, profiles, quotes, statements, basics, ratios, metrics, price_ratios_daily, price_ratios_annual, prices, dividends,
    corporate_actions, shareholding, index_master, index_quotes, index_returns, holidays,
)
