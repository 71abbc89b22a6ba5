"""Landed JSON to Layer 2 rows. Payload fields are read as text, then cleaned by the shared parsing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight.functions.parse import (
    clean_text,
    header_or_period_end,
    parse_date,
    parse_number,
    parse_percent,
    positive_or_null,
    to_int,
    zero_to_null,
)
from bourselight.operators.classify import classify

# Fixed values.
HORIZONS = ("1M", "3M", "6M", "1Y", "3Y", "5Y", "7Y", "10Y")
PERIOD_FIELDS = ("header", "period_start", "period_end", "result_date", "year")
VALUATION = ("pe", "pb", "ptb", "ps", "pfcf")
QUOTE_SIZES = ("high52", "low52", "market_cap", "shares")


def _texts(*names: str) -> str:
    return ", ".join(f"`{n}`: string" for n in names)


def _exploded(df: DataFrame, kept: list, nested: Column, *names: str) -> DataFrame:
    """One row per element of an array or entry of a map.

    An inner explode lets the optimizer test the nested value in a filter below, which would parse every payload
    again. The outer form with a test of its result parses each payload once.
    """
    out = df.select(*kept, F.explode_outer(nested).alias(*names))
    return out.where(F.col(names[0]).isNotNull())


def _cleaned(rows: DataFrame, *columns) -> DataFrame:
    """Cleaned columns that later filters and joins do not compute again.

    The optimizer moves a filter on computed columns below them, where it repeats the parsing. It cannot move one
    below a generator, so the columns pass through an inline of one struct.
    """
    return rows.select(F.inline(F.array(F.struct(*columns))))


def _items(landing: DataFrame, element: str, container: str | None = None) -> DataFrame:
    """One row per element of the payload's array, with the element's fields as columns."""
    array = f"array<struct<{element}>>"
    if container:
        parsed = F.from_json("payload", f"struct<`{container}`: {array}>")[container]
    else:
        parsed = F.from_json("payload", array)
    return _exploded(landing, [c for c in landing.columns if c != "payload"], parsed, "item")


def _param(name: str) -> Column:
    return F.try_element_at("params", F.lit(name))


def _item(name: str) -> Column:
    return F.col("item").getField(name)


def _numbers(names) -> list[Column]:
    return [parse_number(_item(n)).alias(n) for n in names]


def symbols(landing: DataFrame) -> DataFrame:
    """Symbol master to companies: blank symbols go, blank codes are NULL, a missing name is the symbol."""
    items = _items(landing, _texts("symbol", "name", "nse_code", "bse_code", "consolidated_ind"))
    symbol = clean_text(_item("symbol"))
    return _cleaned(
        items,
        symbol.alias("symbol"),
        F.trim(F.coalesce(F.nullif(_item("name"), F.lit("")), symbol)).alias("name"),
        F.nullif(_item("nse_code"), F.lit("")).alias("nse_code"),
        F.nullif(_item("bse_code"), F.lit("")).alias("bse_code"),
        F.coalesce(_item("consolidated_ind").isin("true", "1"), F.lit(False)).alias("consolidated_ind"),
    ).where(F.col("symbol").isNotNull())


def profiles(landing: DataFrame) -> DataFrame:
    """Company profile to classification: the sent labels beside the cleaned ones."""
    levels = ("macro_sector", "sector", "industry", "sub_industry")
    fields = _texts(*levels, "website", "description", "market_cap", "name")
    p = landing.select("symbol", F.from_json("payload", f"struct<{fields}>").alias("item"))
    return p.where(F.col("item").isNotNull()).select(
        "symbol",
        *[_item(level).alias(f"{level}_raw") for level in levels],
        *[clean_text(_item(level)).alias(level) for level in levels],
        F.nullif(_item("website"), F.lit("")).alias("website"),
        F.nullif(_item("description"), F.lit("")).alias("description"),
        parse_number(_item("market_cap")).alias("market_cap"),
        F.nullif(_item("name"), F.lit("")).alias("name"),
    )


def change_or_null(price: Column, change: Column) -> Column:
    """A change of -100 % beside a missing price was computed from the price that is missing."""
    return F.when(price.isNull() & (change == -100), None).otherwise(change)


def quotes(landing: DataFrame) -> DataFrame:
    """Quote map (symbol to figures) to rows. Zero is absent for a price or size, real for a volume."""
    prices = ("open_price", "high_price", "low_price")
    fields = _texts("current_price", *prices, *QUOTE_SIZES, "volume", "change", "tradetime")
    parsed = F.from_json("payload", f"map<string, struct<{fields}>>")
    items = _exploded(landing, [], parsed, "symbol", "item")
    price = positive_or_null(parse_number(_item("current_price")))
    # An empty object means that nothing is known about the symbol.
    known = F.coalesce(*[_item(n) for n in ("current_price", *prices, *QUOTE_SIZES, "volume", "change", "tradetime")])
    return items.where(known.isNotNull()).select(
        "symbol",
        price.alias("current_price"),
        *[positive_or_null(parse_number(_item(n))).alias(n) for n in prices],
        parse_number(_item("volume")).alias("volume"),
        change_or_null(price, parse_percent(_item("change"))).alias("change_pct"),
        *[positive_or_null(parse_number(_item(n))).alias(n) for n in QUOTE_SIZES],
        _item("tradetime").alias("trade_time"),
    )


def _statement_rows(landing: DataFrame) -> DataFrame:
    parsed = F.from_json("payload", "struct<financials: array<map<string, string>>>")["financials"]
    sent = landing.select(
        "symbol",
        _param("statement_type").alias("statement_type"),
        _param("statement_code").alias("statement_code"),
        _param("period").alias("period_kind"),
        parsed.alias("rows"),
    )
    kept = ["symbol", "statement_type", "statement_code", "period_kind"]
    names = F.array_distinct(F.flatten(F.transform("rows", lambda m: F.map_keys(m))))
    kind = F.when(F.col("statement_code") == "pl", classify(names)["kind"]).otherwise("unknown")
    return _exploded(sent.withColumn("schema_kind", kind), [*kept, "schema_kind"], F.col("rows"), "item")


def _named(name: str) -> Column:
    return F.try_element_at("item", F.lit(name))


def _period_header() -> Column:
    return header_or_period_end(_named("header"), parse_date(_named("period_end")))


PERIOD_KEY = ("symbol", "statement_type", "statement_code", "period_kind", "header")


def statement_periods(landing: DataFrame) -> DataFrame:
    """Statement payloads to periods, each stamped with the family found from all periods of the payload."""
    return _cleaned(
        _statement_rows(landing),
        "symbol", "statement_type", "statement_code", "period_kind",
        _period_header().alias("header"),
        to_int(_named("year")).alias("year"),
        *[parse_date(_named(n)).alias(n) for n in ("period_start", "period_end", "result_date")],
        "schema_kind",
    )


def statement_lines(landing: DataFrame) -> DataFrame:
    """Statement payloads to one row per figure, with the year and end of its period."""
    rows = _cleaned(
        _statement_rows(landing),
        "symbol", "statement_type", "statement_code", "period_kind",
        _period_header().alias("header"),
        to_int(_named("year")).alias("year"),
        parse_date(_named("period_end")).alias("period_end"),
        "item",
    )
    named = [*PERIOD_KEY, "year", "period_end"]
    return _exploded(rows, named, F.col("item"), "field_name", "raw").where(
        ~F.col("field_name").isin(*PERIOD_FIELDS)
    ).select(*named, "field_name", parse_number("raw").alias("value"))


def _series(landing: DataFrame, group: str, param: str) -> DataFrame:
    """`{ratios: [{header, year, field: figure, ...}]}` to one row per figure."""
    parsed = F.from_json("payload", "struct<ratios: array<map<string, string>>>")["ratios"]
    entries = _exploded(landing, ["symbol", "params"], parsed, "item")
    headed = entries.where(F.nullif(_named("header"), F.lit("")).isNotNull())
    tags = [
        "symbol",
        _param("statement_type").alias("statement_type"),
        _param(param).alias(group),
        _named("header").alias("header"),
        to_int(_named("year")).alias("year"),
    ]
    figures = _exploded(headed, tags, F.col("item"), "field_name", "raw")
    named = figures.where(~F.col("field_name").isin("header", "year"))
    return named.withColumn("value", parse_number("raw")).drop("raw")


def basic_financials(landing: DataFrame) -> DataFrame:
    return _series(landing, "statement_code", "statement_code")


def ratios(landing: DataFrame) -> DataFrame:
    return _series(landing, "family", "ratio_type")


def metrics(landing: DataFrame) -> DataFrame:
    """Point-in-time metrics: one row per field of the payload's map."""
    parsed = F.from_json("payload", "struct<financial_metrics: map<string, string>>")["financial_metrics"]
    tags = ["symbol", _param("statement_type").alias("statement_type"), _param("ratio_type").alias("family")]
    figures = _exploded(landing, tags, parsed, "field_name", "raw")
    return figures.withColumn("value", parse_number("raw")).drop("raw")


def price_ratios_daily(landing: DataFrame) -> DataFrame:
    items = _items(landing, _texts("quote_date", *VALUATION), "price_ratios")
    return _cleaned(
        items,
        "symbol",
        _param("statement_type").alias("statement_type"),
        parse_date(_item("quote_date")).alias("quote_date"),
        *_numbers(VALUATION),
    ).where(F.col("quote_date").isNotNull())


def price_ratios_annual(landing: DataFrame) -> DataFrame:
    """Yearly valuation; a zero means that the ratio could not be computed."""
    items = _items(landing, _texts("header", "year", "average_price", *VALUATION), "price_ratios")
    return items.where(F.nullif(_item("header"), F.lit("")).isNotNull()).select(
        "symbol",
        _param("statement_type").alias("statement_type"),
        _item("header").alias("header"),
        to_int(_item("year")).alias("year"),
        parse_number(_item("average_price")).alias("average_price"),
        *[zero_to_null(parse_number(_item(n))).alias(n) for n in VALUATION],
    )


def is_price_row(open_: Column, high: Column, low: Column, close: Column, volume: Column) -> Column:
    """False for a session without trading (nothing but zeros) and for prices below zero."""
    zero = F.lit(0.0)
    some = F.coalesce(*[F.nullif(c, zero) for c in (open_, high, low, close, volume)]).isNotNull()
    closed = F.coalesce(close > 0, F.lit(True))
    positive = [F.coalesce(c >= 0, F.lit(True)) for c in (open_, high, low)]
    return some & closed & positive[0] & positive[1] & positive[2]


def prices(landing: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Daily prices; `kept` names further columns of the landing to carry, such as the time of the fetch."""
    fields = ("open_price", "high_price", "low_price", "close_price", "volume")
    items = _items(landing, _texts("quote_date", *fields), "price")
    rows = _cleaned(
        items,
        *kept,
        "symbol",
        parse_date(_item("quote_date")).alias("quote_date"),
        *[parse_number(_item(n)).alias(n.removesuffix("_price")) for n in fields],
    )
    traded = is_price_row(*[F.col(n) for n in ("open", "high", "low", "close", "volume")])
    return rows.where(F.col("quote_date").isNotNull() & traded)


def dividends(landing: DataFrame) -> DataFrame:
    items = _items(landing, _texts("date", "amount", "dividend_type"), "dividend")
    return _cleaned(
        items,
        "symbol",
        F.lit("dividend").alias("action"),
        parse_date(_item("date")).alias("ex_date"),
        F.coalesce(_item("dividend_type"), F.lit("")).alias("subject"),
        parse_number(_item("amount")).alias("amount"),
        _item("dividend_type").alias("dividend_type"),
    ).where(F.col("ex_date").isNotNull())


def corporate_actions(landing: DataFrame) -> DataFrame:
    """Splits, bonuses and the like; the action is the path part after `/corporate-actions/`."""
    action = F.regexp_extract("endpoint", r"/corporate-actions/([^/]+)", 1)
    parsed = F.from_json("payload", f"map<string, array<struct<{_texts('date', 'action', 'amount')}>>>")
    sent = landing.select("symbol", action.alias("action"), parsed.alias("by_action"))
    items = _exploded(sent, ["symbol", "action"], F.try_element_at("by_action", F.col("action")), "item")
    return _cleaned(
        items,
        "symbol",
        "action",
        parse_date(_item("date")).alias("ex_date"),
        F.coalesce(_item("action"), F.lit("")).alias("subject"),
        parse_number(_item("amount")).alias("amount"),
        F.lit(None).cast("string").alias("dividend_type"),
    ).where(F.col("ex_date").isNotNull())


def all_actions(dividend_landing: DataFrame, action_landing: DataFrame) -> DataFrame:
    return dividends(dividend_landing).unionByName(corporate_actions(action_landing))


def shareholding(landing: DataFrame) -> DataFrame:
    """Quarters, then holder groups: two nested arrays to rows."""
    data = _texts("shareholdingPct", "totalShares", "totalShareholders", "pledgedSharesPct", "lockedInSharesPct")
    group = f"`group`: string, data: struct<{data}>"
    quarters = _items(landing, f"date_header: string, distributions: array<struct<{group}>>", "distributions")
    labelled = quarters.where(F.nullif(_item("date_header"), F.lit("")).isNotNull())
    tags = ["symbol", _item("date_header").alias("period_label")]
    groups = _exploded(labelled, tags, _item("distributions"), "item")
    figure = lambda name: parse_number(F.col("item.data").getField(name))
    return groups.where(F.nullif(_item("group"), F.lit("")).isNotNull()).select(
        "symbol",
        "period_label",
        _item("group").alias("group_name"),
        figure("shareholdingPct").alias("shareholding_pct"),
        figure("totalShares").alias("total_shares"),
        figure("totalShareholders").alias("total_shareholders"),
        figure("pledgedSharesPct").alias("pledged_pct"),
        figure("lockedInSharesPct").alias("locked_in_pct"),
    )


def _index_items(landing: DataFrame, fields: str) -> DataFrame:
    items = _cleaned(
        _items(landing, f"index_symbol: string, {fields}"),
        clean_text(_item("index_symbol")).alias("index_symbol"),
        "item",
    )
    return items.where(F.col("index_symbol").isNotNull())


def indices(landing: DataFrame) -> DataFrame:
    texts = ("exchange", "index_type", "index_sub_type")
    items = _index_items(landing, _texts("index_name", *texts, "market_cap"))
    return items.select(
        "index_symbol",
        F.coalesce(F.nullif(_item("index_name"), F.lit("")), F.col("index_symbol")).alias("index_name"),
        *[F.nullif(_item(n), F.lit("")).alias(n) for n in texts],
        zero_to_null(parse_number(_item("market_cap"))).alias("market_cap"),
    )


def constituents(landing: DataFrame) -> DataFrame:
    """Membership edges: one row per listed constituent."""
    items = _index_items(landing, "constituents: array<string>")
    edges = _exploded(items, ["index_symbol"], _item("constituents"), "symbol")
    return edges.where(F.nullif(F.col("symbol"), F.lit("")).isNotNull())


def clear_absent_valuation(df: DataFrame) -> DataFrame:
    """P/E and P/B of zero together mark the whole valuation block as absent."""
    absent = (F.col("pe") == 0) & (F.col("pb") == 0)
    return df.withColumns(
        {c: F.when(F.coalesce(absent, F.lit(False)), None).otherwise(F.col(c)) for c in ("pe", "pb", "div_yield")}
    )


def index_quotes(landing: DataFrame) -> DataFrame:
    plain = ("close_price", "open_price", "high_price", "low_price", "change_pct", "points_change",
             "pe", "pb", "div_yield", "turnover", "volume")
    items = _index_items(landing, _texts("quote_date", "market_cap", *plain))
    rows = _cleaned(
        items,
        "index_symbol",
        parse_date(_item("quote_date")).alias("quote_date"),
        *_numbers(plain),
        zero_to_null(parse_number(_item("market_cap"))).alias("market_cap"),
    ).where(F.col("quote_date").isNotNull())
    return clear_absent_valuation(rows)


def index_returns(landing: DataFrame) -> DataFrame:
    """Eight horizons to rows; a zero return means that the index did not exist that far back."""
    items = _index_items(landing, _texts(*HORIZONS) + ", dates: struct<last_date: string>")
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), _item(h).alias("raw")) for h in HORIZONS])
    long = items.select(
        "index_symbol", parse_date(F.col("item.dates.last_date")).alias("as_of"), F.explode(pairs).alias("p")
    )
    return _cleaned(
        long,
        "index_symbol", F.col("p.horizon").alias("horizon"), parse_number("p.raw").alias("return_pct"), "as_of"
    ).where(F.col("return_pct") != 0)
