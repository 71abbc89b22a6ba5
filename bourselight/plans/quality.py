"""Data-quality checks over Layer 2 and the repair of stored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselight.operators.normalise import change_or_null, clear_absent_valuation, is_price_row
from bourselight.operators.spread import top_n

SAMPLE_SIZE = 10
PLAUSIBLE_10Y_CAGR = 50.0
PLAUSIBLE_DAY_CHANGE = 50.0

# Quote fields where zero means that nothing was reported. Volume is not among them.
ZERO_IS_ABSENT = (
    "current_price", "open_price", "high_price", "low_price", "high52", "low52", "market_cap", "shares",
)


def sample(keys: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The first ten keys as one text. The cut comes before the list, so the list is short whatever the input."""
    key = F.col(keys.columns[0]).cast("string")
    order = order or [F.col("k")]
    first = keys.select(key.alias("k"), *[F.col(c) for c in keys.columns[1:]]).orderBy(*order).limit(SAMPLE_SIZE)
    # Ten rows at most, so one task is enough to number them.
    ranked = first.withColumn("_p", F.row_number().over(W.orderBy(*order)))
    return ranked.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "k"))), lambda s: s["k"]), "|").alias(
            "sample"
        )
    )


def outside(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct keys of one frame that the other lacks."""
    return keys.select("symbol").distinct().join(known.select("symbol"), "symbol", "left_anti")


def quoted_twice(quote: DataFrame, company: DataFrame) -> DataFrame:
    """Quote keys outside the master that are all digits and are the exchange code of a company."""
    numeric = outside(quote, company).where(F.col("symbol").rlike("^[0-9]+$"))
    codes = company.select(F.col("bse_code").alias("symbol")).where(F.col("symbol").isNotNull())
    return numeric.intersect(codes)


# Name, severity and what the bad rows are.
CHECKS = (
    ("quote_keys_outside_symbol_master", "info", "quoted symbols are not in the symbol master"),
    ("companies_quoted_twice", "warning", "companies are quoted under their exchange code as well"),
    ("listed_without_a_quote", "warning", "companies have no quote"),
    ("index_members_missing_from_symbol_master", "warning", "index members are not in the symbol master"),
    ("companies_without_a_sector", "info", "companies have no sector"),
    ("unclassified_statement_schema", "error", "P&L periods have no known schema"),
    ("non_positive_close_price", "error", "prices are zero or below"),
    ("implausible_daily_change", "warning", "quotes change by more than 50 % in a day"),
    ("implausible_ten_year_return", "warning", "companies return more than 50 % a year over ten years"),
)
NO_SAMPLE = ("unclassified_statement_schema", "implausible_daily_change")


def _keys(company: DataFrame, quote: DataFrame, constituents: DataFrame) -> DataFrame:
    """What each key is, from one scan per table: company, quoted, member, exchange code, without sector, jumps."""
    flag = lambda name: F.lit(name).alias("flag")
    own = F.struct(F.col("symbol").alias("symbol"), F.lit("company").alias("flag"))
    bare = F.when(F.col("sector").isNull(), F.struct(F.col("symbol").alias("symbol"), F.lit("no_sector").alias("flag")))
    code = F.when(F.col("bse_code").isNotNull(), F.struct(F.col("bse_code").alias("symbol"), F.lit("code").alias("flag")))
    jump = F.when(F.abs("change_pct") > PLAUSIBLE_DAY_CHANGE, "jump").otherwise("quoted")
    rows = (
        company.select(F.inline(F.array_compact(F.array(own, bare, code))))
        .unionByName(quote.select("symbol", jump.alias("flag")))
        .unionByName(constituents.select("symbol", flag("member")))
    )
    count = lambda name: F.count_if(F.col("flag") == name).alias(name)
    return rows.groupBy("symbol").agg(*[count(n) for n in ("company", "no_sector", "code", "quoted", "jump", "member")])


def violations(
    company: DataFrame, quote: DataFrame, constituents: DataFrame, periods: DataFrame, prices: DataFrame, snapshot: DataFrame
) -> DataFrame:
    """(name, symbol, n, weight): bad rows per check and key; samples take the greatest weight first."""
    known, quoted = F.col("company") > 0, F.col("quoted") + F.col("jump") > 0
    outside_master = quoted & ~known
    found = {
        "quote_keys_outside_symbol_master": F.when(outside_master, 1),
        "companies_quoted_twice": F.when(outside_master & (F.col("code") > 0) & F.col("symbol").rlike("^[0-9]+$"), 1),
        "listed_without_a_quote": F.when(known & ~quoted, 1),
        "index_members_missing_from_symbol_master": F.when((F.col("member") > 0) & ~known, 1),
        "companies_without_a_sector": F.when(F.col("no_sector") > 0, F.col("no_sector")),
        "implausible_daily_change": F.when(F.col("jump") > 0, F.col("jump")),
    }
    no_weight = F.lit(0.0)
    entries = [F.struct(F.lit(k).alias("name"), v.cast("long").alias("n")) for k, v in found.items()]
    by_key = _keys(company, quote, constituents).select("symbol", F.explode(F.array(*entries)).alias("e")).select(
        "e.name", "symbol", "e.n", no_weight.alias("weight")
    ).where(F.col("n").isNotNull())
    named = lambda name: F.lit(name).alias("name")
    unclassified = periods.where((F.col("statement_code") == "pl") & (F.col("schema_kind") == "unknown"))
    by_period = unclassified.groupBy("symbol").agg(F.count("*").alias("n")).select(
        named("unclassified_statement_schema"), "symbol", "n", no_weight.alias("weight")
    )
    by_price = prices.where(F.col("close") <= 0).groupBy("symbol").agg(F.count("*").alias("n")).select(
        named("non_positive_close_price"), "symbol", "n", F.col("n").cast("double").alias("weight")
    )
    steep = snapshot.where(F.col("price_cagr_10y") > PLAUSIBLE_10Y_CAGR).select(
        named("implausible_ten_year_return"), "symbol", F.lit(1).cast("long").alias("n"), F.col("price_cagr_10y").alias("weight")
    )
    return by_key.unionByName(by_period).unionByName(by_price).unionByName(steep)


def checks(
    company: DataFrame,
    quote: DataFrame,
    constituents: DataFrame,
    periods: DataFrame,
    prices: DataFrame,
    snapshot: DataFrame,
) -> DataFrame:
    """The nine checks, one row each: name, severity, number of bad rows, whether it passes, sample of keys, detail."""
    bad = violations(company, quote, constituents, periods, prices, snapshot)
    order = [F.col("weight").desc(), F.col("symbol")]
    ranked = top_n(bad.withColumn("symbol", F.col("symbol").cast("string")), ["name"], order, SAMPLE_SIZE)
    samples = ranked.groupBy("name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol"))), lambda s: s["symbol"]), "|").alias("sample")
    )
    counts = bad.groupBy("name").agg(F.sum("n").alias("count"))
    listed = bad.sparkSession.createDataFrame(list(CHECKS), "name string, severity string, what string")
    joined = listed.join(counts, "name", "left").join(samples, "name", "left")
    count = F.coalesce("count", F.lit(0).cast("long"))
    sampled = F.when(F.col("name").isin(*NO_SAMPLE), "").otherwise(F.coalesce("sample", F.lit("")))
    return joined.select(
        "name", "severity", count.alias("count"), (count == 0).alias("ok"), sampled.alias("sample"),
        F.concat_ws(" ", count.cast("string"), "what").alias("detail"),
    )


def summary(check_rows: DataFrame) -> DataFrame:
    """Failing checks by severity."""
    failing = ~F.col("ok")
    return check_rows.agg(
        F.count_if(failing & (F.col("severity") == "error")).alias("errors"),
        F.count_if(failing & (F.col("severity") == "warning")).alias("warnings"),
    )


def bad_price_symbols(prices: DataFrame, limit: int = SAMPLE_SIZE) -> DataFrame:
    """Symbols with most prices at or below zero."""
    counts = prices.where(F.col("close") <= 0).groupBy("symbol").agg(F.count("*").alias("bad_rows"))
    return counts.orderBy(F.desc("bad_rows"), "symbol").limit(limit)


# --- repair: the null rules of normalisation, applied to stored rows ---------------------------------------------


def repaired_prices(prices: DataFrame) -> DataFrame:
    return prices.where(is_price_row(*[F.col(c) for c in ("open", "high", "low", "close", "volume")]))


def repaired_quotes(quote: DataFrame) -> DataFrame:
    fields = [c for c in ZERO_IS_ABSENT if c in quote.columns]
    cleared = quote.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in fields})
    return cleared.withColumn("change_pct", change_or_null(F.col("current_price"), F.col("change_pct")))


def repaired_index_quotes(index_quotes: DataFrame) -> DataFrame:
    return clear_absent_valuation(index_quotes).withColumn(
        "market_cap", F.nullif(F.col("market_cap"), F.lit(0.0))
    )


def repaired_index_master(index_master: DataFrame) -> DataFrame:
    return index_master.withColumn("market_cap", F.nullif(F.col("market_cap"), F.lit(0.0)))


def _count(df: DataFrame, bad: Column, name: str) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("changed")).select(F.lit(name).alias("rule"), "changed")


def repair_report(
    prices: DataFrame, quote: DataFrame, index_quotes: DataFrame, index_master: DataFrame
) -> DataFrame:
    """Rows that each rule changes, one scan per table. A repaired table reports zeros."""
    fields = [c for c in ZERO_IS_ABSENT if c in quote.columns]
    some_absent = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) <= 0, F.lit(False)) for c in fields])
    no_price = F.col("current_price").isNull() | (F.col("current_price") <= 0)
    block = (F.col("pe") == 0) & (F.col("pb") == 0)
    traded = is_price_row(*[F.col(c) for c in ("open", "high", "low", "close", "volume")])
    by_quote = quote.agg(
        F.count_if((F.col("change_pct") == -100) & no_price).alias("quote_changes_cleared"),
        F.count_if(some_absent).alias("quote_rows_corrected"),
    )
    rows = [
        _count(prices, ~traded, "price_rows_removed"),
        by_quote.unpivot([], ["quote_changes_cleared", "quote_rows_corrected"], "rule", "changed"),
        _count(index_quotes, block, "index_valuations_cleared"),
        _count(
            index_quotes.select("market_cap").unionByName(index_master.select("market_cap")),
            F.col("market_cap") == 0,
            "index_market_caps_cleared",
        ),
    ]
    return reduce(DataFrame.unionByName, rows)
