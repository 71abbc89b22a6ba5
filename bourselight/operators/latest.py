"""Latest-per-key picks and price-derived figures, as aggregates that combine before the shuffle.

Ranks are whole numbers so that `max_by` keeps to hash aggregation; a struct as rank would force a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight.functions.figures import annualised_return
from bourselight.functions.parse import label_month
from bourselight.operators.spread import lookup, top_n

CONSOLIDATED_BONUS = 100
TTM_BONUS = 50

# Horizon in years -> days back, a year being 365.25 days rounded half to even.
DAYS_BACK = {1: 365, 3: 1096, 5: 1826, 10: 3652}
DAYS_PER_YEAR = 365.25
SPAN_TOLERANCE = 0.1

VALUATION = ("pe", "pb", "ptb", "ps", "pfcf")

PROMOTERS = "promoterAndPromoterGroup"
PUBLIC = "publicShareholding"


def _is(column: str, value: str, points: int) -> Column:
    return F.when(F.col(column) == value, points).otherwise(0)


def figure_rank(is_ttm: Column) -> Column:
    """Consolidated 100, trailing twelve months 50, plus the year."""
    return (
        _is("statement_type", "c", CONSOLIDATED_BONUS)
        + F.when(is_ttm, TTM_BONUS).otherwise(0)
        + F.coalesce(F.col("year"), F.lit(0))
    ).cast("bigint")


def statement_rank() -> Column:
    """Equal ranks are settled by the later period end."""
    day = F.coalesce(F.unix_date("period_end"), F.lit(0))
    return figure_rank(F.col("period_kind") == "ttm") * 1_000_000 + day


def series_rank() -> Column:
    return figure_rank(F.col("header") == "TTM")


def usable_statement_lines(lines: DataFrame) -> DataFrame:
    """Figures of annual and trailing periods with their rank.

    Stored lines carry the year and end of their period, so that ranking the largest statement table needs no join.
    """
    usable = F.col("period_kind").isin("ttm", "annual") & F.col("value").isNotNull()
    return lines.where(usable).withColumn("rank", statement_rank())


def latest_statement_values(ranked_lines: DataFrame) -> DataFrame:
    return ranked_lines.groupBy("symbol", "statement_code", "field_name").agg(
        F.max_by("value", "rank").alias("value")
    )


def latest_series_values(series: DataFrame, group: str) -> DataFrame:
    """Latest figure per (symbol, group, field) of a series tagged with headers."""
    return (
        series.where(F.col("value").isNotNull())
        .groupBy("symbol", group, "field_name")
        .agg(F.max_by("value", series_rank()).alias("value"))
    )


def preferred_metrics(metrics: DataFrame) -> DataFrame:
    """Consolidated figure per metric; standalone only fills a gap."""
    return (
        metrics.where(F.col("value").isNotNull())
        .groupBy("symbol", "family", "field_name")
        .agg(F.max_by("value", _is("statement_type", "c", 1)).alias("value"))
    )


def latest_valuation(price_ratios: DataFrame) -> DataFrame:
    """The newest daily row per symbol, consolidated before standalone on one day.

    The whole row is taken: a NULL in it is not filled from an older day.
    """
    rank = (F.unix_date("quote_date").cast("bigint") * 2) + _is("statement_type", "c", 1)
    return price_ratios.groupBy("symbol").agg(*[F.max_by(c, rank).alias(c) for c in VALUATION])


def latest_shareholding(shareholding: DataFrame) -> DataFrame:
    """Promoter, pledge and public shares of the newest quarter per symbol."""
    dated = shareholding.withColumn("month", F.unix_date(label_month("period_label")))
    promoter = F.when(F.col("group_name") == PROMOTERS, F.col("month"))
    public = F.when(F.col("group_name") == PUBLIC, F.col("month"))
    newest = dated.groupBy("symbol").agg(
        F.max("month").alias("month"),
        F.max(promoter).alias("promoter_month"),
        F.max(public).alias("public_month"),
        F.max_by("shareholding_pct", promoter).alias("promoter_holding"),
        F.max_by("pledged_pct", promoter).alias("promoter_pledge"),
        F.max_by("shareholding_pct", public).alias("public_holding"),
    )
    # A group that the newest quarter lacks has no current figure, however recent its last one is.
    current = lambda name, month: F.when(F.col(month) == F.col("month"), F.col(name)).alias(name)
    return newest.select(
        "symbol",
        current("promoter_holding", "promoter_month"),
        current("promoter_pledge", "promoter_month"),
        current("public_holding", "public_month"),
    )


def trailing_dividends(actions: DataFrame, as_of: Column) -> DataFrame:
    """Dividend per share of the twelve months up to `as_of`; dates to come do not count."""
    window = (F.col("ex_date") > F.add_months(as_of, -12)) & (F.col("ex_date") <= as_of)
    paid = actions.where((F.col("action") == "dividend") & (F.col("amount") != 0) & window)
    return paid.groupBy("symbol").agg(
        F.sum(F.col("amount").cast("decimal(28,6)")).cast("double").alias("dividend")
    )


def last_sessions(prices: DataFrame, n: int) -> DataFrame:
    """The last n priced sessions per symbol, newest first."""
    priced = prices.where(F.col("close").isNotNull())
    return top_n(priced, ["symbol"], [F.col("quote_date").desc()], n, spread=["quote_date"])


def moving_figures(prices: DataFrame) -> DataFrame:
    """50 and 200 session averages, price to the longer one, and 30 session traded value in crore.

    Averages are NULL for a symbol with fewer sessions. Only the last 200 sessions leave the map side.
    """
    recent = last_sessions(prices.select("symbol", "quote_date", "close", "volume"), 200)
    within = lambda n: F.col("position") <= n
    traded = F.col("close") * F.coalesce(F.col("volume"), F.lit(0.0))
    sums = recent.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("position") == 1, F.col("close"))).alias("latest"),
        F.sum(F.when(within(50), F.col("close"))).alias("s50"),
        F.sum("close").alias("s200"),
        F.sum(F.when(within(30), traded)).alias("t30"),
    )
    dma200 = F.when(F.col("n") >= 200, F.col("s200") / 200)
    return sums.select(
        "symbol",
        F.when(F.col("n") >= 50, F.col("s50") / 50).alias("dma_50"),
        dma200.alias("dma_200"),
        F.when(dma200 > 0, F.col("latest") / F.nullif(dma200, F.lit(0.0))).alias("price_to_dma200"),
        (F.col("t30") / F.least(F.col("n"), F.lit(30)) * 1e-7).alias("avg_traded_value_30d"),
    )


def closes_years_ago(prices: DataFrame) -> DataFrame:
    """Per symbol the latest close and the close one, three, five and ten years before it.

    The past close is the last on or before the mark, and absent when it lies more than a tenth of the span off.
    One aggregate over the prices; the latest date per symbol reaches them through a spread lookup, because one
    symbol may hold much of the history.
    """
    priced = prices.where(F.col("close").isNotNull()).select(
        "symbol", "close", F.unix_date("quote_date").alias("day")
    )
    newest = priced.groupBy("symbol").agg(F.max("day").alias("last_day"))
    dated = lookup(priced, newest, ["symbol"], ["day"], how="inner")
    back = F.col("last_day") - F.col("day")
    picks = [F.max_by("close", "day").alias("latest")]
    for years, days in DAYS_BACK.items():
        limit = years * DAYS_PER_YEAR * (1 + SPAN_TOLERANCE)
        eligible = (back >= days) & (back <= limit)
        picks.append(F.max_by("close", F.when(eligible, F.col("day"))).alias(f"close_{years}y"))
    return dated.groupBy("symbol").agg(*picks)


def annualised_returns(prices: DataFrame) -> DataFrame:
    points = closes_years_ago(prices)
    return points.select(
        "symbol",
        *[annualised_return("latest", f"close_{y}y", y).alias(f"price_cagr_{y}y") for y in DAYS_BACK],
    )
