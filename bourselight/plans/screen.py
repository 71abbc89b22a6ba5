"""Screens over the snapshot: a predicate, display columns, an order, a page and a row cap.

Predicates are Spark columns. `catalog.col` finds a column by key, label or alias, and three-valued logic is
Spark's own: a missing figure stays unknown, also under NOT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight import catalog
from bourselight.catalog import col
from bourselight.plans.snapshot import INDEX, with_indices

# Fixed values.
DEFAULT_COLUMNS = (
    "name", "current_price", "market_cap", "pe", "book_value", "dividend_yield", "returnoncapital",
    "returnonequity",
)
KEY_RATIO_COLUMNS = (
    "pe", "pb", "ps", "book_value", "returnonequity", "returnoncapital", "dividend_yield",
    "totaldebttoequity", "ev_ebitda", "roe3yearsavg", "roce3yearsavg", "eps", "sales", "net_profit",
    "price_cagr_1y", "price_cagr_3y", "price_cagr_5y", "price_cagr_10y", "promoter_holding",
    "promoter_pledge",
)
MAX_PAGE = 100
PUBLIC_ROW_CAP = 25


def divide(a: Column, b: Column) -> Column:
    """Division in a predicate: NULL on a zero divisor."""
    return a / F.nullif(b, F.lit(0.0))


def one_of(name: str, values: Iterable[str], negated: bool = False) -> Column:
    """Text membership whatever the case; a NULL text matches neither form. `Index` is membership in an index."""
    hit = member_of(values) if catalog.resolve(name).key == INDEX else F.upper(col(name)).isin([v.upper() for v in values])
    return ~hit if negated else hit


def member_of(index_symbols: Iterable[str]) -> Column:
    """Whether a company belongs to any of the indices, as a condition for any place in a predicate.

    Reads the index symbols stored with each company (`snapshot.with_indices`): no join, whatever the number of such
    conditions. Never unknown, also under NOT; index symbols match case by case.
    """
    wanted = sorted(set(index_symbols))
    return F.arrays_overlap(F.col(INDEX), F.array(*[F.lit(s) for s in wanted]).cast("array<string>")) if wanted else F.lit(False)


def in_index(df: DataFrame, memberships: DataFrame, index_symbols: Iterable[str]) -> DataFrame:
    """Companies of any of the indices. Index symbols match case by case."""
    return df.join(_members(memberships, index_symbols), "symbol", "left_semi")


def not_in_index(df: DataFrame, memberships: DataFrame, index_symbols: Iterable[str]) -> DataFrame:
    """Companies outside all of the indices; this negation is never unknown."""
    return df.join(_members(memberships, index_symbols), "symbol", "left_anti")


def _members(memberships: DataFrame, index_symbols: Iterable[str]) -> DataFrame:
    return memberships.where(F.col("index_symbol").isin(list(index_symbols))).select("symbol")


def screenable(snapshot: DataFrame) -> DataFrame:
    """Companies with a market cap."""
    return snapshot.where(F.col("market_cap").isNotNull())


def matches(snapshot: DataFrame, predicate: Column) -> DataFrame:
    return screenable(snapshot).where(predicate)


def ordered(df: DataFrame, sort_by: str | None = None, descending: bool = True) -> DataFrame:
    """By any catalog column with NULLs last either way, then symbol; an unknown name means market cap."""
    entry = catalog.find(sort_by) if sort_by else None
    key = F.col(entry.key if entry else "market_cap")
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("symbol"))


def display(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Symbol and the requested columns, each once."""
    return df.select("symbol", *[e.key for e in catalog.resolve_all(names or DEFAULT_COLUMNS)])


def page_bounds(page: int, page_size: int, row_cap: int | None) -> tuple[int, int]:
    """Offset and number of rows of a page. A later page cannot reach past the cap."""
    page, size = max(1, page), max(1, min(page_size, MAX_PAGE))
    offset = (page - 1) * size
    if row_cap is not None:
        size = max(0, min(size, row_cap - offset))
    return offset, size


def paged(
    found: DataFrame,
    columns: Sequence[str] | None = None,
    sort_by: str | None = None,
    descending: bool = True,
    page: int = 1,
    page_size: int = MAX_PAGE,
    row_cap: int | None = None,
) -> DataFrame:
    """One page of matching rows with the true total and whether the cap cut it."""
    offset, size = page_bounds(page, page_size, row_cap)
    total = found.agg(F.count("*")).scalar()
    capped = F.lit(False) if row_cap is None else F.col("total") > row_cap
    # The order column may not be on display, so the order comes before the projection.
    rows = ordered(found, sort_by, descending).offset(offset).limit(size)
    return display(rows, columns).withColumn("total", total).withColumn("capped", capped)


def run(snapshot: DataFrame, predicate: Column, **page_options) -> DataFrame:
    return paged(matches(snapshot, predicate), **page_options)


def export(found: DataFrame, ceiling: int, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows for a CSV with display labels as header, and one row of total, exported and truncated."""
    entries = catalog.resolve_all(columns or DEFAULT_COLUMNS)
    rows = ordered(found).limit(ceiling)
    labelled = rows.select(F.col("symbol").alias("Symbol"), *[F.col(e.key).alias(e.label) for e in entries])
    counts = found.agg(F.count("*").alias("total")).select(
        "total",
        F.least("total", F.lit(ceiling)).cast("bigint").alias("exported"),
        (F.col("total") > ceiling).alias("truncated"),
    )
    return labelled, counts


@dataclass(frozen=True)
class Preset:
    slug: str
    predicate: Callable[[], Column]
    columns: tuple[str, ...] = ()


# The public screens.
PRESETS = (
    Preset(
        "low-pe-high-roce",
        lambda: (col("Price to Earning") < 20)
        & (col("Average return on capital employed 3Years") > 20)
        & (col("Market Capitalization") > 1000),
    ),
    Preset(
        "debt-free-compounders",
        lambda: (col("Debt to equity") < 0.1)
        & (col("Sales growth 5Years") > 15)
        & (col("Profit growth 5Years") > 15),
        ("name", "market_cap", "pe", "revenuegrowth5years", "netincomegrowth5years"),
    ),
    Preset(
        "dividend-champions",
        lambda: (col("Dividend Yield") > 3)
        & (col("Average dividend payout 3Years") > 25)
        & (col("Return on equity") > 15),
        ("name", "market_cap", "dividend_yield", "dividendpayoutpct3yrsavg", "returnonequity"),
    ),
    Preset(
        "quality-at-a-reasonable-price",
        lambda: (col("Average return on equity 5Years") > 18)
        & (col("Price to Earning") < 25)
        & (col("Debt to equity") < 0.5),
    ),
    Preset(
        "cash-generators",
        lambda: (col("CFO to PAT") > 1)
        & (col("Free cash flow") > 0)
        & (col("Average FCF to revenue 3Years") > 8),
        ("name", "market_cap", "cfo_to_pat", "fcf", "fcfaspctofrevenue3yearsavg"),
    ),
    Preset(
        "negative-working-capital",
        lambda: (col("Cash conversion cycle") < 0) & (col("Sales growth 3Years") > 10),
        ("name", "market_cap", "cashconversioncycle", "debtordays", "revenuegrowth3years"),
    ),
    Preset(
        "near-52-week-low",
        lambda: (col("Down from 52w high") > 30) & (col("Return on equity") > 12) & (col("Debt to equity") < 1),
        ("name", "current_price", "down_from_52w_high", "pe", "returnonequity"),
    ),
    Preset(
        "promoter-pledge-risk",
        lambda: col("Promoter pledge") > 10,
        ("name", "market_cap", "promoter_holding", "promoter_pledge", "totaldebttoequity"),
    ),
    Preset(
        "high-growth-small-caps",
        lambda: (col("Market Capitalization") < 5000)
        & (col("Market Capitalization") > 500)
        & (col("Sales growth 3Years") > 20),
        ("name", "market_cap", "revenuegrowth3years", "returnonequity", "pe"),
    ),
    Preset(
        "turnaround",
        lambda: (col("Net Profit") > 0)
        & (col("Profit growth 3Years") > 0)
        & (col("Return on equity") > 0)
        & (col("Price to Earning") < 30),
    ),
    Preset("nifty-value", lambda: one_of("Index", ["NIF50"]) & (col("Price to Earning") < 20)),
    Preset(
        "trading-below-book",
        lambda: (col("Price to book value") < 1)
        & (col("Return on equity") > 8)
        & (col("Market Capitalization") > 500),
        ("name", "market_cap", "pb", "book_value", "current_price", "returnonequity"),
    ),
)
BY_SLUG = {p.slug: p for p in PRESETS}


def preset_matches(snapshot: DataFrame, memberships: DataFrame, slug: str) -> DataFrame:
    return matches(_listed(snapshot, memberships), BY_SLUG[slug].predicate())


def _listed(snapshot: DataFrame, memberships: DataFrame) -> DataFrame:
    """The snapshot with its stored index symbols, or with those of the links where it has none."""
    return snapshot if INDEX in snapshot.columns else with_indices(snapshot, memberships)


def run_preset(
    snapshot: DataFrame, memberships: DataFrame, slug: str, page: int = 1, row_cap: int | None = None
) -> DataFrame:
    found = preset_matches(snapshot, memberships, slug)
    return paged(found, columns=BY_SLUG[slug].columns or None, page=page, row_cap=row_cap)


def preset_hits(snapshot: DataFrame, memberships: DataFrame) -> DataFrame:
    """All presets in one pass over the snapshot: one row per (slug, matching company)."""
    tests = [F.when(preset.predicate(), F.lit(preset.slug)) for preset in PRESETS]
    return screenable(_listed(snapshot, memberships)).select(
        F.explode(F.filter(F.array(*tests), lambda s: s.isNotNull())).alias("slug"), "symbol", "market_cap"
    )
