"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselight import catalog
from bourselight.catalog import col
from bourselight.plans import monitor, pages, screen
from workload.registry import names, query, r6, rounded, snapshot_table

DISPLAY = r6("current_price", "market_cap", "high52", "low52")


def _quotes(t):
    """Company identity with quote columns, as a small snapshot."""
    return t.company.join(t.quote, "symbol", "left")


QUOTES = "(SELECT * FROM company LEFT JOIN quote USING (symbol))"


@query(
    "f01_threshold_compare",
    f"""SELECT symbol, {DISPLAY} FROM {QUOTES}
WHERE current_price >= 950 AND market_cap > 2000 AND high52 <> low52 AND low52 < current_price * 2
  AND high52 <= 10000 AND 900 <= current_price""",
)
def f01(t):
    predicate = (
        (col("CMP") >= 950)
        & (col("Market cap") > 2000)
        & (col("52w high") != col("52w low"))
        & F.expr("low52 < current_price * 2 AND high52 <= 10000 AND 900 <= current_price")
    )
    found = _quotes(t).where(predicate)
    return rounded(found.select("symbol", "current_price", "market_cap", "high52", "low52"))


@query(
    "f02_arithmetic",
    f"""SELECT symbol, {r6('market_cap')}, round(high52 / nullif(change_pct, 0), 6) AS per_change
FROM {QUOTES} WHERE high52 / nullif(change_pct, 0) > 2 * (low52 - 100) / -(shares + 1) + 5 OR change_pct = 0""",
)
def f02(t):
    per_change = screen.divide(col("high52"), col("Day change"))
    bound = 2 * (col("low52") - 100) / -(F.col("shares") + 1) + 5
    found = _quotes(t).where((per_change > bound) | (col("change_pct") == 0))
    return rounded(found.select("symbol", "market_cap", per_change.alias("per_change")))


@query(
    "f03_three_valued_logic",
    f"""SELECT symbol, {r6('current_price', 'market_cap')} FROM {QUOTES}
WHERE NOT (market_cap < 2000 OR current_price > 1000 AND change_pct < 0)""",
)
def f03(t):
    inner = (col("market_cap") < 2000) | ((col("current_price") > 1000) & (col("change_pct") < 0))
    return rounded(_quotes(t).where(~inner).select("symbol", "current_price", "market_cap"))


@query(
    "f04_text_membership",
    "SELECT symbol, sector, industry FROM company WHERE upper(sector) IN ('BRAND#1', 'BRAND#12', 'BRAND#7') "
    "OR upper(industry) = 'PROMO'",
)
def f04(t):
    hit = screen.one_of("Sector", ["brand#1", "Brand#12", "BRAND#7"]) | screen.one_of("Industry", ["promo"])
    return t.company.where(hit).select("symbol", "sector", "industry")


@query(
    "f05_negated_text_equality",
    "SELECT symbol, sector FROM company WHERE NOT upper(sector) IN ('BRAND#1')",
)
def f05(t):
    return t.company.where(screen.one_of("sector", ["brand#1"], negated=True)).select("symbol", "sector")


@query(
    "f06_base_predicate",
    f"SELECT symbol, name, {r6('market_cap')} FROM {QUOTES} WHERE market_cap IS NOT NULL",
)
def f06(t):
    return rounded(screen.screenable(_quotes(t)).select("symbol", "name", "market_cap"))


@query(
    "f07_names_and_aliases",
    f"""SELECT symbol, {r6('pe')}, round(market_cap, 6) AS "Market Capitalization", round(pb, 6) AS "Price to book value"
FROM snapshot WHERE pe < 25 AND pb IS NOT NULL""",
)
def f07(t):
    found = snapshot_table(t).where((col("p/E") < 25) & col("price_to book VALUE").isNotNull())
    labels = [col(n).alias(n) for n in ("Market Capitalization", "Price to book value")]
    return rounded(found.select("symbol", "pe", *labels))


@query(
    "f08_display_projection",
    f"""SELECT symbol, name, {r6('current_price', 'market_cap', 'pe')}, CAST(NULL AS DOUBLE) AS book_value,
{r6('dividend_yield', 'returnoncapital', 'returnonequity')} FROM snapshot""",
)
def f08(t):
    return rounded(screen.display(snapshot_table(t), ["Name", *screen.DEFAULT_COLUMNS, "PE", "CMP"]))


_POPULATED_RATIOS = [
    "pe", "pb", "ps", "returnonequity", "returnoncapital", "dividend_yield", "totaldebttoequity", "ev_ebitda",
    "roce3yearsavg", "sales", "net_profit", "price_cagr_1y", "price_cagr_3y", "price_cagr_5y",
    "promoter_holding", "promoter_pledge",
]
_ABSENT_RATIOS = ["book_value", "roe3yearsavg", "eps", "price_cagr_10y"]


@query(
    "f09_key_ratios",
    f"""SELECT symbol, {r6(*_POPULATED_RATIOS)}, {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in _ABSENT_RATIOS)}
FROM snapshot""",
)
def f09(t):
    return rounded(snapshot_table(t).select("symbol", *screen.KEY_RATIO_COLUMNS))


# The same twelve screens as SQL conditions.
PRESET_SQL = {
    "low-pe-high-roce": "pe < 20 AND roce3yearsavg > 20 AND market_cap > 1000",
    "debt-free-compounders": "totaldebttoequity < 0.1 AND revenuegrowth5years > 15 AND netincomegrowth5years > 15",
    "dividend-champions": "dividend_yield > 3 AND dividendpayoutpct3yrsavg > 25 AND returnonequity > 15",
    "quality-at-a-reasonable-price": "roe5yearsavg > 18 AND pe < 25 AND totaldebttoequity < 0.5",
    "cash-generators": "cfo_to_pat > 1 AND fcf > 0 AND fcfaspctofrevenue3yearsavg > 8",
    "negative-working-capital": "cashconversioncycle < 0 AND revenuegrowth3years > 10",
    "near-52-week-low": "down_from_52w_high > 30 AND returnonequity > 12 AND totaldebttoequity < 1",
    "promoter-pledge-risk": "promoter_pledge > 10",
    "high-growth-small-caps": "market_cap < 5000 AND market_cap > 500 AND revenuegrowth3years > 20",
    "turnaround": "net_profit > 0 AND netincomegrowth3years > 0 AND returnonequity > 0 AND pe < 30",
    "nifty-value": "pe < 20 AND symbol IN (SELECT symbol FROM memberships WHERE index_symbol = 'NIF50')",
    "trading-below-book": "pb < 1 AND returnonequity > 8 AND market_cap > 500",
}


@query(
    "f10_preset_screens",
    "\nUNION ALL ".join(
        f"SELECT '{slug}' AS slug, symbol, {r6('market_cap')} FROM screenable WHERE {condition}"
        for slug, condition in PRESET_SQL.items()
    ),
)
def f10(t):
    return rounded(screen.preset_hits(t.screening, t.constituents))


@query(
    "f11_index_list_filter",
    "SELECT index_symbol, index_name, exchange FROM index_master WHERE exchange = 'NSE' "
    "AND (contains(lower(index_name), 'nation_1') OR contains(lower(index_symbol), 'nation_1'))",
)
def f11(t):
    found = pages.filter_indices(t.index_master, "NSE", " Nation_1 ")
    return found.select("index_symbol", "index_name", "exchange")


@query(
    "f12_log_filter",
    f"SELECT {names(['id', 'level', 'logger', 'message'])} FROM logs WHERE level = 'ERROR' AND starts_with(logger, 'app.e')",
)
def f12(t):
    return monitor.filter_logs(t.logs, "error", "app.e").select("id", "level", "logger", "message")


@query(
    "f13_index_type_filter",
    "SELECT index_symbol, index_type FROM index_master WHERE index_type = 'broad'",
)
def f13(t):
    listed = pages.listing(t.index_master, t.constituents, t.index_quotes, t.index_returns, "broad")
    return listed.select("index_symbol", "index_type")


def _listed_in(*indices: str) -> str:
    inside = ", ".join(f"'{i}'" for i in indices)
    return f"EXISTS (SELECT 1 FROM memberships m WHERE m.symbol = s.symbol AND m.index_symbol IN ({inside}))"


@query(
    "f14_membership_anywhere",
    f"""SELECT 'either' AS screen, symbol, {r6('pe')} FROM screenable s WHERE {_listed_in('NIF50')} OR pe < 10
UNION ALL SELECT 'neither', symbol, {r6('pe')} FROM screenable s WHERE NOT ({_listed_in('NIF50', 'SENSEX')} OR pe > 20)
UNION ALL SELECT 'nested', symbol, {r6('pe')} FROM screenable s
  WHERE NOT ({_listed_in('SENSEX')} AND (pe < 15 OR NOT {_listed_in('NIF50')})) AND (roce3yearsavg > 0 OR {_listed_in('NIF50')})
UNION ALL SELECT 'outside', symbol, {r6('pe')} FROM screenable s WHERE NOT {_listed_in('NIF50')} AND NOT pe > 20""",
)
def f14(t):
    """Index membership under OR, under NOT and inside nested brackets: conditions on one scan of the stored snapshot."""
    nifty, sensex = screen.one_of("Index", ["NIF50"]), screen.one_of("Index", ["SENSEX"])
    pe = col("PE")
    screens = {
        "either": nifty | (pe < 10),
        "neither": ~(screen.member_of(["NIF50", "SENSEX"]) | (pe > 20)),
        "nested": ~(sensex & ((pe < 15) | ~nifty)) & ((col("Average return on capital employed 3Years") > 0) | nifty),
        "outside": screen.one_of("Index", ["NIF50"], negated=True) & ~(pe > 20),
    }
    hits = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in screens.items()]))
    return rounded(screen.screenable(t.screening).select(F.explode(hits).alias("screen"), "symbol", "pe"))
