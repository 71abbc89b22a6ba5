"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselight.operators import latest
from bourselight.operators.normalise import PERIOD_KEY
from bourselight.plans import pages, screen, statements
from bourselight.plans.snapshot import memberships
from workload.pipelines import LISTING_SQL, listing_frame, snapshot_frame, snapshot_sql
from workload.registry import names, query, r6, rounded, snapshot_table

KEY = names(PERIOD_KEY)


@query(
    "j01_period_lines",
    f"SELECT {KEY}, year, period_end, field_name, value FROM periods JOIN lines "
    "USING (symbol, statement_type, statement_code, period_kind, header)",
)
def j01(t):
    joined = t.periods.join(t.lines.drop("year", "period_end"), list(PERIOD_KEY))
    return joined.select(*PERIOD_KEY, "year", "period_end", "field_name", "value")


@query(
    "j02_company_memberships",
    """SELECT symbol, index_symbol, index_name, CAST(row_number() OVER (PARTITION BY symbol
  ORDER BY market_cap DESC NULLS LAST, index_symbol) AS INTEGER) AS position
FROM constituents JOIN index_master USING (index_symbol)""",
)
def j02(t):
    return pages.company_indices(t.constituents, t.index_master)


@query(
    "j03_index_quotes_named",
    f"SELECT index_symbol, index_name, quote_date, {r6('close_price', 'change_pct')} "
    "FROM index_quotes JOIN index_master USING (index_symbol)",
)
def j03(t):
    # The dimension has one row per index, 25 here: Spark broadcasts it by its measured size.
    joined = t.index_quotes.drop("market_cap").join(t.index_master, "index_symbol")
    return rounded(joined.select("index_symbol", "index_name", "quote_date", "close_price", "change_pct"))


@query(
    "j04_company_quote",
    f"SELECT symbol, name, {r6('market_cap', 'current_price')} FROM company JOIN quote USING (symbol)",
)
def j04(t):
    joined = t.company.join(t.quote, "symbol")
    return rounded(joined.select("symbol", "name", "market_cap", "current_price"))


@query(
    "j05_group_companies",
    f"SELECT s.symbol, coalesce(sub_industry, sector, industry) AS peer_group, {r6('market_cap', 'pe')} FROM snapshot s",
)
def j05(t):
    grouped = pages.grouped_companies(snapshot_table(t), t.company)
    return rounded(grouped.select("symbol", "peer_group", "market_cap", "pe"))


@query(
    "j06_company_left_quote",
    f"SELECT symbol, name, sector, {r6('current_price', 'market_cap')} FROM company LEFT JOIN "
    "quote USING (symbol)",
)
def j06(t):
    joined = t.company.join(t.quote.select("symbol", "current_price", "market_cap"), "symbol", "left")
    return rounded(joined.select("symbol", "name", "sector", "current_price", "market_cap"))


MEMBER_FIGURES = r6(
    "current_price", "market_cap", "pe", "pb", "dividend_yield", "returnonequity", "returnoncapital", "net_profit",
    "sales", "change_pct",
)


@query(
    "j07_index_members",
    f"SELECT index_symbol, symbol, name, in_universe, {MEMBER_FIGURES}, sector FROM members",
)
def j07(t):
    return rounded(pages.index_members(t.constituents, snapshot_table(t), t.company))


@query(
    "j08_index_semi_join",
    f"SELECT symbol, {r6('pe', 'market_cap')} FROM screenable s WHERE pe < 30 AND EXISTS "
    "(SELECT 1 FROM memberships m WHERE m.symbol = s.symbol AND m.index_symbol IN ('NIF50', 'SENSEX'))",
)
def j08(t):
    found = screen.matches(snapshot_table(t), F.col("pe") < 30)
    inside = screen.in_index(found, memberships(t.constituents, t.company), ["NIF50", "SENSEX"])
    return rounded(inside.select("symbol", "pe", "market_cap"))


@query(
    "j09_index_anti_join",
    f"SELECT symbol, {r6('pe', 'market_cap')} FROM screenable s WHERE NOT EXISTS "
    "(SELECT 1 FROM memberships m WHERE m.symbol = s.symbol AND m.index_symbol IN ('NIF50', 'SENSEX'))",
)
def j09(t):
    found = screen.screenable(snapshot_table(t))
    beyond = screen.not_in_index(found, memberships(t.constituents, t.company), ["NIF50", "SENSEX"])
    return rounded(beyond.select("symbol", "pe", "market_cap"))


@query("j10_known_memberships", "SELECT symbol, index_symbol FROM memberships")
def j10(t):
    return memberships(t.constituents, t.company)


@query(
    "j11_close_years_ago",
    "SELECT symbol, latest, close_1y, close_3y, close_5y, close_10y FROM price_points",
)
def j11(t):
    return latest.closes_years_ago(t.prices)


@query("j12_snapshot_assembly", snapshot_sql())
def j12(t):
    return snapshot_frame(t)


@query(
    "j13_merged_aggregates",
    f"SELECT {KEY}, field_name, value FROM figures",
)
def j13(t):
    shown = statements.with_type_fallback(statements.last_periods(t.periods))
    return statements.merged_figures(shown, t.lines, t.basics)


@query(
    "j14_type_fallback",
    f"SELECT {KEY}, year, period_end FROM shown_periods",
)
def j14(t):
    shown = statements.with_type_fallback(statements.last_periods(t.periods))
    return shown.select(*PERIOD_KEY, "year", "period_end")


@query("j15_index_list_lookups", LISTING_SQL)
def j15(t):
    return listing_frame(t)
