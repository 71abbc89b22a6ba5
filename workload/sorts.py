"""Sorts, limits, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselight.plans import monitor, pages, quality, screen
from bourselight.plans.paging import StoredOrder, next_page
from bourselight.session import new_table_path
from workload.registry import query, r6, rounded, snapshot_table

QUOTES = "(SELECT * FROM company LEFT JOIN quote USING (symbol))"


def _quotes(t):
    return t.company.join(t.quote, "symbol", "left")


@query(
    "l01_order_nulls_last",
    f"""SELECT symbol, {r6('current_price', 'market_cap')}, row_number() OVER (ORDER BY current_price DESC NULLS LAST,
  symbol) <= 100 AS first_page FROM {QUOTES}""",
)
def l01(t):
    first = screen.ordered(_quotes(t), "Current price").limit(100).select("symbol", F.lit(True).alias("first_page"))
    marked = _quotes(t).join(first, "symbol", "left").withColumn(
        "first_page", F.coalesce("first_page", F.lit(False))
    )
    rows = screen.ordered(marked, "Current price")
    return rounded(rows.select("symbol", "current_price", "market_cap", "first_page"))


@query(
    "l02_page",
    f"SELECT symbol, name, {r6('market_cap')} FROM {QUOTES} WHERE market_cap IS NOT NULL "
    "ORDER BY name ASC NULLS LAST, symbol LIMIT 50 OFFSET 100",
)
def l02(t):
    offset, size = screen.page_bounds(3, 50, None)
    rows = screen.ordered(screen.screenable(_quotes(t)), "name", descending=False).offset(offset).limit(size)
    return rounded(rows.select("symbol", "name", "market_cap"))


@query(
    "l03_row_cap",
    f"""SELECT symbol, name, {r6('market_cap')}, (SELECT count(*) FROM {QUOTES} WHERE market_cap IS NOT NULL) AS total,
  (SELECT count(*) FROM {QUOTES} WHERE market_cap IS NOT NULL) > 25 AS capped
FROM {QUOTES} WHERE market_cap IS NOT NULL ORDER BY market_cap DESC, symbol LIMIT 5 OFFSET 20""",
)
def l03(t):
    found = screen.screenable(_quotes(t))
    page = screen.paged(found, ["name", "market_cap"], page=3, page_size=10, row_cap=screen.PUBLIC_ROW_CAP)
    return rounded(page)


def _deep(page: int, size: int, cap: int | None) -> str:
    upto = "" if cap is None else f" AND n <= {cap}"
    return (
        f"SELECT '{page}' AS page, symbol, name, {r6('market_cap')}, total, {'false' if cap is None else f'total > {cap}'} AS capped "
        f"FROM numbered WHERE n > {(page - 1) * size} AND n <= {page * size}{upto}"
    )


_PAGES = ((1, 7, None), (12, 7, None), (3, 20, 45), (1000, 5, None))


@query(
    "l11_stored_order",
    f"""WITH numbered AS (SELECT *, row_number() OVER (ORDER BY name ASC NULLS LAST, symbol) AS n, count(*) OVER () AS total
  FROM {QUOTES} WHERE market_cap IS NOT NULL)
"""
    + "\nUNION ALL ".join(_deep(*p) for p in _PAGES),
)
def l11(t):
    """Early and deep pages of one screen, read as ranges of its stored order."""
    found = screen.screenable(_quotes(t))
    order = StoredOrder.write(found, new_table_path(t.spark, "order"), ["name", "market_cap"], "name", descending=False)
    pages_ = [order.page(*p).withColumn("page", F.lit(str(p[0]))) for p in _PAGES]
    return rounded(reduce(DataFrame.unionByName, pages_))


@query(
    "l12_key_pages",
    f"SELECT symbol, name, {r6('market_cap')} FROM {QUOTES} WHERE market_cap IS NOT NULL ORDER BY name ASC NULLS LAST, symbol LIMIT 30 OFFSET 30",
)
def l12(t):
    """The second page of a screen from the last key of the first."""
    found = screen.screenable(_quotes(t))
    last = next_page(found, None, "name", descending=False, page_size=30).collect()[-1]
    rows = next_page(found, (last["name"], last["symbol"]), "name", descending=False, page_size=30)
    return rounded(rows.select("symbol", "name", "market_cap"))


@query(
    "l04_largest",
    f"SELECT symbol, name, {r6('market_cap')}, (SELECT count(*) FROM company) AS total FROM company "
    "JOIN quote USING (symbol) ORDER BY market_cap DESC NULLS LAST, symbol LIMIT 50",
)
def l04(t):
    return rounded(pages.largest(t.company, t.quote))


@query(
    "l05_movers",
    f"""SELECT side, CAST(position AS INTEGER) AS position, index_symbol, index_name,
  {r6('close_price', 'change_pct')} FROM (
  SELECT 'gainer' AS side, row_number() OVER (ORDER BY change_pct DESC, index_symbol) AS position, *
  FROM newest_index_quotes WHERE change_pct IS NOT NULL
  UNION ALL
  SELECT 'loser', row_number() OVER (ORDER BY change_pct ASC, index_symbol), *
  FROM newest_index_quotes WHERE change_pct IS NOT NULL) m
JOIN (SELECT index_symbol, index_name FROM index_master) USING (index_symbol) WHERE position <= 10""",
)
def l05(t):
    return rounded(pages.movers(t.index_quotes, t.index_master))


@query(
    "l06_recent_prices",
    "SELECT symbol, quote_date, close, volume FROM sessions WHERE position <= 2000",
)
def l06(t):
    recent = pages.recent_prices(t.prices)
    return recent.select("symbol", "quote_date", "close", "volume").orderBy("symbol", "quote_date")


@query(
    "l07_newest_logs",
    """SELECT 'warnings' AS list, id, level, message FROM (SELECT * FROM logs WHERE level = 'WARNING'
  ORDER BY id DESC LIMIT 500)
UNION ALL SELECT 'last error', id, level, message FROM (SELECT * FROM logs WHERE level = 'ERROR'
  ORDER BY id DESC LIMIT 1)
UNION ALL SELECT 'runs', run_id, NULL, NULL FROM (SELECT * FROM runs ORDER BY started_at DESC LIMIT 10)""",
)
def l07(t):
    shown = ["list", "id", "level", "message"]
    warnings = monitor.newest_logs(t.logs, "warning", limit=monitor.MAX_LOG_ROWS).withColumn("list", F.lit("warnings"))
    last = monitor.newest_logs(t.logs, "ERROR", limit=1).withColumn("list", F.lit("last error"))
    runs = monitor.newest_runs(t.runs).select(
        F.lit("runs").alias("list"), F.col("run_id").cast("bigint").alias("id"),
        F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("message"),
    )
    return warnings.select(*shown).unionByName(last.select(*shown)).unionByName(runs)


@query(
    "l08_first_failures",
    """SELECT run_id, symbol, endpoint, task_id, CAST(row_number() OVER (PARTITION BY run_id
  ORDER BY symbol, endpoint, task_id) AS INTEGER) AS position FROM tasks WHERE status = 'failed' QUALIFY position <= 20""",
)
def l08(t):
    return monitor.first_failures(t.tasks).drop("status")


@query(
    "l09_member_order",
    f"SELECT index_symbol, symbol, {r6('pe', 'market_cap')} FROM members",
)
def l09(t):
    members = pages.index_members(t.constituents, snapshot_table(t), t.company)
    rows = pages.members_in_order(members, "pe", ascending=True)
    return rounded(rows.select("index_symbol", "symbol", "pe", "market_cap"))


@query(
    "l10_key_sample",
    """SELECT string_agg(symbol, '|' ORDER BY symbol) AS sample FROM (SELECT DISTINCT symbol FROM constituents
  WHERE symbol NOT IN (SELECT symbol FROM company) ORDER BY symbol LIMIT 10)""",
)
def l10(t):
    return quality.sample(quality.outside(t.constituents, t.company))
