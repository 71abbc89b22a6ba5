"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselight.operators import classify, latest, merge
from bourselight.operators.spread import exact_median, lookup
from bourselight.plans import monitor, pages, quality, snapshot, statements
from bourselight.sources.testbed import AS_OF
from workload.damage import damaged_prices, DAMAGED_PRICES
from workload.registry import query, r6, rounded, snapshot_table

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query(
    "a01_archive_summary",
    "SELECT count(*) AS raw_responses, count(DISTINCT symbol) AS distinct_symbols, "
    "CAST(max(fetched_at) AS DATE) AS last_fetched_on, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) "
    "AS uncompressed_bytes FROM archive",
)
def a01(t):
    out = monitor.archive_summary(t.archive)
    return out.withColumn("last_fetched_on", F.col("last_fetched_at").cast("date")).drop("last_fetched_at")


_COUNTED = {
    "companies": "company", "quotes": "quote", "statement_periods": "periods", "statement_lines": "lines",
    "price_days": "prices", "indices": "index_master", "index_constituents": "constituents",
    "index_returns": "index_returns",
}


@query(
    "a02_table_counts",
    "\nUNION ALL ".join(f'SELECT \'{n}\' AS "table", count(*) AS "rows" FROM {cte}' for n, cte in _COUNTED.items()),
)
def a02(t):
    return monitor.table_counts({n: getattr(t, cte) for n, cte in _COUNTED.items()})


@query(
    "a03_screen_total",
    "SELECT count(*) AS total FROM company JOIN quote USING (symbol) "
    "WHERE market_cap IS NOT NULL AND current_price > 950 AND market_cap > 2000",
)
def a03(t):
    from bourselight.plans.screen import matches

    found = matches(t.company.join(t.quote, "symbol"), (F.col("current_price") > 950) & (F.col("market_cap") > 2000))
    return found.agg(F.count("*").alias("total"))


@query(
    "a04_constituent_counts",
    "SELECT index_symbol, count(*) AS constituents FROM constituents GROUP BY index_symbol",
)
def a04(t):
    return t.constituents.groupBy("index_symbol").agg(F.count("*").alias("constituents"))


@query(
    "a05_exact_median",
    "SELECT l_returnflag AS flag, round(median(l_extendedprice), 6) AS median, count(l_extendedprice) AS count "
    "FROM lineitem GROUP BY 1 "
    "UNION ALL SELECT 'all', round(median(l_extendedprice), 6), count(l_extendedprice) FROM lineitem",
)
def a05(t):
    lines = t.table("lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    per_flag = exact_median(lines, ["flag"], "l_extendedprice")
    overall = exact_median(lines, [], "l_extendedprice").withColumn("flag", F.lit("all"))
    return rounded(per_flag.unionByName(overall))


@query(
    "a06_index_medians",
    """SELECT index_symbol, round(median(pe) FILTER (WHERE net_profit IS NOT NULL AND pe > 0), 6) AS median_pe,
  round(median(pb) FILTER (WHERE net_profit IS NOT NULL AND pb > 0), 6) AS median_pb,
  round(median(dividend_yield) FILTER (WHERE net_profit IS NOT NULL), 6) AS median_dividend_yield,
  round(median(returnonequity) FILTER (WHERE net_profit IS NOT NULL), 6) AS median_returnonequity
FROM members GROUP BY index_symbol""",
)
def a06(t):
    return rounded(pages.index_medians(pages.index_members(t.constituents, snapshot_table(t), t.company)))


PEER_MEDIANS_SQL = """SELECT peer_group, round(median(pe) FILTER (WHERE pe > 0), 6) AS median_pe,
  round(median(market_cap), 6) AS median_market_cap, round(median(dividend_yield), 6) AS median_dividend_yield,
  round(median(returnonequity), 6) AS median_returnonequity,
  round(median(returnoncapital), 6) AS median_returnoncapital
FROM peer_rows GROUP BY peer_group"""


@query("a07_peer_medians", PEER_MEDIANS_SQL)
def a07(t):
    return rounded(pages.peer_medians(pages.peer_sets(snapshot_table(t), t.company)))


@query(
    "a08_index_coverage",
    """SELECT index_symbol, count(*) AS count, count(net_profit) AS with_fundamentals,
  count(*) FILTER (WHERE NOT in_universe) AS outside_universe FROM members GROUP BY index_symbol""",
)
def a08(t):
    return pages.index_coverage(pages.index_members(t.constituents, snapshot_table(t), t.company))


@query("a09_trailing_dividends", f"SELECT symbol, {r6('dividend')} FROM dividends")
def a09(t):
    return rounded(latest.trailing_dividends(t.actions, F.lit(AS_OF).cast("date")))


@query("a10_traded_value", f"SELECT symbol, {r6('avg_traded_value_30d')} FROM moving")
def a10(t):
    return rounded(latest.moving_figures(t.prices).select("symbol", "avg_traded_value_30d"))


@query("a11_moving_averages", f"SELECT symbol, {r6('dma_50', 'dma_200', 'price_to_dma200')} FROM moving")
def a11(t):
    return rounded(latest.moving_figures(t.prices).drop("avg_traded_value_30d"))


@query(
    "a12_holder_totals",
    """SELECT symbol, period_label, sum(total_shareholders) AS value FROM shareholding
WHERE total_shareholders <> 0 GROUP BY symbol, period_label
QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY strptime(period_label, '%b %Y') DESC) <= 16""",
)
def a12(t):
    return statements.holder_totals(statements.last_quarters(t.shareholding)).drop("position")


@query(
    "a13_level_counts",
    f"SELECT level, count(*) AS total, count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 24 HOUR) AS last_24h "
    "FROM logs GROUP BY level",
)
def a13(t):
    return monitor.counts_by_level(t.logs, F.expr(NOW))


@query(
    "a14_task_counts",
    """SELECT run_id, count(*) FILTER (WHERE status = 'done') AS done,
  count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status NOT IN ('done', 'skipped', 'failed') OR status IS NULL) AS other
FROM tasks GROUP BY run_id""",
)
def a14(t):
    return monitor.task_counts(t.tasks)


@query(
    "a15_symbols_per_run",
    """SELECT run_id, count(DISTINCT symbol) AS symbols_done, max(planned) AS symbols_total
FROM tasks JOIN runs USING (run_id) GROUP BY run_id""",
)
def a15(t):
    done = monitor.symbols_done(t.tasks)
    planned = t.runs.select("run_id", monitor.planned_symbols(F.col("scope")).alias("symbols_total"))
    return done.join(planned, "run_id")


@query(
    "a17_company_family",
    """SELECT symbol, schema_kind FROM periods WHERE statement_code = 'pl' AND schema_kind <> 'unknown'
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC, year DESC, schema_kind) = 1""",
)
def a17(t):
    return merge.newest_schema_kind(t.periods)


@query(
    "a18_action_lists",
    """SELECT symbol, action, row_number() OVER (PARTITION BY symbol, action ORDER BY ex_date DESC, subject)
  AS position, ex_date, subject, round(amount, 6) AS amount FROM actions""",
)
def a18(t):
    return rounded(pages.action_lists(t.actions))


# Field sets: the fields that a symbol ever reports with a figure.
FIELD_SETS = """SELECT symbol, string_agg(field_name, ',' ORDER BY field_name) AS fields, count(*) AS n
FROM (SELECT DISTINCT symbol, field_name FROM lines WHERE value IS NOT NULL) GROUP BY symbol"""


def reported_lines(t):
    return t.lines.where(F.col("value").isNotNull())


@query("a19_field_sets", f"SELECT symbol, fields, n FROM ({FIELD_SETS})")
def a19(t):
    sets = classify.field_sets(reported_lines(t))
    return sets.select("symbol", F.array_join("fields", ",").alias("fields"), F.size("fields").cast("bigint").alias("n"))


@query(
    "a20_schema_clusters",
    f"""WITH sets AS ({FIELD_SETS}) SELECT symbol, fields AS signature, count(*) OVER (PARTITION BY fields) AS size,
  min(symbol) OVER (PARTITION BY fields) AS first_symbol, max(symbol) OVER (PARTITION BY fields) AS last_symbol
FROM sets""",
)
def a20(t):
    sets = classify.field_sets(reported_lines(t))
    clusters = classify.clusters(sets)
    signed = sets.select("symbol", F.array_join("fields", ",").alias("signature"))
    return lookup(signed, clusters, ["signature"], ["symbol"], how="inner")


@query(
    "a21_snapshot_counts",
    """SELECT count(*) AS companies,
  count(*) FILTER (WHERE net_profit IS NOT NULL OR sales IS NOT NULL) AS with_fundamentals,
  (SELECT count(*) FROM memberships) AS index_links, CAST(118 AS BIGINT) AS columns FROM snapshot""",
)
def a21(t):
    return snapshot.snapshot_counts(snapshot_table(t), snapshot.memberships(t.constituents, t.company))


@query(
    "a22_bad_price_symbols",
    f"SELECT symbol, count(*) AS bad_rows FROM ({DAMAGED_PRICES}) WHERE close <= 0 GROUP BY symbol "
    "ORDER BY bad_rows DESC, symbol LIMIT 10",
)
def a22(t):
    return quality.bad_price_symbols(damaged_prices(t))
