"""Latest per key, rankings and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselight.operators import latest
from bourselight.operators.normalise import PERIOD_KEY
from bourselight.plans import monitor, pages, statements
from workload.registry import names, query, r6, rounded, snapshot_table


@query("w01_ranked_latest", "SELECT symbol, statement_code, field_name, value FROM latest_lines")
def w01(t):
    return latest.latest_statement_values(latest.usable_statement_lines(t.lines))


@query(
    "w02_latest_series",
    """SELECT 'basic' AS series, symbol, statement_code AS family, field_name, value FROM latest_basics
UNION ALL SELECT 'ratio', symbol, family, field_name, value FROM latest_ratios""",
)
def w02(t):
    basics = latest.latest_series_values(t.basics, "statement_code").withColumnRenamed("statement_code", "family")
    ratios = latest.latest_series_values(t.ratios, "family")
    named = lambda df, n: df.withColumn("series", F.lit(n))
    return named(basics, "basic").unionByName(named(ratios, "ratio"))


@query(
    "w03_last_sessions",
    "SELECT symbol, quote_date, close, CAST(position AS INTEGER) AS position FROM sessions "
    "WHERE position <= 30",
)
def w03(t):
    return latest.last_sessions(t.prices.select("symbol", "quote_date", "close"), 30)


@query("w04_preferred_metrics", f"SELECT symbol, family, field_name, {r6('value')} FROM latest_metrics")
def w04(t):
    return rounded(latest.preferred_metrics(t.metrics))


@query(
    "w05_top_of_group",
    f"SELECT peer_group, symbol, {r6('market_cap', 'pe')} FROM peer_rows",
)
def w05(t):
    peers = pages.peer_sets(snapshot_table(t), t.company)
    return rounded(peers.select("peer_group", "symbol", "market_cap", "pe"))


@query("w06_latest_valuation", f"SELECT symbol, {r6('pe', 'pb', 'ptb', 'ps', 'pfcf')} FROM valuation")
def w06(t):
    return rounded(latest.latest_valuation(t.price_ratios))


@query(
    "w07_latest_shareholding",
    f"SELECT symbol, {r6('promoter_holding', 'promoter_pledge', 'public_holding')} FROM holdings",
)
def w07(t):
    return rounded(latest.latest_shareholding(t.shareholding))


@query(
    "w08_search_rank",
    """SELECT symbol, name, CAST(rank AS INTEGER) AS rank FROM (SELECT symbol, name,
  CASE WHEN upper(symbol) = '19' THEN 0 WHEN starts_with(upper(symbol), '19') THEN 1
    WHEN starts_with(upper(name), '19') THEN 2
    WHEN contains(upper(symbol), '19') OR contains(upper(name), '19') THEN 3 END AS rank FROM company)
WHERE rank IS NOT NULL""",
)
def w08(t):
    ranked = t.company.select("symbol", "name", pages.search_rank(F.col("symbol"), F.col("name"), " 19 ").alias("rank"))
    return ranked.where(F.col("rank").isNotNull())


@query(
    "w09_download_order",
    """SELECT symbol, CAST(CASE WHEN symbol IN (SELECT symbol FROM constituents WHERE index_symbol IN
    ('NIF50', 'NIFTY50', 'SNSXLRGCAP', 'NIF100', 'NIF500', 'BSE500', 'BSE100', 'BSE200')) THEN 0
  WHEN symbol IN (SELECT symbol FROM constituents) THEN 1 ELSE 2 END AS INTEGER) AS tier,
  round(coalesce(market_cap, 0), 6) AS cap FROM company LEFT JOIN quote USING (symbol)""",
)
def w09(t):
    placed = pages.download_order(t.company, t.constituents, t.quote)
    return rounded(placed).orderBy("tier", F.desc("cap"), "symbol")


@query(
    "w10_well_known_order",
    """SELECT index_symbol, index_name, CAST(coalesce(list_position(['NIF50', 'NIFTY50', 'SENSEX', 'BSESN', 'NIF100',
  'NIF200', 'NIF500', 'BSE100', 'BSE200', 'BSE500', 'NIFTYNEXT50', 'NIFMIDCAP100', 'NIFSMLCAP100', 'NIFBANK',
  'NIFTYIT', 'SNSXLRGCAP'], index_symbol), 17) AS INTEGER) AS place, count(*) OVER () AS total FROM index_master""",
)
def w10(t):
    placed = t.index_master.select(
        "index_symbol", "index_name", pages.well_known_rank(F.col("index_symbol")).alias("place")
    )
    return pages.listed_in_order(placed)


@query(
    "w11_last_periods",
    f"SELECT {names(PERIOD_KEY)}, period_end, CAST(position AS INTEGER) AS position FROM recent_periods",
)
def w11(t):
    return statements.last_periods(t.periods).select(*PERIOD_KEY, "period_end", "position")


@query(
    "w12_last_quarters",
    f"""SELECT symbol, period_label, group_name, {r6('shareholding_pct')}, CAST(dense_rank() OVER (PARTITION BY symbol
  ORDER BY strptime(period_label, '%b %Y') DESC) AS INTEGER) AS position FROM shareholding QUALIFY position <= 16""",
)
def w12(t):
    recent = statements.last_quarters(t.shareholding)
    return rounded(recent.select("symbol", "period_label", "group_name", "shareholding_pct", "position"))


@query(
    "w13_trimmed_log",
    "SELECT id, level, message FROM logs QUALIFY row_number() OVER (ORDER BY id DESC) <= 2000",
)
def w13(t):
    return monitor.trim_logs(t.logs).select("id", "level", "message")


@query(
    "w14_return_shares",
    """SELECT index_symbol, horizon, round(return_pct, 6) AS return_pct,
  round(abs(return_pct) / greatest(max(abs(return_pct)) OVER (PARTITION BY index_symbol), 1), 6) AS share,
  return_pct < 0 AS negative FROM index_returns""",
)
def w14(t):
    return rounded(pages.return_shares(t.index_returns))


@query(
    "w15_series_trends",
    """SELECT symbol, statement_type, statement_code, period_kind, field_name, count(*) AS points,
  arg_min(value, period_end) AS first, arg_max(value, period_end) AS last, min(value) AS low,
  max(value) AS high, arg_max(value, period_end) >= arg_min(value, period_end) AS rising,
  min(value) < 0 AND max(value) > 0 AS crosses_zero
FROM lines JOIN periods USING (symbol, statement_type, statement_code, period_kind, header)
WHERE value IS NOT NULL GROUP BY symbol, statement_type, statement_code, period_kind, field_name HAVING count(*) >= 3""",
)
def w15(t):
    day = t.lines.withColumn("day", F.unix_date("period_end"))
    return pages.trends(day, ["symbol", "statement_type", "statement_code", "period_kind", "field_name"], "day")
