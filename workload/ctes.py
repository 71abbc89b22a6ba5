"""SQL for the Layer 2 tables over the benchmark tables, as common table expressions.

`with_ctes` puts the expressions that a query mentions, and those they mention themselves, in front of it.
"""

from __future__ import annotations

import re

from bourselight.sources.testbed import (
    AS_OF,
    BASIC_FIELDS,
    METRIC_FIELDS,
    RATIO_FIELDS,
    STATEMENT_FIELDS,
)


def _unpivot(source: str, keys: str, group: str, fields: dict, grouped: bool) -> str:
    """One SELECT per field; `grouped` tells whether the source already carries the group column."""
    parts = []
    for g, per_group in fields.items():
        for field, expression in per_group.items():
            where = f" WHERE {group} = '{g}'" if grouped else ""
            parts.append(
                f"SELECT {keys}, '{g}' AS {group}, '{field}' AS field_name, "
                f"CAST({expression} AS DOUBLE) AS value FROM {source}{where}"
            )
    return "\nUNION ALL ".join(parts)


SUPPLY_KEYS = """CAST(l_suppkey AS VARCHAR) AS symbol,
  CASE l_linestatus WHEN 'O' THEN 'c' ELSE 's' END AS statement_type"""

SUMS = """sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS e, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q,
  sum(CAST(l_discount AS DECIMAL(18,2))) AS d, sum(CAST(l_tax AS DECIMAL(18,2))) AS t"""

EXTREMES = """max(l_discount) AS max_d, min(l_discount) AS min_d, max(l_tax) AS max_t,
  max(l_quantity) AS max_q, min(l_quantity) AS min_q, count(*) AS n"""

CTES: dict[str, str] = {
    "company": """
SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name, concat('NSE', p_partkey) AS nse_code,
  CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey + 500000 AS VARCHAR) END AS bse_code,
  CASE WHEN p_size > 25 THEN 'Industrials' ELSE 'Consumer' END AS macro_sector, p_type AS industry,
  CASE WHEN p_size % 11 <> 0 THEN p_brand END AS sector,
  CASE WHEN p_size % 7 <> 0 THEN concat(p_brand, '/', p_size % 3) END AS sub_industry,
  CAST(NULL AS VARCHAR) AS schema_kind
FROM part""",
    "quote": """
SELECT CAST(p_partkey AS VARCHAR) AS symbol,
  CASE WHEN p_size % 13 <> 0 THEN p_retailprice END AS current_price,
  CASE WHEN p_size % 17 <> 0 THEN cap END AS market_cap, volume, high52, low52,
  CAST(p_size - 25 AS DOUBLE) AS change_pct, CAST(n AS DOUBLE) AS shares
FROM part LEFT JOIN (
  SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 199 AS cap,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
    max(l_extendedprice / l_quantity) AS high52, min(l_extendedprice / l_quantity) AS low52, count(*) AS n
  FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""",
    "prices": """
SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS quote_date,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
    / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  min(l_extendedprice / l_quantity) AS open,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume
FROM lineitem GROUP BY 1, 2""",
    "quarters": f"""
SELECT {SUPPLY_KEYS},
  CASE l_returnflag WHEN 'A' THEN 'pl' WHEN 'N' THEN 'bs' ELSE 'cf' END AS statement_code,
  last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, {SUMS}
FROM lineitem GROUP BY 1, 2, 3, 4""",
    "statement_wide": """
SELECT symbol, statement_type, statement_code, period_kind, header, year, CAST(period_end AS DATE) AS period_end,
  CAST(e AS DOUBLE) * CAST(1234567.89 AS DOUBLE) AS e, CAST(q AS DOUBLE) * CAST(1234567.89 AS DOUBLE) AS q,
  CAST(d AS DOUBLE) * CAST(1234567.89 AS DOUBLE) AS d, CAST(t AS DOUBLE) * CAST(1234567.89 AS DOUBLE) AS t
FROM (
  SELECT symbol, statement_type, statement_code, 'quarterly' AS period_kind,
    strftime(period_end, '%b %Y') AS header, year(period_end) AS year, period_end, e, q, d, t FROM quarters
  UNION ALL
  SELECT symbol, statement_type, statement_code, 'annual', concat('Mar ', year(period_end)), year(period_end),
    make_date(year(period_end), 3, 31), sum(e), sum(q), sum(d), sum(t)
  FROM quarters GROUP BY symbol, statement_type, statement_code, year(period_end)
  UNION ALL
  SELECT symbol, statement_type, statement_code, 'ttm', 'TTM', max(year(period_end)), max(period_end),
    sum(e), sum(q), sum(d), sum(t)
  FROM quarters WHERE month(period_end) > 6 GROUP BY symbol, statement_type, statement_code)""",
    "periods": """
SELECT symbol, statement_type, statement_code, period_kind, header, year, period_end,
  CAST(period_end + INTERVAL 45 DAY AS DATE) AS result_date,
  CASE WHEN statement_code = 'pl' AND year % 2 = 1 THEN 'general' ELSE 'unknown' END AS schema_kind
FROM statement_wide""",
    "lines": _unpivot(
        "statement_wide", "symbol, statement_type, period_kind, header", "statement_code", STATEMENT_FIELDS, True
    ),
    "basics": _unpivot(
        "(SELECT * FROM statement_wide WHERE period_kind <> 'quarterly')",
        "symbol, statement_type, header, year", "statement_code", BASIC_FIELDS, True,
    ),
    "ratio_extremes": f"""
SELECT {SUPPLY_KEYS}, year(l_shipdate) AS year, concat('Mar ', year(l_shipdate)) AS header, {EXTREMES}
FROM lineitem GROUP BY 1, 2, 3, 4
UNION ALL SELECT {SUPPLY_KEYS}, max(year(l_shipdate)), 'TTM', {EXTREMES} FROM lineitem GROUP BY 1, 2""",
    "metric_extremes": f"SELECT {SUPPLY_KEYS}, {EXTREMES} FROM lineitem GROUP BY 1, 2",
    "ratios": _unpivot("ratio_extremes", "symbol, statement_type, header, year", "family", RATIO_FIELDS, False),
    "metrics": _unpivot("metric_extremes", "symbol, statement_type", "family", METRIC_FIELDS, False),
    "price_ratios": """
SELECT CAST(o_custkey AS VARCHAR) AS symbol, CASE o_orderstatus WHEN 'F' THEN 's' ELSE 'c' END AS statement_type,
  CAST(o_orderdate AS DATE) AS quote_date,
  CASE WHEN max(o_orderkey) % 10 <> 0 THEN max(o_totalprice) / 10007 END AS pe, min(o_totalprice) / 200003 AS pb,
  min(o_totalprice) / 100003 AS ptb, max(o_totalprice) / 50021 AS ps, max(o_totalprice) / 20011 AS pfcf
FROM orders GROUP BY 1, 2, 3""",
    "actions": """
SELECT CAST(o_custkey AS VARCHAR) AS symbol,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'split' WHEN '2-HIGH' THEN 'bonus' ELSE 'dividend' END AS action,
  CAST(o_orderdate AS DATE) AS ex_date, CAST(o_orderkey AS VARCHAR) AS subject, o_totalprice / 10000 AS amount
FROM orders""",
    "shareholding": """
SELECT CAST(c_nationkey AS VARCHAR) AS symbol,
  strftime(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH, '%b %Y') AS period_label,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'promoterAndPromoterGroup' WHEN '2-HIGH' THEN 'publicShareholding'
    WHEN '3-MEDIUM' THEN 'nonPromoterNonPublic' ELSE o_orderpriority END AS group_name,
  max(o_totalprice) / 10000 AS shareholding_pct, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS total_shareholders,
  min(o_totalprice) / 5000 AS pledged_pct
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "nations": """
SELECT n_nationkey, n_regionkey, CASE n_nationkey WHEN 0 THEN 'NIF50' WHEN 1 THEN 'SENSEX' WHEN 2 THEN 'NIF100'
  WHEN 3 THEN 'NIFBANK' WHEN 4 THEN 'BSE500' ELSE n_name END AS index_symbol
FROM nation""",
    "index_master": """
SELECT index_symbol, concat('Index ', index_symbol) AS index_name,
  CASE WHEN n_nationkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange,
  CASE WHEN n_nationkey % 3 = 0 THEN 'broad' ELSE 'sector' END AS index_type,
  CASE WHEN r_name <> 'ASIA' THEN r_name ELSE '' END AS index_sub_type, market_cap
FROM nations JOIN region ON n_regionkey = r_regionkey LEFT JOIN (
  SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS market_cap
  FROM customer GROUP BY c_nationkey) ON n_nationkey = c_nationkey""",
    "constituents": """
SELECT DISTINCT index_symbol, CAST(CASE WHEN l_orderkey % 50 = 0 THEN l_partkey + 1000000 ELSE l_partkey END
  AS VARCHAR) AS symbol
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = n_nationkey""",
    "nation_orders": """
SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nations ON c_nationkey = n_nationkey""",
    "index_quotes": """
SELECT index_symbol, CAST(o_orderdate AS DATE) AS quote_date, max(o_totalprice) AS close_price,
  min(c_acctbal) / 100 AS change_pct,
  CASE WHEN max(o_orderkey) % 7 <> 0 THEN max(o_totalprice) / 20011 ELSE 0 END AS pe,
  CASE WHEN max(o_orderkey) % 7 <> 0 THEN max(o_totalprice) / 100003 ELSE 0 END AS pb,
  min(o_totalprice) / 100003 AS div_yield,
  CASE WHEN min(o_orderkey) % 5 <> 0 THEN max(o_totalprice) * 10 ELSE 0 END AS market_cap
FROM nation_orders GROUP BY 1, 2""",
    "index_returns": """
SELECT index_symbol, ['1M', '3M', '6M', '1Y', '3Y', '5Y', '7Y', '10Y'][year(o_orderdate) % 8 + 1] AS horizon, min(c_acctbal) / 100 AS return_pct
FROM nation_orders GROUP BY 1, 2""",
    "archive": """
SELECT event_type AS endpoint, CAST(user_id AS VARCHAR) AS symbol, props AS payload, ts AS fetched_at,
  event_id AS id, CAST(length(props) AS BIGINT) AS size_bytes
FROM events""",
    "logs": """
SELECT event_id AS id, ts AS created_at,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
  concat('app.', event_type) AS logger, concat('user ', user_id, ' token=', event_id) AS message
FROM events""",
    "tasks": """
SELECT event_id AS task_id, CAST(day(ts) AS INTEGER) AS run_id, CAST(user_id AS VARCHAR) AS symbol,
  event_type AS endpoint,
  CASE WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_id % 23 = 0 THEN 'running' ELSE 'done' END AS status
FROM events""",
    "runs": """
SELECT CAST(day(ts) AS INTEGER) AS run_id, min(ts) AS started_at, CAST(max(user_id) + 1 AS BIGINT) AS planned
FROM events GROUP BY 1""",
    # Ranked picks and price figures.
    "ranked_lines": """
SELECT l.*, p.year, p.period_end,
  CASE l.statement_type WHEN 'c' THEN 100 ELSE 0 END + CASE l.period_kind WHEN 'ttm' THEN 50 ELSE 0 END
    + coalesce(p.year, 0) AS rank
FROM lines l JOIN periods p USING (symbol, statement_type, statement_code, period_kind, header)
WHERE l.period_kind IN ('ttm', 'annual') AND l.value IS NOT NULL""",
    "latest_lines": """
SELECT symbol, statement_code, field_name, value FROM ranked_lines
QUALIFY row_number() OVER (PARTITION BY symbol, statement_code, field_name ORDER BY rank DESC, period_end DESC) = 1""",
    "latest_basics": """
SELECT symbol, statement_code, field_name, value FROM basics WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY symbol, statement_code, field_name ORDER BY
  CASE statement_type WHEN 'c' THEN 100 ELSE 0 END + CASE header WHEN 'TTM' THEN 50 ELSE 0 END + year DESC) = 1""",
    "latest_ratios": """
SELECT symbol, family, field_name, value FROM ratios WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY symbol, family, field_name ORDER BY
  CASE statement_type WHEN 'c' THEN 100 ELSE 0 END + CASE header WHEN 'TTM' THEN 50 ELSE 0 END + year DESC) = 1""",
    "latest_metrics": """
SELECT symbol, family, field_name, value FROM metrics WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY symbol, family, field_name ORDER BY statement_type) = 1""",
    "valuation": """
SELECT symbol, pe, pb, ptb, ps, pfcf FROM price_ratios
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY quote_date DESC, statement_type) = 1""",
    "holdings": """
SELECT symbol, max(shareholding_pct) FILTER (WHERE group_name = 'promoterAndPromoterGroup') AS promoter_holding,
  max(pledged_pct) FILTER (WHERE group_name = 'promoterAndPromoterGroup') AS promoter_pledge,
  max(shareholding_pct) FILTER (WHERE group_name = 'publicShareholding') AS public_holding
FROM (SELECT *, strptime(period_label, '%b %Y') AS m FROM shareholding
  QUALIFY m = max(m) OVER (PARTITION BY symbol)) GROUP BY symbol""",
    "dividends": f"""
SELECT symbol, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS dividend FROM actions
WHERE action = 'dividend' AND amount <> 0 AND ex_date > DATE '{AS_OF}' - INTERVAL 1 YEAR
  AND ex_date <= DATE '{AS_OF}' GROUP BY symbol""",
    "price_points": """
SELECT symbol, max(close) FILTER (WHERE quote_date = last_date) AS latest,
  arg_max(close, quote_date) FILTER (WHERE last_date - quote_date BETWEEN 365 AND 401) AS close_1y,
  arg_max(close, quote_date) FILTER (WHERE last_date - quote_date BETWEEN 1096 AND 1205) AS close_3y,
  arg_max(close, quote_date) FILTER (WHERE last_date - quote_date BETWEEN 1826 AND 2008) AS close_5y,
  arg_max(close, quote_date) FILTER (WHERE last_date - quote_date BETWEEN 3652 AND 4017) AS close_10y
FROM (SELECT *, max(quote_date) OVER (PARTITION BY symbol) AS last_date FROM prices WHERE close IS NOT NULL)
GROUP BY symbol""",
    "cagr": """
SELECT symbol, (power(latest / close_1y, CAST(1 AS DOUBLE) / 1) - 1) * 100 AS price_cagr_1y,
  (power(latest / close_3y, CAST(1 AS DOUBLE) / 3) - 1) * 100 AS price_cagr_3y,
  (power(latest / close_5y, CAST(1 AS DOUBLE) / 5) - 1) * 100 AS price_cagr_5y,
  (power(latest / close_10y, CAST(1 AS DOUBLE) / 10) - 1) * 100 AS price_cagr_10y
FROM price_points""",
    "sessions": """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY quote_date DESC) AS position FROM prices""",
    "moving": """
SELECT symbol, CASE WHEN n >= 50 THEN s50 / 50 END AS dma_50, CASE WHEN n >= 200 THEN s200 / 200 END AS dma_200,
  CASE WHEN n >= 200 AND s200 > 0 THEN latest / (s200 / 200) END AS price_to_dma200,
  t30 / least(n, 30) * 1e-7 AS avg_traded_value_30d
FROM (SELECT symbol, count(*) AS n, max(close) FILTER (WHERE position = 1) AS latest,
    sum(close) FILTER (WHERE position <= 50) AS s50, sum(close) FILTER (WHERE position <= 200) AS s200,
    sum(close * coalesce(volume, 0)) FILTER (WHERE position <= 30) AS t30
  FROM sessions GROUP BY symbol)""",
    "statement_columns": """
SELECT symbol,
  max(value) FILTER (WHERE statement_code = 'pl' AND field_name = 'revenueFromOperations') * 1e-7 AS sales,
  max(value) FILTER (WHERE statement_code = 'pl' AND field_name = 'profitLossForPeriod') * 1e-7 AS net_profit,
  max(value) FILTER (WHERE statement_code = 'pl' AND field_name = 'profitBeforeTax') * 1e-7 AS pbt,
  max(value) FILTER (WHERE statement_code = 'pl' AND field_name = 'financeCosts') * 1e-7 AS interest,
  max(value) FILTER (WHERE statement_code = 'pl' AND field_name = 'taxExpense') * 1e-7 AS tax_expense
FROM latest_lines GROUP BY symbol""",
    "basic_columns": """
SELECT symbol,
  max(value) FILTER (WHERE statement_code = 'pl' AND field_name = 'ebitda') * 1e-7 AS ebitda,
  max(value) FILTER (WHERE statement_code = 'pl' AND field_name = 'dividendPayout') * 100 AS dividend_payout,
  max(value) FILTER (WHERE statement_code = 'bs' AND field_name = 'totalDebt') * 1e-7 AS total_debt,
  max(value) FILTER (WHERE statement_code = 'bs' AND field_name = 'totalCash') * 1e-7 AS total_cash,
  max(value) FILTER (WHERE statement_code = 'cf' AND field_name = 'operatingCashFlow') * 1e-7 AS cfo,
  max(value) FILTER (WHERE statement_code = 'cf' AND field_name = 'fcf') * 1e-7 AS fcf
FROM latest_basics GROUP BY symbol""",
    "ratio_columns": """
SELECT symbol,
  max(value) FILTER (WHERE field_name = 'returnOnEquity') * 100 AS returnonequity,
  max(value) FILTER (WHERE field_name = 'returnOnCapital') * 100 AS returnoncapital,
  max(value) FILTER (WHERE field_name = 'totalDebtToEquity') AS totaldebttoequity,
  max(value) FILTER (WHERE field_name = 'currentRatio') AS currentratio,
  max(value) FILTER (WHERE field_name = 'debtorDays') AS debtordays,
  max(value) FILTER (WHERE field_name = 'cashConversionCycle') AS cashconversioncycle
FROM latest_ratios GROUP BY symbol""",
    "metric_columns": """
SELECT symbol,
  max(value) FILTER (WHERE field_name = 'revenueGrowth3years') * 100 AS revenuegrowth3years,
  max(value) FILTER (WHERE field_name = 'revenueGrowth5years') * 100 AS revenuegrowth5years,
  max(value) FILTER (WHERE field_name = 'netIncomeGrowth3years') * 100 AS netincomegrowth3years,
  max(value) FILTER (WHERE field_name = 'netIncomeGrowth5years') * 100 AS netincomegrowth5years,
  max(value) FILTER (WHERE field_name = 'roe5yearsAvg') * 100 AS roe5yearsavg,
  max(value) FILTER (WHERE field_name = 'roce3yearsAvg') * 100 AS roce3yearsavg,
  max(value) FILTER (WHERE field_name = 'dividendPayoutPct3YrsAvg') * 100 AS dividendpayoutpct3yrsavg,
  max(value) FILTER (WHERE field_name = 'fcfAsPctOfRevenue3yearsAvg') * 100 AS fcfaspctofrevenue3yearsavg
FROM latest_metrics GROUP BY symbol""",
    "snapshot": """
SELECT *, CASE WHEN abs(ebitda) >= 1 THEN enterprise_value / ebitda END AS ev_ebitda,
  CASE WHEN pe <> 0 THEN 100 / pe END AS earnings_yield,
  CASE WHEN dividend <> 0 AND current_price <> 0 THEN dividend / current_price * 100 END AS dividend_yield,
  CASE WHEN current_price <> 0 AND high52 <> 0 THEN (high52 - current_price) / high52 * 100 END
    AS down_from_52w_high,
  CASE WHEN current_price <> 0 AND low52 > 0 THEN (current_price - low52) / low52 * 100 END AS up_from_52w_low,
  CASE WHEN net_profit <> 0 THEN cfo / net_profit END AS cfo_to_pat
FROM (SELECT *, shares AS shares_outstanding,
    market_cap + coalesce(total_debt, 0) - coalesce(total_cash, 0) AS enterprise_value
  FROM company LEFT JOIN quote USING (symbol) LEFT JOIN statement_columns USING (symbol)
  LEFT JOIN basic_columns USING (symbol) LEFT JOIN ratio_columns USING (symbol)
  LEFT JOIN metric_columns USING (symbol) LEFT JOIN cagr USING (symbol) LEFT JOIN moving USING (symbol)
  LEFT JOIN valuation USING (symbol) LEFT JOIN holdings USING (symbol) LEFT JOIN dividends USING (symbol))""",
    "screenable": "SELECT * FROM snapshot WHERE market_cap IS NOT NULL",
    "memberships": "SELECT symbol, index_symbol FROM constituents WHERE symbol IN (SELECT symbol FROM company)",
    "members": """
SELECT m.index_symbol, m.symbol, s.name, s.symbol IS NOT NULL AS in_universe, s.current_price, s.market_cap, s.pe,
  s.pb, s.dividend_yield, s.returnonequity, s.returnoncapital, s.net_profit, s.sales, s.change_pct, s.sector
FROM constituents m LEFT JOIN snapshot s ON s.symbol = m.symbol""",
    "peer_rows": """
SELECT symbol, name, current_price, pe, market_cap, dividend_yield, net_profit, sales, returnoncapital,
  returnonequity, coalesce(sub_industry, sector, industry) AS peer_group
FROM snapshot WHERE coalesce(sub_industry, sector, industry) IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY coalesce(sub_industry, sector, industry)
  ORDER BY coalesce(market_cap, 0) DESC, symbol) <= 10""",
    "newest_index_quotes": """
SELECT index_symbol, close_price, change_pct, pe, pb, div_yield FROM index_quotes
QUALIFY row_number() OVER (PARTITION BY index_symbol ORDER BY quote_date DESC) = 1""",
    "recent_periods": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, statement_code, period_kind, statement_type
    ORDER BY period_end DESC NULLS FIRST, header DESC) AS position FROM periods) WHERE position <= 16""",
    "shown_periods": """
SELECT * FROM recent_periods
QUALIFY statement_type = CASE WHEN max(CASE statement_type WHEN 'c' THEN 1 ELSE 0 END)
  OVER (PARTITION BY symbol, statement_code, period_kind) = 1 THEN 'c' ELSE 's' END""",
    "figures": """
SELECT symbol, statement_type, statement_code, period_kind, header, field_name, value FROM (
  SELECT l.*, 0 AS source FROM lines l
    SEMI JOIN shown_periods USING (symbol, statement_type, statement_code, period_kind, header)
  UNION ALL BY NAME
  SELECT b.symbol, b.statement_type, b.statement_code, p.period_kind, b.header, b.field_name, b.value, 1 AS source
  FROM basics b JOIN shown_periods p USING (symbol, statement_type, statement_code, header)
  WHERE p.period_kind IN ('annual', 'ttm'))
QUALIFY row_number() OVER (PARTITION BY symbol, statement_type, statement_code, period_kind, header, field_name
  ORDER BY source) = 1""",
}

_WORD = re.compile(r"\b[a-z_]+\b")


def _needs(sql: str) -> set[str]:
    return {w for w in _WORD.findall(sql) if w in CTES}


def with_ctes(sql: str) -> str:
    """The query with every expression it needs in front, in the order of CTES."""
    wanted, queue = set(), _needs(sql)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue |= _needs(CTES[name])
    heads = [f"{name} AS ({CTES[name]})" for name in CTES if name in wanted]
    body = sql.strip()
    if not heads:
        return body
    own = body.removeprefix("WITH ")
    return f"WITH {', '.join(heads)}{', ' if own != body else chr(10)}{own}"
