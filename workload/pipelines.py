"""Composed jobs: normalisation of landed JSON, the snapshot, screens, pages, quality and monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselight.operators import classify, normalise
from bourselight.operators.normalise import PERIOD_KEY
from bourselight.plans import monitor, pages, quality, screen, search_index, snapshot
from bourselight.session import new_table_path
from bourselight.sources.landing import payload_account, routed
from bourselight.sources.testbed import AS_OF
from workload import landed
from workload.damage import DAMAGED_PRICES, DAMAGED_QUOTES, FEED, damaged_prices, damaged_quotes, feed
from workload.registry import names, query, r6, rounded, snapshot_table

KEY = names(PERIOD_KEY)
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query(
    "p01_symbols",
    """SELECT CAST(p_partkey AS VARCHAR) AS symbol,
  CASE WHEN p_size % 4 <> 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS name,
  concat('NSE', p_partkey) AS nse_code, CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey + 500000 AS VARCHAR) END AS bse_code,
  p_size % 2 = 0 AS consolidated_ind FROM part WHERE p_size <> 50""",
)
def p01(t):
    return normalise.symbols(routed(landed.symbols(t), "company"))


@query(
    "p02_profiles",
    """SELECT symbol, macro_sector AS macro_sector_raw, ' ' || sector || ' ' AS sector_raw,
  industry AS industry_raw, coalesce(sub_industry, '  ') AS sub_industry_raw, macro_sector, industry, sector, sub_industry,
  CAST(NULL AS VARCHAR) AS website, concat('About ', name) AS description, round(market_cap, 2) AS market_cap, name
FROM company JOIN quote USING (symbol)""",
)
def p02(t):
    return rounded(normalise.profiles(routed(landed.profiles(t), "company_profile")), 2)


@query(
    "p03_quotes",
    f"""SELECT symbol, round(CASE WHEN current_price > 0 THEN current_price END, 6) AS current_price,
  CAST(NULL AS DOUBLE) AS open_price, CAST(NULL AS DOUBLE) AS high_price, CAST(NULL AS DOUBLE) AS low_price, volume,
  CASE WHEN coalesce(current_price, 0) <= 0 AND change_pct = -100 THEN NULL ELSE change_pct END AS change_pct,
  round(nullif(high52, 0), 6) AS high52, round(low52, 6) AS low52, round(nullif(market_cap, 0), 6) AS market_cap,
  shares, '15:30' AS trade_time FROM ({DAMAGED_QUOTES})""",
)
def p03(t):
    return rounded(normalise.quotes(routed(landed.quotes(t), "quote")))


@query(
    "p04_statements",
    f"""SELECT l.symbol, l.statement_type, l.statement_code, l.period_kind, l.header, p.year, p.period_end,
  CASE l.statement_code WHEN 'pl' THEN 'general' ELSE 'unknown' END AS schema_kind, field_name, value
FROM lines l JOIN periods p USING (symbol, statement_type, statement_code, period_kind, header)""",
)
def p04(t):
    sent = routed(landed.statements(t), "statement")
    periods, lines = normalise.statement_periods(sent), normalise.statement_lines(sent)
    joined = periods.select(*PERIOD_KEY, "schema_kind").join(lines, list(PERIOD_KEY))
    return joined.select(*PERIOD_KEY, "year", "period_end", "schema_kind", "field_name", "value")


@query(
    "p05_index_master",
    """SELECT index_symbol, index_name, exchange, index_type, nullif(index_sub_type, '') AS index_sub_type,
  CASE WHEN index_type <> 'broad' THEN market_cap END AS market_cap, symbol
FROM index_master JOIN constituents USING (index_symbol)""",
)
def p05(t):
    sent = routed(landed.index_master(t), "index_master")
    # Every part of a split payload repeats the index itself.
    return normalise.indices(sent).distinct().join(normalise.constituents(sent), "index_symbol")


@query(
    "p06_index_quotes",
    f"""SELECT index_symbol, quote_date, {r6('close_price', 'change_pct')},
  round(CASE WHEN NOT (pe = 0 AND pb = 0) THEN pe END, 6) AS pe,
  round(CASE WHEN NOT (pe = 0 AND pb = 0) THEN pb END, 6) AS pb,
  round(CASE WHEN NOT (pe = 0 AND pb = 0) THEN div_yield END, 6) AS div_yield,
  round(nullif(market_cap, 0), 6) AS market_cap FROM index_quotes""",
)
def p06(t):
    rows = normalise.index_quotes(routed(landed.index_quotes(t), "index_quote_daily"))
    shown = ["close_price", "change_pct", "pe", "pb", "div_yield", "market_cap"]
    return rounded(rows.select("index_symbol", "quote_date", *shown))


@query(
    "p07_index_returns",
    """SELECT index_symbol, horizon, round(return_pct, 6) AS return_pct, DATE '2001-11-04' AS as_of FROM index_returns
WHERE return_pct <> 0""",
)
def p07(t):
    return rounded(normalise.index_returns(routed(landed.index_returns(t), "index_return")))


P08_SQL = f"""SELECT symbol, quote_date, open, high, low, close, volume FROM ({DAMAGED_PRICES})
WHERE NOT (open = 0 AND high = 0 AND low = 0 AND close = 0 AND volume = 0) AND close > 0 AND open >= 0"""


@query("p08_prices", P08_SQL)
def p08(t):
    return normalise.prices(routed(landed.prices(t), "price_daily"))


@query(
    "p09_basic_financials",
    f"SELECT symbol, statement_type, statement_code, header, year, field_name, value FROM basics",
)
def p09(t):
    return normalise.basic_financials(routed(landed.basics(t), "basic_financial"))


@query("p10_ratios", f"SELECT symbol, statement_type, family, header, year, field_name, {r6('value')} FROM ratios")
def p10(t):
    return rounded(normalise.ratios(routed(landed.ratios(t), "ratio")))


@query("p11_metrics", f"SELECT symbol, statement_type, family, field_name, {r6('value')} FROM metrics")
def p11(t):
    return rounded(normalise.metrics(routed(landed.metrics(t), "metric")))


@query(
    "p12_price_ratios_daily",
    f"SELECT symbol, statement_type, quote_date, {r6('pe', 'pb', 'ptb', 'ps', 'pfcf')} FROM price_ratios",
)
def p12(t):
    return rounded(normalise.price_ratios_daily(routed(landed.price_ratios_daily(t), "price_ratio_daily")))


@query(
    "p13_price_ratios_annual",
    """SELECT symbol, statement_type, concat('Mar ', year(quote_date)) AS header, CAST(year(quote_date) AS INTEGER) AS year,
  round(max(ps), 6) AS average_price, round(max(pe), 6) AS pe, round(max(pb), 6) AS pb, round(max(ptb), 6) AS ptb,
  CAST(NULL AS DOUBLE) AS ps, round(max(pfcf), 6) AS pfcf
FROM price_ratios GROUP BY symbol, statement_type, year(quote_date)""",
)
def p13(t):
    return rounded(normalise.price_ratios_annual(routed(landed.price_ratios_annual(t), "price_ratio_annual")))


@query(
    "p14_actions",
    """SELECT symbol, action, ex_date, subject, round(amount, 6) AS amount,
  CASE action WHEN 'dividend' THEN subject END AS dividend_type FROM actions""",
)
def p14(t):
    paid = routed(landed.dividends(t), "dividend")
    other = routed(landed.corporate_actions(t), "corporate_action")
    return rounded(normalise.all_actions(paid, other))


@query(
    "p15_shareholding",
    f"""SELECT symbol, period_label, group_name, {r6('shareholding_pct')}, CAST(NULL AS DOUBLE) AS total_shares,
  total_shareholders, {r6('pledged_pct')}, CAST(NULL AS DOUBLE) AS locked_in_pct FROM shareholding""",
)
def p15(t):
    return rounded(normalise.shareholding(routed(landed.shareholding(t), "shareholding")))


# Field sets per customer and year: order priorities and statuses stand for statement fields.
_PRIORITY_FIELDS = {
    "1-URGENT": "interestExpended", "2-HIGH": "premiumEarned", "3-MEDIUM": "revenueFromOperations",
    "4-NOT SPECIFIED": "grossPremiumIncome", "5-LOW": "eps",
}
_STATUS_FIELDS = {"F": "financeCosts", "O": "year", "P": "cET1Ratio"}


def _cases(column: str, fields: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fields.items()) + " END"


@query(
    "p16_family_classifier",
    f"""WITH named AS (
  SELECT concat(o_custkey, '-', year(o_orderdate)) AS symbol, {_cases('o_orderpriority', _PRIORITY_FIELDS)} AS field_name
  FROM orders UNION
  SELECT concat(o_custkey, '-', year(o_orderdate)), {_cases('o_orderstatus', _STATUS_FIELDS)} FROM orders),
hits AS (SELECT symbol, count(*) FILTER (WHERE field_name IN ('interestExpended', 'cET1Ratio')) AS b,
    count(*) FILTER (WHERE field_name = 'grossPremiumIncome') AS l,
    count(*) FILTER (WHERE field_name = 'premiumEarned') AS g,
    count(*) FILTER (WHERE field_name IN ('revenueFromOperations', 'financeCosts')) AS n FROM named GROUP BY symbol),
shares AS (SELECT symbol, 'bank' AS kind, b / 8 AS share, b AS hits, 0 AS tie FROM hits
  UNION ALL SELECT symbol, 'life_insurance', l / 9, l, 1 FROM hits
  UNION ALL SELECT symbol, 'general_insurance', g / 9, g, 2 FROM hits
  UNION ALL SELECT symbol, 'general', n / 8, n, 3 FROM hits),
placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY share DESC, hits DESC, tie) AS place FROM shares)
SELECT a.symbol, CASE WHEN a.hits > 0 THEN a.kind ELSE 'unknown' END AS kind, round(a.share, 3) AS confidence,
  CAST(a.hits AS INTEGER) AS hits, round(a.share - b.share, 6) AS margin
FROM placed a JOIN placed b ON a.symbol = b.symbol AND a.place = 1 AND b.place = 2""",
)
def p16(t):
    def mapped(column, fields):
        out = F.lit(None).cast("string")
        for value, field in fields.items():
            out = F.when(F.col(column) == value, field).otherwise(out)
        return out

    key = F.concat_ws("-", "o_custkey", F.year("o_orderdate").cast("string")).alias("symbol")
    fields = F.array(mapped("o_orderpriority", _PRIORITY_FIELDS), mapped("o_orderstatus", _STATUS_FIELDS))
    named = t.table("orders").select(key, F.explode(fields).alias("field_name"))
    return rounded(classify.families(named).drop("fields"))


# Snapshot columns that the test tables fill.
SNAPSHOT_COLUMNS = [
    "current_price", "market_cap", "volume", "change_pct", "high52", "low52", "shares_outstanding", "pe", "pb", "ps",
    "pfcf", "ptb", "sales", "net_profit", "pbt", "interest", "tax_expense", "ebitda", "dividend_payout", "total_debt",
    "total_cash", "cfo", "fcf", "returnonequity", "returnoncapital", "totaldebttoequity", "currentratio", "debtordays",
    "cashconversioncycle", "revenuegrowth3years", "revenuegrowth5years", "netincomegrowth3years",
    "netincomegrowth5years", "roe5yearsavg", "roce3yearsavg", "dividendpayoutpct3yrsavg", "fcfaspctofrevenue3yearsavg",
    "dividend_yield", "enterprise_value", "ev_ebitda", "earnings_yield", "price_cagr_1y", "price_cagr_3y",
    "price_cagr_5y", "price_cagr_10y", "down_from_52w_high", "up_from_52w_low", "dma_50", "dma_200", "price_to_dma200",
    "avg_traded_value_30d", "promoter_holding", "promoter_pledge", "public_holding", "cfo_to_pat",
]
SNAPSHOT_TEXTS = ["name", "macro_sector", "industry", "sector", "sub_industry"]


def snapshot_sql() -> str:
    return f"SELECT symbol, {names(SNAPSHOT_TEXTS)}, {r6(*SNAPSHOT_COLUMNS)} FROM snapshot"


def snapshot_frame(t):
    built = snapshot.build(**t.snapshot_inputs(F.lit(AS_OF).cast("date")))
    return rounded(built.select("symbol", *SNAPSHOT_TEXTS, *SNAPSHOT_COLUMNS))


@query("p17_company_snapshot", snapshot_sql())
def p17(t):
    return snapshot_frame(t)


@query(
    "p18_screen",
    f"""SELECT symbol, name, {r6('market_cap', 'pe', 'dividend_yield')}, (SELECT count(*) FROM screenable
  WHERE pe < 35 AND NOT dividend_yield > 5) AS total, true AS capped FROM screenable
WHERE pe < 35 AND NOT dividend_yield > 5 ORDER BY dividend_yield DESC NULLS LAST, symbol LIMIT 25""",
)
def p18(t):
    predicate = (F.col("pe") < 35) & ~(F.col("dividend_yield") > 5)
    page = screen.run(
        snapshot_table(t), predicate, columns=["Name", "Mcap", "PE", "Dividend Yield"], sort_by="dividend yield",
        row_cap=screen.PUBLIC_ROW_CAP,
    )
    return rounded(page)


@query(
    "p19_search",
    """SELECT symbol, name, sector, CAST(rank AS INTEGER) AS rank, round(current_price, 6) AS current_price,
  round(market_cap, 6) AS market_cap FROM (SELECT *,
    CASE WHEN upper(symbol) = 'RED' THEN 0 WHEN starts_with(upper(symbol), 'RED') THEN 1
      WHEN starts_with(upper(name), 'RED') THEN 2
      WHEN contains(upper(symbol), 'RED') OR contains(upper(name), 'RED') THEN 3 END AS rank
  FROM company LEFT JOIN quote USING (symbol)) WHERE rank IS NOT NULL
ORDER BY rank, coalesce(market_cap, 0) DESC, symbol LIMIT 10""",
)
def p19(t):
    return rounded(pages.search(t.company, t.quote, "red"))


_TERMS = ("red", "e", "12", "almond rose", "nothing like it", " Blue ")
INDEXED_SQL = "\nUNION ALL ".join(
    f"""SELECT '{term}' AS term, symbol, name, CAST(rank AS INTEGER) AS rank FROM (SELECT * FROM (SELECT *,
    CASE WHEN upper(symbol) = '{t}' THEN 0 WHEN starts_with(upper(symbol), '{t}') THEN 1 WHEN starts_with(upper(name), '{t}') THEN 2
      WHEN contains(upper(symbol), '{t}') OR contains(upper(name), '{t}') THEN 3 END AS rank
  FROM company LEFT JOIN quote USING (symbol)) WHERE rank IS NOT NULL ORDER BY rank, coalesce(market_cap, 0) DESC, symbol LIMIT 10)"""
    for term in _TERMS
    for t in [term.strip().upper()]
)


@query("p31_indexed_search", INDEXED_SQL)
def p31(t):
    """Terms of every length looked up in the stored postings of all companies."""
    index = search_index.build(t.spark, new_table_path(t.spark, "search"), t.company)
    found = [
        search_index.search(index, t.quote, term).select(F.lit(term).alias("term"), "symbol", "name", F.col("rank").cast("int").alias("rank"))
        for term in _TERMS
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "p20_company_profile",
    f"""SELECT s.symbol, s.name, s.nse_code, s.bse_code, s.macro_sector, s.industry, s.sector, s.sub_industry,
  round(s.current_price, 6) AS current_price, round(s.market_cap, 6) AS market_cap, round(s.pe, 6) AS pe,
  round(s.dividend_yield, 6) AS dividend_yield, round(s.returnonequity, 6) AS returnonequity,
  round(s.promoter_holding, 6) AS promoter_holding, coalesce(m.index_count, 0) AS index_count, m.indices
FROM snapshot s LEFT JOIN (SELECT symbol, count(*) AS index_count,
    string_agg(index_name, '|' ORDER BY market_cap DESC NULLS LAST, index_symbol) AS indices
  FROM constituents JOIN index_master USING (index_symbol) GROUP BY symbol) m ON m.symbol = s.symbol""",
)
def p20(t):
    shown = [
        "symbol", "name", "nse_code", "bse_code", "macro_sector", "industry", "sector", "sub_industry", "current_price",
        "market_cap", "pe", "dividend_yield", "returnonequity", "promoter_holding", "index_count", "indices",
    ]
    built = pages.profiles(t.company, t.quote, snapshot_table(t), t.constituents, t.index_master)
    return rounded(built.select(*shown))


@query(
    "p21_peers",
    """SELECT c.symbol, coalesce(c.sub_industry, c.sector, c.industry) AS peer_group, g.peer_count, g.median_pe,
  g.median_market_cap, g.median_dividend_yield, g.median_returnonequity, g.median_returnoncapital
FROM company c LEFT JOIN (SELECT peer_group, count(*) AS peer_count,
    round(median(pe) FILTER (WHERE pe > 0), 6) AS median_pe, round(median(market_cap), 6) AS median_market_cap,
    round(median(dividend_yield), 6) AS median_dividend_yield, round(median(returnonequity), 6) AS median_returnonequity,
    round(median(returnoncapital), 6) AS median_returnoncapital FROM peer_rows GROUP BY peer_group) g
ON g.peer_group = coalesce(c.sub_industry, c.sector, c.industry)""",
)
def p21(t):
    return rounded(pages.company_peers(snapshot_table(t), t.company))


_RETURNS = names(
    f"round(max(return_pct) FILTER (WHERE horizon = '{h}'), 6) AS return_{h.lower()}" for h in normalise.HORIZONS
)
LISTING_SQL = f"""SELECT m.index_symbol, index_name, exchange, index_type, index_sub_type, round(market_cap, 6) AS market_cap,
  coalesce(n, 0) AS constituents, {r6('close_price', 'change_pct', 'pe', 'pb', 'div_yield')},
  {names('return_' + h.lower() for h in normalise.HORIZONS)},
  CAST(CASE m.index_symbol WHEN 'NIF50' THEN 1 WHEN 'SENSEX' THEN 3 WHEN 'NIF100' THEN 5 WHEN 'BSE500' THEN 10
    WHEN 'NIFBANK' THEN 14 ELSE 17 END AS INTEGER) AS place
FROM index_master m LEFT JOIN (SELECT index_symbol, count(*) AS n FROM constituents GROUP BY 1) USING (index_symbol)
LEFT JOIN newest_index_quotes USING (index_symbol)
LEFT JOIN (SELECT index_symbol, {_RETURNS} FROM index_returns GROUP BY 1) USING (index_symbol)"""


def listing_frame(t):
    return rounded(pages.listing(t.index_master, t.constituents, t.index_quotes, t.index_returns))


@query("p22_index_listing", f"SELECT *, count(*) OVER () AS total FROM ({LISTING_SQL})")
def p22(t):
    return pages.listed_in_order(listing_frame(t))


@query(
    "p23_index_detail",
    """SELECT m.index_symbol, index_name, exchange, round(close_price, 6) AS close_price, return_1y, return_7y,
  coalesce(count, 0) AS count, coalesce(with_fundamentals, 0) AS with_fundamentals,
  coalesce(outside_universe, 0) AS outside_universe, median_pe, median_pb, median_dividend_yield, median_returnonequity
FROM index_master m LEFT JOIN newest_index_quotes USING (index_symbol)
LEFT JOIN (SELECT index_symbol, round(max(return_pct) FILTER (WHERE horizon = '1Y'), 6) AS return_1y,
    round(max(return_pct) FILTER (WHERE horizon = '7Y'), 6) AS return_7y FROM index_returns GROUP BY 1)
  USING (index_symbol)
LEFT JOIN (SELECT index_symbol, count(*) AS count, count(net_profit) AS with_fundamentals,
    count(*) FILTER (WHERE NOT in_universe) AS outside_universe,
    round(median(pe) FILTER (WHERE net_profit IS NOT NULL AND pe > 0), 6) AS median_pe,
    round(median(pb) FILTER (WHERE net_profit IS NOT NULL AND pb > 0), 6) AS median_pb,
    round(median(dividend_yield) FILTER (WHERE net_profit IS NOT NULL), 6) AS median_dividend_yield,
    round(median(returnonequity) FILTER (WHERE net_profit IS NOT NULL), 6) AS median_returnonequity
  FROM members GROUP BY 1) USING (index_symbol)""",
)
def p23(t):
    details = pages.index_details(
        t.index_master, t.constituents, t.index_quotes, t.index_returns, snapshot_table(t), t.company
    )
    shown = [
        "index_symbol", "index_name", "exchange", "close_price", "return_1y", "return_7y", "count", "with_fundamentals",
        "outside_universe", "median_pe", "median_pb", "median_dividend_yield", "median_returnonequity",
    ]
    return rounded(details.select(*shown))


def _sampled(keys: str, order: str = "symbol") -> str:
    return f"coalesce((SELECT string_agg(symbol, '|' ORDER BY {order}) FROM (SELECT * FROM ({keys}) ORDER BY {order} LIMIT 10)), '')"


_WHAT = {name: what for name, _, what in quality.CHECKS}


def _check(name: str, severity: str, keys: str, order: str | None = "symbol", sample: str | None = None) -> str:
    text = _sampled(sample or keys, order) if order else "''"
    return (
        f"SELECT '{name}' AS name, '{severity}' AS severity, (SELECT count(*) FROM ({keys})) AS count, "
        f"(SELECT count(*) FROM ({keys})) = 0 AS ok, {text} AS sample, "
        f"concat((SELECT count(*) FROM ({keys})), ' {_WHAT[name]}') AS detail"
    )


_BAD_PRICES = f"SELECT symbol FROM ({DAMAGED_PRICES}) WHERE close <= 0"
CHECKS_SQL = f"WITH feed AS ({FEED})\n" + "\nUNION ALL ".join(
    [
        _check("quote_keys_outside_symbol_master", "info", "SELECT symbol FROM feed EXCEPT SELECT symbol FROM company"),
        _check(
            "companies_quoted_twice", "warning",
            "SELECT symbol FROM feed WHERE regexp_full_match(symbol, '[0-9]+') AND symbol NOT IN "
            "(SELECT symbol FROM company) INTERSECT SELECT bse_code FROM company",
        ),
        _check("listed_without_a_quote", "warning", "SELECT symbol FROM company EXCEPT SELECT symbol FROM feed"),
        _check(
            "index_members_missing_from_symbol_master", "warning",
            "SELECT symbol FROM constituents EXCEPT SELECT symbol FROM company",
        ),
        _check("companies_without_a_sector", "info", "SELECT symbol FROM company WHERE sector IS NULL"),
        _check(
            "unclassified_statement_schema", "error",
            "SELECT symbol FROM periods WHERE statement_code = 'pl' AND schema_kind = 'unknown'", None,
        ),
        _check(
            "non_positive_close_price", "error", _BAD_PRICES, "n DESC, symbol",
            f"SELECT symbol, count(*) AS n FROM ({_BAD_PRICES}) GROUP BY symbol",
        ),
        _check("implausible_daily_change", "warning", "SELECT symbol FROM feed WHERE abs(change_pct) > 50", None),
        _check(
            "implausible_ten_year_return", "warning", "SELECT symbol FROM snapshot WHERE price_cagr_10y > 50",
        ),
    ]
)


def check_rows(t):
    return quality.checks(t.company, feed(t), t.constituents, t.periods, damaged_prices(t), snapshot_table(t))


@query("p24_quality_checks", CHECKS_SQL)
def p24(t):
    return check_rows(t)


@query(
    "a16_failing_checks",
    f"SELECT count(*) FILTER (WHERE NOT ok AND severity = 'error') AS errors, "
    f"count(*) FILTER (WHERE NOT ok AND severity = 'warning') AS warnings FROM ({CHECKS_SQL})",
)
def a16(t):
    return quality.summary(check_rows(t))


@query(
    "p25_repair",
    f"""SELECT 'price_rows_removed' AS rule, count(*) AS changed FROM ({DAMAGED_PRICES}) WHERE close <= 0 OR open < 0
UNION ALL SELECT 'quote_changes_cleared', count(*) FROM ({DAMAGED_QUOTES}) WHERE change_pct = -100
  AND coalesce(current_price, 0) <= 0
UNION ALL SELECT 'quote_rows_corrected', count(*) FROM ({DAMAGED_QUOTES}) WHERE current_price <= 0 OR market_cap <= 0
  OR high52 <= 0
UNION ALL SELECT 'index_valuations_cleared', count(*) FROM index_quotes WHERE pe = 0 AND pb = 0
UNION ALL SELECT 'index_market_caps_cleared', (SELECT count(*) FROM index_quotes WHERE market_cap = 0)
  + (SELECT count(*) FROM index_master WHERE market_cap = 0)
UNION ALL SELECT 'left after repair', 0""",
)
def p25(t):
    tables = [damaged_prices(t), damaged_quotes(t), t.index_quotes, t.index_master]
    rules = [
        quality.repaired_prices, quality.repaired_quotes, quality.repaired_index_quotes, quality.repaired_index_master,
    ]
    found = quality.repair_report(*tables)
    again = quality.repair_report(*[rule(table) for rule, table in zip(rules, tables, strict=True)])
    left = again.agg(F.sum("changed").alias("changed")).select(F.lit("left after repair").alias("rule"), "changed")
    return found.unionByName(left)


@query(
    "p26_run_status",
    """SELECT run_id, planned AS symbols_total, count(*) FILTER (WHERE status = 'done') AS done,
  count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status NOT IN ('done', 'skipped', 'failed') OR status IS NULL) AS other,
  count(DISTINCT symbol) AS symbols_done, min(symbol) FILTER (WHERE status = 'failed') AS first_failed
FROM runs JOIN tasks USING (run_id) GROUP BY run_id, planned""",
)
def p26(t):
    progress = monitor.run_progress(t.runs, t.tasks)
    first = monitor.first_failures(t.tasks).where(F.col("position") == 1)
    named = progress.join(first.select("run_id", F.col("symbol").alias("first_failed")), "run_id", "left")
    return named.drop("started_at", "scope")


@query(
    "p27_log_health",
    f"""SELECT count(*) FILTER (WHERE level = 'ERROR' AND created_at >= {NOW} - INTERVAL 24 HOUR) AS errors_last_24h,
  count(*) FILTER (WHERE level = 'WARNING' AND created_at >= {NOW} - INTERVAL 24 HOUR) AS warnings_last_24h,
  max(id) FILTER (WHERE level = 'ERROR') AS last_error_id, arg_max(message, id) FILTER (WHERE level = 'ERROR')
  AS last_error FROM logs""",
)
def p27(t):
    return monitor.log_health(t.logs, F.expr(NOW))


def _account(target: str, payloads: str) -> str:
    spoilt = lambda *k: f"count(*) FILTER (WHERE CAST(nullif(symbol, '') AS BIGINT) % 7 IN ({', '.join(map(str, k))}))"
    bad, left_out = spoilt(0, 1, 2, 3, 4), target == "archive_only"
    figures = ["0"] * 3 if left_out else [spoilt(0), spoilt(1, 2), spoilt(3, 4)]
    taken = "count(*)" if left_out else f"count(*) - {bad}"
    named = ", ".join(f"{f} AS {n}" for f, n in zip(figures, ("empty", "not_json", "no_entries")))
    return f"SELECT '{target}' AS target, count(*) AS payloads, {taken} AS taken, {named} FROM (SELECT DISTINCT {payloads})"


@query(
    "p29_payload_account",
    "\nUNION ALL ".join(
        _account(target, payloads)
        for target, payloads in {
            "price_daily": "symbol, date_trunc('month', quote_date) FROM prices",
            "company_profile": "symbol FROM company",
            "statement": "symbol, statement_type, statement_code, period_kind FROM statement_wide",
            "basic_financial": "symbol, statement_type, statement_code FROM statement_wide WHERE period_kind <> 'quarterly'",
            "ratio": "symbol, statement_type, family FROM ratios",
            "metric": "symbol, statement_type, family FROM metrics",
            "price_ratio_daily": "symbol, statement_type, year(quote_date) FROM price_ratios",
            "price_ratio_annual": "symbol, statement_type FROM price_ratios",
            "dividend": "symbol, CAST(subject AS BIGINT) // 100 FROM actions WHERE action = 'dividend'",
            "corporate_action": "symbol, action, CAST(subject AS BIGINT) // 100 FROM actions WHERE action <> 'dividend'",
            "shareholding": "symbol, period_label FROM shareholding",
            # Calls on the whole universe have no symbol and are not spoilt.
            "company": "'' AS symbol, p_partkey // 100 FROM part",
            "quote": f"'' AS symbol, CAST(symbol AS BIGINT) // 100 FROM ({DAMAGED_QUOTES})",
            "index_master": "'' AS symbol, index_symbol, CAST(symbol AS BIGINT) // 100 FROM constituents",
            "index_quote_daily": "'' AS symbol, quote_date FROM index_quotes",
            "index_return": "'' AS symbol, index_symbol FROM index_returns",
            "archive_only": "'' AS symbol, r_regionkey FROM region",
        }.items()
    ),
)
def p29(t):
    """All landed payloads, of which some are blank, cut off, no JSON at all, or without entries."""
    kind = F.col("symbol").try_cast("bigint") % 7
    spoilt = (
        F.when(kind == 0, " ")
        .when(kind == 1, F.expr("substring(payload, 1, length(payload) - 1)"))
        .when(kind == 2, "<html>busy</html>")
        .when(kind == 3, '{"error": null}')
        .when(kind == 4, F.when(F.col("payload").startswith("["), "[]").otherwise("{}"))
        .otherwise(F.col("payload"))
    )
    sent = reduce(DataFrame.unionByName, [call(t) for call in landed.ALL])
    return payload_account(sent.withColumn("payload", spoilt)).drop("entries")


@query(
    "p28_freshness",
    """SELECT run_id, CAST(started_at AS DATE) AS started_on, (SELECT count(*) FROM archive) AS raw_responses,
  (SELECT count(DISTINCT symbol) FROM archive) AS distinct_symbols,
  (SELECT CAST(max(fetched_at) AS DATE) FROM archive) AS last_fetched_on,
  (SELECT CAST(sum(size_bytes) AS BIGINT) FROM archive) AS uncompressed_bytes
FROM runs ORDER BY started_at DESC LIMIT 5""",
)
def p28(t):
    report = monitor.freshness(t.archive, t.runs)
    return report.select(
        "run_id", F.col("started_at").cast("date").alias("started_on"), "raw_responses", "distinct_symbols",
        F.col("last_fetched_at").cast("date").alias("last_fetched_on"), "uncompressed_bytes",
    )
