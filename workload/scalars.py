"""Scalar functions as column expressions, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselight.functions import figures, parse
from bourselight.functions.formulas import FORMULAS, first_non_zero
from bourselight.operators.normalise import PERIOD_KEY, change_or_null, clear_absent_valuation
from bourselight.operators.latest import annualised_returns
from bourselight.plans import pages, snapshot, statements
from workload.damage import DAMAGED_QUOTES, damaged_quotes
from workload.registry import query, r6, rounded, snapshot_table

# Order dates written in the four landed shapes, and in one that is not known.
_DATE_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 10:11:12') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d')
  WHEN 3 THEN strftime(o_orderdate, '%-d-%b-%Y') WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y')
  ELSE '2001-02-30' END"""


def _date_text(day):
    shape = F.col("o_orderkey") % 6
    return (
        F.when(shape == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(shape == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:11:12")))
        .when(shape == 2, F.date_format(day, "yyyyMMdd"))
        .when(shape == 3, F.date_format(day, "d-MMM-yyyy"))
        .when(shape == 4, F.date_format(day, "dd/MM/yyyy"))
        .otherwise("2001-02-30")
    )


@query(
    "x01_parse_date",
    f"""SELECT o_orderkey, {_DATE_TEXT} AS text, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderdate AS DATE) END AS day
FROM orders""",
)
def x01(t):
    text = t.table("orders").select("o_orderkey", _date_text(F.col("o_orderdate")).alias("text"))
    return text.withColumn("day", parse.parse_date("text"))


# Prices written as landed figures: plain, with commas, as percent, and as texts that stand for nothing.
_NUMBER_TEXT = """CASE p_partkey % 8 WHEN 0 THEN concat(' ', CAST(p_size AS VARCHAR), ' ')
  WHEN 1 THEN concat(CAST(p_size AS VARCHAR), ',', CAST(100 + p_size AS VARCHAR), '.25')
  WHEN 2 THEN concat(CAST(p_size AS VARCHAR), '.5%') WHEN 3 THEN '-' WHEN 4 THEN 'N/A' WHEN 5 THEN ''
  WHEN 6 THEN concat('-', CAST(p_size AS VARCHAR), 'e2') ELSE concat(CAST(p_size AS VARCHAR), 'd') END"""


@query(
    "x02_parse_number",
    f"""SELECT p_partkey, {_NUMBER_TEXT} AS text, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS DOUBLE)
  WHEN 1 THEN p_size * 1000 + 100 + p_size + 0.25 WHEN 2 THEN p_size + 0.5 WHEN 6 THEN -p_size * 100 END AS number
FROM part""",
)
def x02(t):
    size, shape = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    text = (
        F.when(shape == 0, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(shape == 1, F.concat(size, F.lit(","), (F.col("p_size") + 100).cast("string"), F.lit(".25")))
        .when(shape == 2, F.concat(size, F.lit(".5%")))
        .when(shape == 3, "-").when(shape == 4, "N/A").when(shape == 5, "")
        .when(shape == 6, F.concat(F.lit("-"), size, F.lit("e2")))
        .otherwise(F.concat(size, F.lit("d")))
    )
    return t.table("part").select("p_partkey", text.alias("text")).withColumn("number", parse.parse_number("text"))


@query(
    "x03_parse_percent",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_discount AS pct FROM lineitem",
)
def x03(t):
    lines = t.table("lineitem")
    text = F.concat(F.col("l_discount").cast("string"), F.lit("%"))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", parse.parse_percent(text).alias("pct")
    )


@query(
    "x04_clean_text",
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS name FROM part""",
)
def x04(t):
    padded = F.when(F.col("p_size") % 5 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
    return t.table("part").select("p_partkey", parse.clean_text(padded).alias("name"))


@query(
    "x05_positive_or_null",
    f"""SELECT symbol, round(CASE WHEN current_price > 0 THEN current_price END, 6) AS price,
  round(CASE WHEN market_cap > 0 THEN market_cap END, 6) AS cap FROM ({DAMAGED_QUOTES})""",
)
def x05(t):
    return rounded(
        damaged_quotes(t).select(
            "symbol",
            parse.positive_or_null("current_price").alias("price"),
            parse.positive_or_null("market_cap").alias("cap"),
        )
    )


@query("x06_zero_to_null", f"SELECT symbol, {r6('current_price')}, round(nullif(high52, 0), 6) AS high52 FROM ({DAMAGED_QUOTES})")
def x06(t):
    return rounded(damaged_quotes(t).select("symbol", "current_price", parse.zero_to_null("high52").alias("high52")))


@query(
    "x07_whole_number",
    "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS whole FROM orders",
)
def x07(t):
    orders = t.table("orders")
    return orders.select("o_orderkey", parse.to_int(F.col("o_totalprice").cast("string")).alias("whole"))


@query(
    "x08_period_header",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN concat('FY ', year(o_orderdate))
  ELSE strftime(o_orderdate, '%b %Y') END AS header FROM orders""",
)
def x08(t):
    given = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("FY "), F.year("o_orderdate").cast("string")))
    made = parse.header_or_period_end(given, F.col("o_orderdate").cast("date"))
    return t.table("orders").select("o_orderkey", made.alias("header"))


@query(
    "x09_label_month",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN DATE '0001-01-01'
  ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS month FROM orders""",
)
def x09(t):
    label = F.when(F.col("o_orderkey") % 5 == 0, "Q1 FY99").otherwise(F.date_format("o_orderdate", "MMM yyyy"))
    return t.table("orders").select("o_orderkey", parse.label_month(label).alias("month"))


@query(
    "x10_folded_match",
    "SELECT p_partkey, upper(p_name) AS folded, contains(upper(p_name), 'RING') AS holds, "
    "starts_with(upper(p_name), 'RED') AS starts FROM part",
)
def x10(t):
    folded = parse.fold("p_name")
    return t.table("part").select(
        "p_partkey", folded.alias("folded"), folded.contains("RING").alias("holds"),
        folded.startswith("RED").alias("starts"),
    )


@query(
    "x11_text_hash",
    r"""SELECT doc_id, substr(sha256(normal), 1, 16) AS hash, CAST(length(normal) AS BIGINT) AS length FROM (
  SELECT doc_id, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS normal
  FROM documents)""",
)
def x11(t):
    return t.table("documents").select(
        "doc_id", parse.text_hash("text").alias("hash"),
        F.length(parse.text_normal_form("text")).cast("bigint").alias("length"),
    )


@query(
    "x12_redacted",
    """SELECT id, concat(split_part(message, 'token=', 1), 'token=REDACTED') AS message FROM logs""",
)
def x12(t):
    return t.logs.select("id", parse.redact("message").alias("message"))


# Catalog columns fed by the sources below, as the snapshot holds them.
_SCALED_COLUMNS = [
    "sales", "interest", "tax_expense", "pbt", "net_profit", "ebitda", "dividend_payout", "total_debt", "total_cash", "cfo", "fcf",
    "returnonequity", "returnoncapital", "totaldebttoequity", "currentratio", "debtordays", "cashconversioncycle",
    "revenuegrowth3years", "revenuegrowth5years", "netincomegrowth3years", "netincomegrowth5years", "roe5yearsavg", "roce3yearsavg",
    "dividendpayoutpct3yrsavg", "fcfaspctofrevenue3yearsavg",
]


def _scaled_sql(source: str, group: str, scales: dict[str, dict[str, str]]) -> str:
    parts = [
        f"SELECT '{table}' AS source, symbol, statement_type, {group} AS family, field_name, {key} AS key, round({scaled}, 6) AS scaled "
        f"FROM {table} WHERE field_name = '{field}'"
        for table, fields in scales.items()
        for field, (key, scaled) in fields.items()
    ]
    return " UNION ALL ".join(parts)


_CRORE, _PERCENT, _PLAIN = "value * 1e-7", "value * 100", "value"
X13_SQL = " UNION ALL ".join(
    [
        _scaled_sql("lines", "statement_code", {"lines": {
            "revenueFromOperations": ("'sales'", _CRORE), "financeCosts": ("'interest'", _CRORE), "taxExpense": ("'tax_expense'", _CRORE),
            "profitBeforeTax": ("'pbt'", _CRORE), "profitLossForPeriod": ("'net_profit'", _CRORE),
        }}),
        _scaled_sql("basics", "statement_code", {"basics": {
            "ebitda": ("'ebitda'", _CRORE), "dividendPayout": ("'dividend_payout'", _PERCENT), "totalDebt": ("'total_debt'", _CRORE),
            "totalCash": ("'total_cash'", _CRORE), "operatingCashFlow": ("'cfo'", _CRORE), "fcf": ("'fcf'", _CRORE),
        }}),
        _scaled_sql("ratios", "family", {"ratios": {
            "returnOnEquity": ("'returnonequity'", _PERCENT), "returnOnCapital": ("'returnoncapital'", _PERCENT),
            "totalDebtToEquity": ("'totaldebttoequity'", _PLAIN), "currentRatio": ("'currentratio'", _PLAIN),
            "debtorDays": ("'debtordays'", _PLAIN), "cashConversionCycle": ("'cashconversioncycle'", _PLAIN),
        }}),
        _scaled_sql("metrics", "family", {"metrics": {
            "revenueGrowth3years": ("'revenuegrowth3years'", _PERCENT), "revenueGrowth5years": ("'revenuegrowth5years'", _PERCENT),
            "netIncomeGrowth3years": ("'netincomegrowth3years'", _PERCENT), "netIncomeGrowth5years": ("'netincomegrowth5years'", _PERCENT),
            "roe5yearsAvg": ("'roe5yearsavg'", _PERCENT), "roce3yearsAvg": ("'roce3yearsavg'", _PERCENT),
            "dividendPayoutPct3YrsAvg": ("'dividendpayoutpct3yrsavg'", _PERCENT),
            "fcfAsPctOfRevenue3yearsAvg": ("'fcfaspctofrevenue3yearsavg'", _PERCENT),
        }}),
        f"SELECT 'snapshot', symbol, NULL, NULL, NULL, unnest([{', '.join(repr(c) for c in _SCALED_COLUMNS)}]), "
        f"round(unnest([{', '.join(_SCALED_COLUMNS)}]), 6) FROM snapshot",
    ]
)


@query("x13_unit_scales", X13_SQL)
def x13(t):
    """Every raw figure that feeds a catalog column, in the unit of that column, and what the snapshot holds of each company."""
    sources = {
        "lines": (t.lines, "statement", "statement_code"), "basics": (t.basics, "basic", "statement_code"),
        "ratios": (t.ratios, "ratio", "family"), "metrics": (t.metrics, "metric", "family"),
    }
    parts = [
        snapshot.scaled_figures(rows.select("symbol", "statement_type", F.col(group).alias("family"), "field_name", "value"), kind, "family")
        .select(F.lit(name).alias("source"), "symbol", "statement_type", "family", "field_name", "key", F.round("scaled", 6).alias("scaled"))
        for name, (rows, kind, group) in sources.items()
    ]
    held = F.array(*[F.struct(F.lit(c).alias("key"), F.round(c, 6).alias("scaled")) for c in _SCALED_COLUMNS])
    in_snapshot = snapshot_table(t).select(F.lit("snapshot").alias("source"), "symbol", F.inline(held))
    return reduce(DataFrame.unionByName, parts).unionByName(in_snapshot, allowMissingColumns=True)


@query(
    "x14_first_present",
    """SELECT symbol, statement_type, period_kind, header, coalesce(profit, before_tax, revenue) AS figure FROM (
  SELECT symbol, statement_type, period_kind, header, max(value) FILTER (WHERE field_name = 'profitLossForPeriod') AS profit,
    max(value) FILTER (WHERE field_name = 'profitBeforeTax') AS before_tax,
    max(value) FILTER (WHERE field_name = 'revenueFromOperations') AS revenue
  FROM lines GROUP BY 1, 2, 3, 4)""",
)
def x14(t):
    keys = ["symbol", "statement_type", "period_kind", "header"]
    fields = ["profitLossForPeriod", "profitBeforeTax", "revenueFromOperations"]
    wide = t.lines.groupBy(*keys).pivot("field_name", fields).agg(F.max("value"))
    return wide.select(*keys, F.coalesce(*fields).alias("figure"))


@query("x15_annualised_return", f"SELECT symbol, {r6('price_cagr_1y', 'price_cagr_3y', 'price_cagr_5y', 'price_cagr_10y')} FROM cagr")
def x15(t):
    return rounded(annualised_returns(t.prices))


# Figures of orders that stand for companies, with missing, zero and negative ones among them.
_INPUTS = {
    "price": "CASE WHEN o_orderkey % 7 = 0 THEN 0.0 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END",
    "dividend": "CASE WHEN o_orderkey % 5 = 0 THEN 0.0 WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey * 1.5 END",
    "market_cap": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice * 3 END",
    "debt": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey * 7.0 END",
    "cash": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey * 2.0 END",
    "ebitda": "CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN o_custkey * 0.001 ELSE o_custkey * 4.1 - 100.3 END",
    "pe": "CASE WHEN o_orderkey % 8 = 0 THEN 0.0 WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey - 50.3 END",
    "high": "CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_totalprice * 1.2 END",
    "low": "CASE WHEN o_orderkey % 10 = 1 THEN 0.0 WHEN o_orderkey % 10 = 2 THEN -5.0 ELSE o_totalprice * 0.4 END",
    "cfo": "CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE o_totalprice - 150000 END",
    "pat": "CASE WHEN o_orderkey % 5 = 1 THEN 0.0 ELSE o_custkey - 60.7 END",
}
_INPUT_SQL = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _INPUTS.items())


def _computed(name: str, sql: dict[str, str], stored: dict[str, str], **functions):
    """A function of figures on rows of inputs, beside the same in SQL, and on every company of the snapshot.

    `stored` names the snapshot columns shown for companies by the inputs that stand for them in rows of orders.
    """
    made = ", ".join(f"round({e}, 6) AS {n}" for n, e in sql.items())
    inputs = ", ".join(f"round({i}, 6) AS {c}" for i, c in stored.items())

    @query(
        name,
        f"SELECT o_orderkey, CAST(NULL AS VARCHAR) AS symbol, {made}, {inputs} FROM (SELECT o_orderkey, {_INPUT_SQL} FROM orders) "
        f"UNION ALL SELECT NULL, symbol, {r6(*sql, *stored.values())} FROM snapshot",
    )
    def run(t):
        orders = t.table("orders").selectExpr("o_orderkey", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in _INPUTS.items()])
        of_orders = orders.select(
            "o_orderkey", *[make().alias(n) for n, make in functions.items()], *[F.col(i).alias(c) for i, c in stored.items()]
        )
        of_companies = snapshot_table(t).select("symbol", *functions, *stored.values())
        return rounded(of_orders.unionByName(of_companies, allowMissingColumns=True))

    return run


_computed(
    "x16_dividend_yield",
    {"dividend_yield": "CASE WHEN price <> 0 AND dividend <> 0 THEN dividend * 100 / price END"},
    {"price": "current_price"},
    dividend_yield=lambda: figures.dividend_yield("dividend", "price"),
)
_EV = "market_cap + CASE WHEN debt IS NULL THEN 0 ELSE debt END - CASE WHEN cash IS NULL THEN 0 ELSE cash END"
_computed(
    "x17_enterprise_value",
    {"enterprise_value": _EV},
    {"market_cap": "market_cap", "debt": "total_debt", "cash": "total_cash"},
    enterprise_value=lambda: figures.enterprise_value("market_cap", "debt", "cash"),
)
_computed(
    "x18_ev_to_ebitda",
    {"ev_ebitda": f"CASE WHEN ebitda >= 1 OR ebitda <= -1 THEN ({_EV}) / ebitda END"},
    {"ebitda": "ebitda"},
    ev_ebitda=lambda: figures.ev_to_ebitda(figures.enterprise_value("market_cap", "debt", "cash"), "ebitda"),
)
_computed(
    "x19_earnings_yield",
    {"earnings_yield": "CASE WHEN pe <> 0 THEN 100 / pe END"},
    {"pe": "pe"},
    earnings_yield=lambda: figures.earnings_yield("pe"),
)
_computed(
    "x20_distance_from_extremes",
    {
        "down_from_52w_high": "CASE WHEN price <> 0 AND high <> 0 THEN (high - price) / high * 100 END",
        "up_from_52w_low": "CASE WHEN price <> 0 AND low > 0 THEN (price - low) / low * 100 END",
    },
    {"high": "high52", "low": "low52"},
    down_from_52w_high=lambda: figures.down_from_high("price", "high"),
    up_from_52w_low=lambda: figures.up_from_low("price", "low"),
)
_computed(
    "x21_cash_to_profit",
    {"cfo_to_pat": "CASE WHEN pat <> 0 THEN cfo / pat END"},
    {"cfo": "cfo", "pat": "net_profit"},
    cfo_to_pat=lambda: figures.cash_to_profit("cfo", "pat"),
)


@query(
    "x22_range_position",
    """SELECT symbol, round(CASE WHEN current_price IS NULL OR high52 IS NULL OR low52 IS NULL THEN NULL
  WHEN high52 - low52 > 0 THEN least(100, greatest(0, (current_price - low52) / (high52 - low52) * 100))
  ELSE 50 END, 6) AS position_52w FROM quote""",
)
def x22(t):
    return rounded(pages.range_positions(t.quote))


@query(
    "x23_display_units",
    """SELECT symbol, statement_type, statement_code, period_kind, header, field_name,
  round(value * 1e-7, 2) AS crore, round(value / 98765432101 * 100, 2) AS percent, round(value / 987654321, 2) AS plain FROM lines""",
)
def x23(t):
    share = F.col("value") / 98765432101
    return t.lines.select(
        *PERIOD_KEY, "field_name",
        figures.statement_scale("value", F.lit("crore")).alias("crore"),
        figures.statement_scale(share, F.lit("fraction_pct")).alias("percent"),
        figures.statement_scale(F.col("value") / 987654321, F.lit("price")).alias("plain"),
    )


@query(
    "x24_solvency",
    """SELECT o_orderkey, round(CASE WHEN abs(ratio) < 0.5 THEN ratio * 100 ELSE ratio END, 6) AS solvency
FROM (SELECT o_orderkey, o_totalprice / 300007 AS ratio FROM orders)""",
)
def x24(t):
    ratio = F.col("o_totalprice") / 300007
    return rounded(t.table("orders").select("o_orderkey", figures.solvency(ratio).alias("solvency")))


_DERIVED_FROM = {
    "r": "revenueFromOperations", "x": "expenses", "f": "financeCosts", "tax": "taxExpense", "p": "profitBeforeTax",
    "ie": "interestEarned", "ix": "interestExpended", "c1": "cashFlowsFromOperatingActivities",
    "c2": "cashFlowsFromInvestingActivities", "c3": "cashFlowsFromFinancingActivities",
}
DERIVED_SQL = f"""SELECT symbol, statement_type, period_kind, header,
  x - coalesce(f, 0) AS operating_expenses, r - (x - coalesce(f, 0)) AS operating_profit,
  round(CASE WHEN r <> 0 THEN (r - (x - coalesce(f, 0))) / r * 100 END, 6) AS operating_margin,
  round(CASE WHEN p <> 0 THEN nullif(tax, 0) / p * 100 END, 6) AS tax_rate,
  ie - ix AS net_interest_income, round(CASE WHEN ie <> 0 THEN (ie - ix) / ie * 100 END, 6) AS nim,
  CASE WHEN coalesce(c1, c2, c3) IS NOT NULL THEN coalesce(c1, 0) + coalesce(c2, 0) + coalesce(c3, 0) END AS net_cash_flow
FROM (SELECT symbol, statement_type, period_kind, header,
  {", ".join(f"max(value) FILTER (WHERE field_name = '{v}') AS {k}" for k, v in _DERIVED_FROM.items())}
  FROM (SELECT * REPLACE (CASE WHEN CAST(symbol AS BIGINT) % 3 <> 1 THEN field_name WHEN field_name = 'revenueFromOperations'
    THEN 'interestEarned' WHEN field_name = 'financeCosts' THEN 'interestExpended' ELSE field_name END AS field_name) FROM lines)
  GROUP BY 1, 2, 3, 4)"""


@query("x25_derived_rows", DERIVED_SQL)
def x25(t):
    keys, fields = ["symbol", "statement_type", "period_kind", "header"], list(_DERIVED_FROM.values())
    # A third of the companies report as lenders do.
    name, lender = F.col("field_name"), F.col("symbol").cast("bigint") % 3 == 1
    lent = F.when(name == "revenueFromOperations", "interestEarned").when(name == "financeCosts", "interestExpended").otherwise(name)
    lines = t.lines.withColumn("field_name", F.when(lender, lent).otherwise(name))
    wide = lines.groupBy(*keys).pivot("field_name", fields).agg(F.max("value"))

    def get(field):
        return F.col(field) if field in fields else F.lit(None).cast("double")

    shares = ("operating_margin", "tax_rate", "nim")
    derived = {n: F.round(f(get), 6) if n in shares else f(get) for n, f in FORMULAS.items()}
    return wide.select(*keys, *[c.alias(n) for n, c in derived.items()])


@query(
    "x26_absent_valuation",
    f"""SELECT index_symbol, quote_date, round(CASE WHEN NOT (pe = 0 AND pb = 0) THEN pe END, 6) AS pe,
  round(CASE WHEN NOT (pe = 0 AND pb = 0) THEN pb END, 6) AS pb,
  round(CASE WHEN NOT (pe = 0 AND pb = 0) THEN div_yield END, 6) AS div_yield FROM index_quotes""",
)
def x26(t):
    cleared = clear_absent_valuation(t.index_quotes)
    return rounded(cleared.select("index_symbol", "quote_date", "pe", "pb", "div_yield"))


@query(
    "x27_change_without_price",
    f"""SELECT symbol, CASE WHEN coalesce(current_price, 0) <= 0 AND change_pct = -100 THEN NULL ELSE change_pct END
  AS change_pct FROM ({DAMAGED_QUOTES})""",
)
def x27(t):
    price = parse.positive_or_null("current_price")
    return damaged_quotes(t).select("symbol", change_or_null(price, F.col("change_pct")).alias("change_pct"))


@query(
    "x28_rows_with_data",
    """SELECT symbol, statement_code, field_name, coalesce(max(abs(value)), 0) > 0 AS has_data FROM (
  SELECT symbol, statement_code, field_name, CASE WHEN field_name = 'taxExpense' AND CAST(symbol AS BIGINT) < 50 THEN 0
    ELSE value END AS value FROM lines) GROUP BY symbol, statement_code, field_name""",
)
def x28(t):
    emptied = F.when((F.col("field_name") == "taxExpense") & (F.col("symbol").cast("bigint") < 50), 0.0)
    rows = t.lines.select("symbol", "statement_code", "field_name", F.coalesce(emptied, F.col("value")).alias("value"))
    return rows.groupBy("symbol", "statement_code", "field_name").agg(statements.has_data("value").alias("has_data"))


@query(
    "x29_first_non_zero",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  coalesce(nullif(l_discount, 0), l_tax) AS rate FROM lineitem""",
)
def x29(t):
    rate = first_non_zero(F.col("l_discount"), F.col("l_tax"))
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", rate.alias("rate")
    )
