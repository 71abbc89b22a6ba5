"""Reshaping and statement rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselight.operators.normalise import HORIZONS, PERIOD_KEY
from bourselight.plans import pages, statements
from workload.registry import names, query, rounded

KEY = names(PERIOD_KEY)


@query(
    "r01_unpivot_measures",
    "\nUNION ALL ".join(
        f"SELECT {KEY}, '{m}' AS field_name, {m} AS value FROM statement_wide" for m in "eqdt"
    ),
)
def r01(t):
    return t.statement_wide.unpivot(list(PERIOD_KEY), list("eqdt"), "field_name", "value")


@query(
    "r02_field_maps",
    f"""SELECT {KEY}, count(*) AS fields, max(value) FILTER (WHERE field_name = 'revenueFromOperations') AS sales,
  max(value) FILTER (WHERE field_name = 'assets') AS assets FROM figures GROUP BY {KEY}""",
)
def r02(t):
    shown = statements.with_type_fallback(statements.last_periods(t.periods))
    maps = statements.field_maps(statements.merged_figures(shown, t.lines, t.basics))
    figure = lambda f: F.try_element_at("figures", F.lit(f))
    return maps.select(
        *PERIOD_KEY, F.size("figures").cast("bigint").alias("fields"),
        figure("revenueFromOperations").alias("sales"), figure("assets").alias("assets"),
    )


@query(
    "r03_ratio_pivot",
    """SELECT symbol, CASE family WHEN 'pr' THEN 'profitability' WHEN 'le' THEN 'leverage' WHEN 'li' THEN 'liquidity'
    ELSE 'efficiency' END AS family, field_name AS label, CASE family WHEN 'pr' THEN 'percent' ELSE 'ratio' END AS unit,
  header, CAST(CASE header WHEN 'TTM' THEN 1000000 ELSE year END AS INTEGER) AS header_order,
  round(value * CASE family WHEN 'pr' THEN 100.0 ELSE 1.0 END, 2) AS value
FROM ratios WHERE statement_type = 'c'""",
)
def r03(t):
    return statements.named_families(statements.ratio_table(t.ratios))


@query(
    "r04_shareholding_pattern",
    """WITH recent AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY strptime(period_label, '%b %Y') DESC)
    AS position FROM shareholding QUALIFY position <= 16)
SELECT symbol, CASE group_name WHEN 'promoterAndPromoterGroup' THEN 'Promoters' WHEN 'publicShareholding' THEN 'Public'
    WHEN 'nonPromoterNonPublic' THEN 'Non-promoter non-public' ELSE group_name END AS label, 'percent' AS unit,
  period_label, CAST(position AS INTEGER) AS position, round(shareholding_pct, 6) AS value FROM recent
UNION ALL SELECT symbol, 'No. of Shareholders', 'count', period_label, CAST(min(position) AS INTEGER),
  sum(total_shareholders) FROM recent GROUP BY symbol, period_label""",
)
def r04(t):
    return rounded(statements.shareholding_pattern(t.shareholding))


@query(
    "r05_returns_by_horizon",
    "SELECT index_symbol, "
    + ", ".join(f"round(max(return_pct) FILTER (WHERE horizon = '{h}'), 6) AS return_{h.lower()}" for h in HORIZONS)
    + " FROM index_returns GROUP BY index_symbol",
)
def r05(t):
    return rounded(pages.returns_by_horizon(t.index_returns))


def _field(name: str) -> str:
    return f"max(value) FILTER (WHERE field_name = '{name}')"


def _crore(expression: str) -> str:
    return f"round(({expression}) * 1e-7, 2)"


# Template rows that the test figures fill: code, order, parent, label, unit, emphasis, value.
_SQL_ROWS = [
    ("pl", 100, None, "Sales", "crore", False, _crore("r")),
    ("pl", 200, None, "Expenses", "crore", False, _crore("x - coalesce(f, 0)")),
    ("pl", 300, None, "Operating Profit", "crore", True, _crore("r - (x - coalesce(f, 0))")),
    ("pl", 400, None, "OPM %", "percent", False, "round((r - (x - coalesce(f, 0))) / nullif(r, 0) * 100, 2)"),
    ("pl", 600, None, "Interest", "crore", False, _crore("f")),
    ("pl", 800, None, "Profit before tax", "crore", True, _crore("p")),
    ("pl", 900, None, "Tax %", "percent", False, "round(nullif(tax, 0) / nullif(p, 0) * 100, 2)"),
    ("pl", 1000, None, "Net Profit", "crore", True, _crore("np")),
    ("pl", 1200, None, "Dividend Payout %", "fraction_pct", False, "round(dp * 100, 2)"),
    ("bs", 100, None, "Equity Capital", "crore", False, _crore("eq")),
    ("bs", 200, None, "Reserves", "crore", False, _crore("rs")),
    ("bs", 300, None, "Borrowings", "crore", False, _crore("bo")),
    ("bs", 301, 300, "Long term borrowings", "crore", False, _crore("bo")),
    ("bs", 1000, None, "Total Assets", "crore", True, _crore("a")),
    ("cf", 100, None, "Cash from Operating Activity", "crore", False, _crore("c1")),
    ("cf", 200, None, "Cash from Investing Activity", "crore", False, _crore("c2")),
    ("cf", 300, None, "Cash from Financing Activity", "crore", False, _crore("c3")),
    ("cf", 400, None, "Net Cash Flow", "crore", True, _crore("nc")),
    ("cf", 500, None, "Free Cash Flow", "crore", False, _crore("fc")),
]


def rendered_sql(source: str) -> str:
    fields = {
        "r": "revenueFromOperations", "x": "expenses", "f": "financeCosts", "tax": "taxExpense",
        "p": "profitBeforeTax", "np": "profitLossForPeriod", "dp": "dividendPayout", "eq": "equityCapital",
        "rs": "reserves", "bo": "borrowingsNoncurrent", "a": "assets", "c1": "cashFlowsFromOperatingActivities",
        "c2": "cashFlowsFromInvestingActivities", "c3": "cashFlowsFromFinancingActivities", "nc": "netCashFlow",
        "fc": "fcf",
    }
    wide = f"SELECT {KEY}, {', '.join(f'{_field(v)} AS {k}' for k, v in fields.items())} FROM {source} GROUP BY {KEY}"
    rows = "\nUNION ALL ".join(
        f"SELECT {KEY}, CAST({o} AS INTEGER) AS ord, CAST({p or 'NULL'} AS INTEGER) AS parent, '{label}' AS label, "
        f"'{unit}' AS unit, {'true' if e else 'false'} AS emphasis, {value} AS value FROM wide "
        f"WHERE statement_code = '{code}'"
        for code, o, p, label, unit, e, value in _SQL_ROWS
    )
    return f"""WITH wide AS ({wide}), cells AS ({rows})
SELECT {KEY}, ord, parent, label, unit, emphasis, value FROM cells
QUALIFY max(abs(coalesce(value, 0))) OVER (PARTITION BY symbol, statement_type, statement_code, period_kind, ord) > 0"""


@query(
    "r06_rendered_templates",
    rendered_sql(
        "(SELECT l.* FROM lines l SEMI JOIN recent_periods USING (symbol, statement_type, statement_code, period_kind, header))"
    ),
)
def r06(t):
    """Both statement types of every company in the general layout, without fallback or derived aggregates."""
    recent = statements.last_periods(t.periods)
    own = recent.select(*PERIOD_KEY).join(t.lines, list(PERIOD_KEY)).select(*PERIOD_KEY, "field_name", "value")
    placed = statements.field_maps(own).join(recent.select(*PERIOD_KEY, "position", "schema_kind"), list(PERIOD_KEY))
    known = statements.with_family(placed, t.company)
    laid_out = known.withColumn("layout", statements.layout_of(F.lit("general"), F.col("statement_code")))
    return statements.render(laid_out).drop("layout", "position", "schema_kind")


@query("r07_statement_tables", rendered_sql("figures"))
def r07(t):
    tables = statements.statement_tables(t.periods, t.lines, t.basics, t.company)
    return tables.select(*PERIOD_KEY, "ord", "parent", "label", "unit", "emphasis", "value")


# P&L figures of the tables, reported by companies of three other families: field sent, factor, family's field.
_REPORTED = {
    "bank": (
        ("revenueFromOperations", 1.0, "interestEarned"), ("expenses", 1.0, "interestExpended"),
        ("financeCosts", 1.0, "expenditureExcludingProvisions"), ("taxExpense", 1.0, "employeesCost"),
        ("taxExpense", 2.0, "provisionForTax"), ("profitBeforeTax", 1.0, "profitLossBeforeTax"),
        ("profitLossForPeriod", 1.0, "profitLossForThePeriod"), ("financeCosts", 1e-9, "percentageOfGrossNpa"),
        ("expenses", 1e-9, "cET1Ratio"),
    ),
    "life_insurance": (
        ("revenueFromOperations", 1.0, "grossPremiumIncome"), ("taxExpense", 1.0, "incomeFirstYearPremium"),
        ("expenses", 1.0, "netPremiumIncome"), ("financeCosts", 1.0, "commission"),
        ("profitBeforeTax", 1.0, "profitOrLossBeforeTax"),
        ("profitLossForPeriod", 1.0, "profitLossAfterTaxAndExtraordinaryItems"),
        ("revenueFromOperations", 1e-11, "solvencyRatio"), ("expenses", 1e-9, "persistencyRatio"),
    ),
    "general_insurance": (
        ("revenueFromOperations", 1.0, "premiumEarned"), ("expenses", 1.0, "claimsPaid"), ("financeCosts", 1.0, "netCommission"),
        ("profitBeforeTax", 1.0, "underwritingProfitOrLoss"), ("profitLossForPeriod", 1.0, "profitLossAfterTax"),
        ("taxExpense", 1e-5, "eps"), ("expenses", 1e-9, "combinedRatio"), ("revenueFromOperations", 1e-10, "solvencyRatio"),
    ),
}
_SOLVENCY = "round(CASE WHEN abs({0}) < 0.5 THEN ({0}) * 100 ELSE {0} END, 2)"
# Family by symbol, order, parent, label, unit, emphasis, value.
_FAMILY_ROWS = [
    *[(0, *row[1:]) for row in _SQL_ROWS[:8]],
    (1, 100, None, "Revenue", "crore", False, _crore("r")),
    (1, 200, None, "Interest", "crore", False, _crore("x")),
    (1, 300, None, "Expenses", "crore", False, _crore("f")),
    (1, 301, 300, "Employee cost", "crore", False, _crore("tax")),
    (1, 400, None, "Financing Profit", "crore", True, _crore("r - x")),
    (1, 500, None, "Financing Margin %", "percent", False, "round((r - x) / nullif(r, 0) * 100, 2)"),
    (1, 800, None, "Profit before tax", "crore", True, _crore("p")),
    (1, 900, None, "Tax %", "percent", False, "round(tax * 2 / nullif(p, 0) * 100, 2)"),
    (1, 1000, None, "Net Profit", "crore", True, _crore("np")),
    (1, 1200, None, "Gross NPA %", "fraction_pct", False, "round(f * 1e-9 * 100, 2)"),
    (1, 1400, None, "CET1 Ratio", "fraction_pct", False, "round(x * 1e-9 * 100, 2)"),
    (2, 100, None, "Gross Premium Income", "crore", False, _crore("r")),
    (2, 101, 100, "First year premium", "crore", False, _crore("tax")),
    (2, 200, None, "Net Premium Income", "crore", True, _crore("x")),
    (2, 400, None, "Commission", "crore", False, _crore("f")),
    (2, 900, None, "Profit before tax", "crore", True, _crore("p")),
    (2, 1000, None, "Net Profit", "crore", True, _crore("np")),
    (2, 1200, None, "Solvency Ratio", "solvency", False, _SOLVENCY.format("r * 1e-11")),
    (2, 1300, None, "Persistency Ratio", "fraction_pct", False, "round(x * 1e-9 * 100, 2)"),
    (3, 300, None, "Premium Earned", "crore", True, _crore("r")),
    (3, 500, None, "Claims Incurred", "crore", False, _crore("x")),
    (3, 600, None, "Commission", "crore", False, _crore("f")),
    (3, 800, None, "Underwriting Profit", "crore", True, _crore("p")),
    (3, 1000, None, "Net Profit", "crore", True, _crore("np")),
    (3, 1100, None, "EPS in Rs", "price", False, "round(tax * 1e-5, 2)"),
    (3, 1300, None, "Combined Ratio", "fraction_pct", False, "round(x * 1e-9 * 100, 2)"),
    (3, 1400, None, "Solvency Ratio", "solvency", False, _SOLVENCY.format("r * 1e-10")),
]
_FAMILIES = ("general", *_REPORTED)
_FAMILY_CELLS = "\nUNION ALL ".join(
    f"SELECT {KEY}, '{_FAMILIES[family]}' AS family, CAST({o} AS INTEGER) AS ord, CAST({p or 'NULL'} AS INTEGER) AS parent, "
    f"'{label}' AS label, '{unit}' AS unit, {'true' if e else 'false'} AS emphasis, {value} AS value FROM wide "
    f"WHERE CAST(symbol AS BIGINT) % 4 = {family}"
    for family, o, p, label, unit, e, value in _FAMILY_ROWS
)
_WIDE_FIELDS = {
    "r": "revenueFromOperations", "x": "expenses", "f": "financeCosts", "tax": "taxExpense", "p": "profitBeforeTax",
    "np": "profitLossForPeriod",
}


@query(
    "r09_family_layouts",
    f"""WITH wide AS (SELECT {KEY}, {', '.join(f'{_field(v)} AS {k}' for k, v in _WIDE_FIELDS.items())}
  FROM lines SEMI JOIN shown_periods USING (symbol, statement_type, statement_code, period_kind, header)
  WHERE statement_code = 'pl' GROUP BY {KEY}),
cells AS ({_FAMILY_CELLS})
SELECT {KEY}, family, ord, parent, label, unit, emphasis, value FROM cells
QUALIFY max(abs(coalesce(value, 0))) OVER (PARTITION BY symbol, statement_type, period_kind, ord) > 0
  AND max(CASE WHEN parent IS NULL THEN abs(coalesce(value, 0)) END)
    OVER (PARTITION BY symbol, statement_type, period_kind, coalesce(parent, ord)) > 0""",
)
def r09(t):
    """P&L statements of all four families: three quarters of the companies report as banks and insurers."""
    which = F.col("symbol").cast("bigint") % 4
    family = F.element_at(F.array(*[F.lit(f) for f in _FAMILIES]), (which + 1).cast("int"))
    # Periods carry the family for banks; insurers are known by their company alone.
    of_period = F.when(which == 1, "bank").when(which == 0, "general").otherwise("unknown")
    periods = t.periods.where(F.col("statement_code") == "pl").withColumn("schema_kind", of_period)
    company = t.company.withColumn("schema_kind", F.when(which >= 2, family))
    # The renamed fields of a line as conditions on its family and field: nothing is searched per row.
    own = F.lit(None).cast("array<struct<factor:double,to:string>>")
    for k, fields in enumerate(_REPORTED.values(), 1):
        renamed = F.lit(None).cast("array<struct<factor:double,to:string>>")
        for of in dict.fromkeys(field for field, _, _ in fields):
            to = F.array(*[F.struct(F.lit(x).alias("factor"), F.lit(f).alias("to")) for field, x, f in fields if field == of])
            renamed = F.when(F.col("field_name") == of, to).otherwise(renamed)
        own = F.when(which == k, renamed).otherwise(own)
    plain = F.array(F.struct(F.lit(1.0).alias("factor"), F.col("field_name").alias("to")))
    lines = t.lines.where(F.col("statement_code") == "pl").withColumn("_s", F.explode(F.when(which == 0, plain).otherwise(own)))
    reported = lines.withColumns({"field_name": F.col("_s.to"), "value": F.col("value") * F.col("_s.factor")}).drop("_s")
    tables = statements.statement_tables(periods, reported, t.basics.limit(0), company)
    return tables.select(*PERIOD_KEY, F.col("schema_kind").alias("family"), "ord", "parent", "label", "unit", "emphasis", "value")


@query(
    "r08_index_buckets",
    """SELECT coalesce(nullif(index_sub_type, ''), 'Other') AS bucket, count(*) AS indices,
  min(index_symbol) AS first_index FROM index_master GROUP BY 1""",
)
def r08(t):
    return pages.index_buckets(t.index_master)
