"""Statement tables, ratio tables and shareholding patterns."""

from __future__ import annotations

import datetime as dt

import pytest

from bourselight import templates
from bourselight.plans import statements

PERIOD = ("symbol string, statement_type string, statement_code string, period_kind string, header string, year int, "
          "period_end date, result_date date, schema_kind string")
LINE = "symbol string, statement_type string, statement_code string, period_kind string, header string, field_name string, value double"
BASIC = "symbol string, statement_type string, statement_code string, header string, year int, field_name string, value double"


def period(year, kind="annual", type_="c", family="general", symbol="A", code="pl", month=3):
    end = dt.date(year, month, 28)
    return (symbol, type_, code, kind, end.strftime("%b %Y"), year, end, None, family)


def tables(spark, periods, figures, basics=(), family=None):
    p = spark.createDataFrame(periods, PERIOD)
    rows = [(*key[:5], f, v) for key, values in zip(periods, figures, strict=True) for f, v in values.items()]
    out = statements.statement_tables(
        p, spark.createDataFrame(rows, LINE), spark.createDataFrame(list(basics), BASIC),
        spark.createDataFrame([("A", family)], "symbol string, schema_kind string"))
    return {(r["label"], r["header"]): r["value"] for r in out.collect()}


FULL = {"revenueFromOperations": 1e9, "expenses": 9e8, "financeCosts": 5e7, "depreciationAndAmortisation": 1e8,
        "profitBeforeTax": 1e8, "taxExpense": 2.5e7, "costOfMaterialsConsumed": 3e8, "otherExpenses": 0.0}


def test_rows_reconcile_and_empty_rows_go(spark):
    got = tables(spark, [period(2026), period(2025)], [FULL, {"revenueFromOperations": 8e8}])
    at = lambda label: got.get((label, "Mar 2026"))
    assert (at("Sales"), at("Expenses"), at("Operating Profit"), at("OPM %"), at("Tax %")) == (100.0, 75.0, 25.0, 25.0, 25.0)
    assert at("Cost of materials consumed") == 30.0
    assert got[("Sales", "Mar 2025")] == 80.0 and got[("Expenses", "Mar 2025")] is None
    labels = {label for label, _ in got}
    assert "Other expenses" not in labels and "EPS in Rs" not in labels and "Other Income" not in labels


def test_children_of_a_dropped_row_go(spark):
    got = tables(spark, [period(2026)], [{"revenueFromOperations": 1e9, "dividendIncome": 5e7}])
    assert {label for label, _ in got} == {"Sales"}


def test_fallback_to_the_other_type(spark):
    got = tables(spark, [period(2026, type_="s")], [FULL])
    assert got[("Sales", "Mar 2026")] == 100.0
    both = tables(spark, [period(2026, type_="s"), period(2025, type_="c")], [FULL, FULL])
    assert {h for _, h in both} == {"Mar 2025"}


def test_last_sixteen_periods(spark):
    years = range(2000, 2020)
    got = tables(spark, [period(y) for y in years], [{"revenueFromOperations": 1e9}] * 20)
    assert sorted(h for _, h in got) == sorted(f"Mar {y}" for y in range(2004, 2020))


def test_aggregates_fill_annual_gaps_only(spark):
    basics = [("A", "c", "pl", "Mar 2026", 2026, "dividendPayout", 0.0921), ("A", "c", "pl", "Mar 2026", 2026, "revenueFromOperations", 5e9)]
    periods = [period(2026), period(2026, kind="quarterly")]
    got = tables(spark, periods, [{"revenueFromOperations": 1e9}] * 2, basics)
    assert got == {("Sales", "Mar 2026"): 100.0, ("Dividend Payout %", "Mar 2026"): 9.21}
    quarterly = tables(spark, periods[1:], [{"revenueFromOperations": 1e9}], basics)
    assert quarterly == {("Sales", "Mar 2026"): 100.0}


@pytest.mark.parametrize(("of_period", "of_company"), [("bank", None), ("unknown", "bank"), (None, "bank")])
def test_family_decides_the_layout(spark, of_period, of_company):
    figures = {"interestEarned": 1e9, "interestExpended": 4e8, "percentageOfGrossNpa": 0.0128}
    got = tables(spark, [period(2026, family=of_period)], [figures], family=of_company)
    assert got == {("Revenue", "Mar 2026"): 100.0, ("Interest", "Mar 2026"): 40.0, ("Financing Profit", "Mar 2026"): 60.0,
                   ("Financing Margin %", "Mar 2026"): 60.0, ("Gross NPA %", "Mar 2026"): 1.28}


def test_solvency_is_read_in_both_conventions(spark):
    periods = [period(2026, family="life_insurance"), period(2025, family="life_insurance")]
    got = tables(spark, periods, [{"solvencyRatio": 0.0235}, {"solvencyRatio": 1.85}])
    assert got == {("Solvency Ratio", "Mar 2026"): 2.35, ("Solvency Ratio", "Mar 2025"): 1.85}


def test_layouts():
    assert {r.layout for r in templates.ROWS} >= set(templates.PL_LAYOUTS.values()) | set(templates.SHARED_LAYOUTS.values())
    assert [r.label for r in templates.layout_rows("general_cf")][-1] == "Free Cash Flow"
    sales = templates.layout_rows("general_pl")[0]
    assert (sales.label, sales.unit, sales.fields, sales.parent) == ("Sales", "crore", ["revenueFromOperations"], None)


def test_ratio_table(spark):
    rows = [("A", "c", "pr", "TTM", 2026, "roe", 0.12345), ("A", "c", "pr", "Mar 2025", 2025, "roe", 0.1), ("A", "s", "pr", "TTM", 2026, "roe", 9.0)]
    df = spark.createDataFrame(rows, "symbol string, statement_type string, family string, header string, year int, field_name string, value double")
    got = [(r["header"], r["unit"], r["value"]) for r in statements.ratio_table(df).orderBy("header_order").collect()]
    assert got == [("Mar 2025", "percent", 10.0), ("TTM", "percent", 12.35)]


def test_shareholders_are_summed_and_empty_groups_go(spark):
    rows = [("A", "Jun 2026", "promoterAndPromoterGroup", 50.0, 47.0), ("A", "Jun 2026", "publicShareholding", 49.0, 4651816.0),
            ("A", "Jun 2026", "nonPromoterNonPublic", None, None), ("A", "Mar 2026", "publicShareholding", None, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, period_label string, group_name string, shareholding_pct double, total_shareholders double")
    got = {(r["label"], r["period_label"]): r["value"] for r in statements.shareholding_pattern(df).collect()}
    assert got == {("Promoters", "Jun 2026"): 50.0, ("Public", "Jun 2026"): 49.0, ("Public", "Mar 2026"): None,
                   ("No. of Shareholders", "Jun 2026"): 4651863.0}


def test_only_the_last_sixteen_quarters(spark):
    months = ["Mar", "Jun", "Sep", "Dec"]
    rows = [("A", f"{m} {y}", "publicShareholding", 1.0, 1.0) for y in range(2016, 2026) for m in months]
    df = spark.createDataFrame(rows, "symbol string, period_label string, group_name string, shareholding_pct double, total_shareholders double")
    shown = {r["period_label"] for r in statements.last_quarters(df).collect()}
    assert shown == {f"{m} {y}" for y in range(2022, 2026) for m in months}
