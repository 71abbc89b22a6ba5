"""Computed figures, display units and derived statement rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bourselight.functions import figures
from bourselight.functions.formulas import FORMULAS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def num(v):
    return F.lit(v).cast("double")


def cases():
    """Columns need a running session, so they are made inside the test."""
    return [
        (figures.annualised_return(num(121.0), num(100.0), 2), 10.0),
        (figures.annualised_return(num(121.0), num(0.0), 2), None),
        (figures.dividend_yield(num(5.0), num(100.0)), 5.0),
        (figures.dividend_yield(num(0.0), num(100.0)), None),
        (figures.dividend_yield(num(5.0), num(0.0)), None),
        (figures.enterprise_value(num(100.0), num(None), num(30.0)), 70.0),
        (figures.enterprise_value(num(None), num(1.0), num(30.0)), None),
        (figures.ev_to_ebitda(num(187894.0), num(-0.03)), None),
        (figures.ev_to_ebitda(num(100.0), num(-2.0)), -50.0),
        (figures.earnings_yield(num(20.0)), 5.0),
        (figures.earnings_yield(num(0.0)), None),
        (figures.down_from_high(num(75.0), num(100.0)), 25.0),
        (figures.up_from_low(num(75.0), num(0.0)), None),
        (figures.up_from_low(num(75.0), num(50.0)), 50.0),
        (figures.cash_to_profit(num(3.0), num(0.0)), None),
        (figures.cash_to_profit(num(3.0), num(2.0)), 1.5),
        (figures.range_position(num(200.0), num(50.0), num(150.0)), 100.0),
        (figures.range_position(num(75.0), num(50.0), num(150.0)), 25.0),
        (figures.range_position(num(75.0), num(75.0), num(75.0)), 50.0),
        (figures.range_position(num(None), num(75.0), num(80.0)), None),
        (figures.solvency(num(0.0235)), 2.35),
        (figures.solvency(num(1.85)), 1.85),
        (figures.solvency(num(0.8)), 0.8),
        (figures.statement_scale(num(123456789.0), F.lit("crore")), 12.35),
        (figures.statement_scale(num(0.0921), F.lit("fraction_pct")), 9.21),
        (figures.statement_scale(num(0.0267), F.lit("solvency")), 2.67),
        (figures.statement_scale(num(24.837), F.lit("price")), 24.84),
    ]


def test_figures(spark):
    for i, (column, want) in enumerate(cases()):
        got = one(spark, column)
        assert got == (pytest.approx(want) if want is not None else None), i


def formula(spark, name, **values):
    return one(spark, FORMULAS[name](lambda f: num(values.get(f))))


def test_operating_rows_reconcile(spark):
    year = {"revenueFromOperations": 100.0, "expenses": 90.0, "financeCosts": 5.0, "depreciationAndAmortisation": 10.0}
    assert formula(spark, "operating_expenses", **year) == 75.0
    assert formula(spark, "operating_profit", **year) == 25.0
    assert formula(spark, "operating_margin", **year) == 25.0
    assert formula(spark, "operating_margin", **{**year, "revenueFromOperations": 0.0}) is None
    assert formula(spark, "operating_expenses", financeCosts=5.0) is None


def test_tax_rate_takes_the_first_non_zero_field(spark):
    assert formula(spark, "tax_rate", taxExpense=0.0, provisionForTax=25.0, profitBeforeTax=100.0) == 25.0
    assert formula(spark, "tax_rate", taxExpense=25.0, profitBeforeTax=0.0, profitLossBeforeTax=50.0) == 50.0
    assert formula(spark, "tax_rate", taxExpense=0.0, profitBeforeTax=100.0) is None
    assert formula(spark, "tax_rate", taxExpense=25.0, profitBeforeTax=0.0) is None


def test_bank_and_cash_rows(spark):
    assert formula(spark, "net_interest_income", interestEarned=10.0, interestExpended=4.0) == 6.0
    assert formula(spark, "nim", interestEarned=10.0, interestExpended=4.0) == 60.0
    assert formula(spark, "nim", interestEarned=0.0, interestExpended=4.0) is None
    flows = {"cashFlowsFromOperatingActivities": 10.0, "cashFlowsFromFinancingActivities": -4.0}
    assert formula(spark, "net_cash_flow", **flows) == 6.0
    assert formula(spark, "net_cash_flow") is None
