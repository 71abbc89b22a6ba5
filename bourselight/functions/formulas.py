"""Derived statement rows. Each formula reads the raw figures of one period through `get(field)`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bourselight.functions.figures import ratio_of

Getter = Callable[[str], Column]


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def operating_expenses(get: Getter) -> Column:
    """Expenses without the interest and depreciation shown on their own rows."""
    return get("expenses") - _or_zero(get("financeCosts")) - _or_zero(get("depreciationAndAmortisation"))


def operating_profit(get: Getter) -> Column:
    return get("revenueFromOperations") - operating_expenses(get)


def operating_margin(get: Getter) -> Column:
    return ratio_of(operating_profit(get), get("revenueFromOperations")) * 100


def first_non_zero(first: Column, second: Column) -> Column:
    """The first figure, or the second where the first is absent or zero."""
    return F.coalesce(F.nullif(first, F.lit(0.0)), second)


def tax_rate(get: Getter) -> Column:
    tax = first_non_zero(get("taxExpense"), get("provisionForTax"))
    profit = first_non_zero(get("profitBeforeTax"), get("profitLossBeforeTax"))
    return ratio_of(tax, profit) * 100


def net_interest_income(get: Getter) -> Column:
    return get("interestEarned") - get("interestExpended")


def net_interest_margin(get: Getter) -> Column:
    return ratio_of(net_interest_income(get), get("interestEarned")) * 100


def net_cash_flow(get: Getter) -> Column:
    """Sum of the flows that are present, NULL when none is."""
    flows = [
        get("cashFlowsFromOperatingActivities"),
        get("cashFlowsFromInvestingActivities"),
        get("cashFlowsFromFinancingActivities"),
    ]
    return F.when(F.coalesce(*flows).isNotNull(), _or_zero(flows[0]) + _or_zero(flows[1]) + _or_zero(flows[2]))


FORMULAS: dict[str, Callable[[Getter], Column]] = {
    "operating_expenses": operating_expenses,
    "operating_profit": operating_profit,
    "operating_margin": operating_margin,
    "tax_rate": tax_rate,
    "net_interest_income": net_interest_income,
    "nim": net_interest_margin,
    "net_cash_flow": net_cash_flow,
}
