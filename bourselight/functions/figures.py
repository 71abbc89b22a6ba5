"""Computed figures of a company: returns, yields, enterprise value, range position, unit scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRORE = 1e-7
MIN_EBITDA_FOR_MULTIPLE = 1.0
SOLVENCY_SPLIT = 0.5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_of(a: Column, b: Column) -> Column:
    """a / b, NULL on a zero divisor."""
    return a / F.nullif(b, F.lit(0.0))


def annualised_return(latest: Column | str, past: Column | str, years: int) -> Column:
    latest, past = _col(latest), _col(past)
    exponent = F.lit(1.0 / years)
    return F.when(past > 0, (F.pow(latest / past, exponent) - 1) * 100)


def dividend_yield(dividend: Column | str, price: Column | str) -> Column:
    dividend, price = _col(dividend), _col(price)
    return F.when((dividend != 0) & (price != 0), dividend / F.nullif(price, F.lit(0.0)) * 100)


def enterprise_value(market_cap: Column | str, debt: Column | str, cash: Column | str) -> Column:
    return _col(market_cap) + F.coalesce(_col(debt), F.lit(0.0)) - F.coalesce(_col(cash), F.lit(0.0))


def ev_to_ebitda(ev: Column | str, ebitda: Column | str) -> Column:
    """NULL under one crore of EBITDA, where the multiple is noise."""
    ebitda = _col(ebitda)
    return F.when(F.abs(ebitda) >= MIN_EBITDA_FOR_MULTIPLE, ratio_of(_col(ev), ebitda))


def earnings_yield(pe: Column | str) -> Column:
    return ratio_of(F.lit(100.0), _col(pe))


def down_from_high(price: Column | str, high: Column | str) -> Column:
    price, high = _col(price), _col(high)
    return F.when(price != 0, ratio_of(high - price, high) * 100)


def up_from_low(price: Column | str, low: Column | str) -> Column:
    price, low = _col(price), _col(low)
    return F.when((price != 0) & (low > 0), ratio_of(price - low, low) * 100)


def cash_to_profit(cfo: Column | str, profit: Column | str) -> Column:
    return ratio_of(_col(cfo), _col(profit))


def range_position(price: Column | str, low: Column | str, high: Column | str) -> Column:
    """Where the price lies between the year's low and high, 0 to 100; 50 for a flat range."""
    price, low, high = _col(price), _col(low), _col(high)
    span = high - low
    inside = F.least(F.lit(100.0), F.greatest(F.lit(0.0), ratio_of(price - low, span) * 100))
    known = price.isNotNull() & span.isNotNull()
    return F.when(known, F.when(span > 0, inside).otherwise(F.lit(50.0)))


def solvency(raw: Column | str) -> Column:
    """Solvency is sent as a multiple or as hundredths of one; a value under 0.5 is the latter."""
    raw = _col(raw)
    return F.when(F.abs(raw) < SOLVENCY_SPLIT, raw * 100).otherwise(raw)


def statement_scale(raw: Column | str, unit: Column | str) -> Column:
    """A raw statement figure in its display unit, to two places."""
    raw, unit = _col(raw), _col(unit)
    scaled = (
        F.when(unit == "crore", raw * CRORE)
        .when(unit == "fraction_pct", raw * 100)
        .when(unit == "solvency", solvency(raw))
        .otherwise(raw)
    )
    return F.round(scaled, 2)
