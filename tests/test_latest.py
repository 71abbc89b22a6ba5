"""Latest-per-key picks and price-derived figures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bourselight.operators import latest

LINE = ("symbol string, statement_type string, statement_code string, period_kind string, header string, year int, "
        "period_end date, field_name string, value double")


def lines(spark, *rows):
    full = [("A", kind, "pl", period, header, year, dt.date(year or 2000, 3, 31), "sales", value)
            for kind, period, header, year, value in rows]
    return spark.createDataFrame(full, LINE)


def best(spark, *rows):
    got = latest.latest_statement_values(latest.usable_statement_lines(lines(spark, *rows))).collect()
    return got[0]["value"] if got else None


def test_consolidated_beats_standalone_and_ttm_beats_annual(spark):
    assert best(spark, ("s", "annual", "Mar 2026", 2026, 1.0), ("c", "annual", "Mar 2025", 2025, 2.0)) == 2.0
    assert best(spark, ("c", "annual", "Mar 2026", 2026, 1.0), ("c", "ttm", "TTM", 2026, 2.0)) == 2.0
    assert best(spark, ("c", "annual", "Mar 2026", 2026, 1.0), ("c", "annual", "Mar 2025", 2025, 2.0)) == 1.0


def test_missing_figures_and_quarters_do_not_count(spark):
    assert best(spark, ("c", "ttm", "TTM", 2026, None), ("s", "annual", "Mar 2020", 2020, 2.0)) == 2.0
    assert best(spark, ("c", "quarterly", "Jun 2026", 2026, 9.0)) is None


def test_ttm_without_a_year_loses_to_annual(spark):
    assert best(spark, ("c", "ttm", "TTM", None, 9.0), ("s", "annual", "Mar 2001", 2001, 2.0)) == 2.0


def test_metric_gap_filled_by_standalone(spark):
    rows = [("A", "c", "gr", "x", None), ("A", "s", "gr", "x", 1.0), ("A", "s", "gr", "y", 1.0), ("A", "c", "gr", "y", 2.0)]
    df = spark.createDataFrame(rows, "symbol string, statement_type string, family string, field_name string, value double")
    assert {r["field_name"]: r["value"] for r in latest.preferred_metrics(df).collect()} == {"x": 1.0, "y": 2.0}


def test_newest_valuation_row_is_taken_whole(spark):
    d = dt.date
    rows = [("A", "s", d(2026, 8, 5), 45.7, 3.0), ("A", "c", d(2026, 8, 5), 24.0, None), ("A", "c", d(2026, 8, 4), 25.0, 9.0)]
    df = spark.createDataFrame(rows, "symbol string, statement_type string, quote_date date, pe double, pb double")
    full = df.withColumns({c: F.lit(None).cast("double") for c in ("ptb", "ps", "pfcf")})
    row = latest.latest_valuation(full).collect()[0]
    assert (row["pe"], row["pb"]) == (24.0, None)


def test_holdings_come_from_the_newest_quarter_only(spark):
    rows = [("A", "Jun 2026", "publicShareholding", 40.0, None), ("A", "Mar 2026", "promoterAndPromoterGroup", 60.0, 5.0),
            ("B", "Dec 2025", "promoterAndPromoterGroup", 50.0, 1.0), ("B", "Mar 2026", "promoterAndPromoterGroup", 51.0, None)]
    df = spark.createDataFrame(rows, "symbol string, period_label string, group_name string, shareholding_pct double, pledged_pct double")
    got = {r["symbol"]: tuple(r)[1:] for r in latest.latest_shareholding(df).collect()}
    assert got == {"A": (None, None, 40.0), "B": (51.0, None, None)}


def test_dividends_of_the_last_twelve_months(spark):
    d = dt.date
    rows = [("A", "dividend", d(2025, 8, 6), 1.0), ("A", "dividend", d(2025, 8, 7), 2.0), ("A", "dividend", d(2026, 8, 6), 4.0),
            ("A", "dividend", d(2026, 8, 31), 8.0), ("A", "split", d(2026, 1, 1), 16.0), ("A", "dividend", d(2026, 1, 1), None)]
    df = spark.createDataFrame(rows, "symbol string, action string, ex_date date, amount double")
    got = latest.trailing_dividends(df, F.lit("2026-08-06").cast("date")).collect()
    assert [(r["symbol"], r["dividend"]) for r in got] == [("A", 6.0)]


def series(spark, days, last=dt.date(2026, 8, 6), symbol="A"):
    rows = [(symbol, last - dt.timedelta(days=n), float(close), 10.0) for n, close in days]
    return spark.createDataFrame(rows, "symbol string, quote_date date, close double, volume double")


@pytest.mark.parametrize(
    ("days", "want"),
    [
        ([(0, 200), (364, 150), (365, 100)], 100.0),
        ([(0, 200), (370, 100)], 100.0),
        ([(0, 200), (401, 100)], 100.0),
        ([(0, 200), (402, 100)], None),
        ([(0, 200), (364, 100)], None),
    ],
)
def test_close_a_year_ago(spark, days, want):
    row = latest.closes_years_ago(series(spark, days)).collect()[0]
    assert (row["latest"], row["close_1y"]) == (200.0, want)


def test_returns_are_annualised(spark):
    row = latest.annualised_returns(series(spark, [(0, 133.1), (1096, 100.0)])).collect()[0]
    assert row["price_cagr_3y"] == pytest.approx(10.0)
    assert row["price_cagr_1y"] is None


def test_moving_figures_need_enough_sessions(spark):
    short = latest.moving_figures(series(spark, [(n, 100 + n) for n in range(49)])).collect()[0]
    assert (short["dma_50"], short["dma_200"], short["price_to_dma200"]) == (None, None, None)
    assert short["avg_traded_value_30d"] == pytest.approx(sum((100 + n) * 10 for n in range(30)) / 30 * 1e-7)
    full = latest.moving_figures(series(spark, [(n, 100 + n) for n in range(250)])).collect()[0]
    assert full["dma_50"] == pytest.approx(sum(100 + n for n in range(50)) / 50)
    assert full["dma_200"] == pytest.approx(sum(100 + n for n in range(200)) / 200)
    assert full["price_to_dma200"] == pytest.approx(100 / full["dma_200"])
