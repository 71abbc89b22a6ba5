"""Queries on computed figures cover every company of the snapshot, beside the rows of inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from bourselight.sources.testbed import Testbed
from workload.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def companies(spark):
    return {r.symbol for r in Testbed(spark, FOLDER).company.select("symbol").collect()}


def test_scaled_columns_of_every_company(spark):
    held = QUERIES["x13_unit_scales"](spark, FOLDER).where(F.col("source") == "snapshot")
    found = {r.symbol: r.n for r in held.groupBy("symbol").agg(F.count_distinct("key").alias("n")).collect()}
    assert found == dict.fromkeys(companies(spark), 25)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("x16_dividend_yield", ["dividend_yield", "current_price"]),
        ("x17_enterprise_value", ["enterprise_value", "market_cap", "total_debt", "total_cash"]),
        ("x18_ev_to_ebitda", ["ev_ebitda", "ebitda"]),
        ("x19_earnings_yield", ["earnings_yield", "pe"]),
        ("x20_distance_from_extremes", ["down_from_52w_high", "up_from_52w_low", "high52", "low52"]),
        ("x21_cash_to_profit", ["cfo_to_pat", "cfo", "net_profit"]),
    ],
)
def test_figures_of_every_company_and_order(spark, name, columns):
    found = QUERIES[name](spark, FOLDER)
    assert set(found.columns) == {"o_orderkey", "symbol", *columns}
    rows = found.select("o_orderkey", "symbol").collect()
    assert {r.symbol for r in rows if r.symbol is not None} == companies(spark)
    assert sum(r.symbol is None for r in rows) == Testbed(spark, FOLDER).table("orders").count()
