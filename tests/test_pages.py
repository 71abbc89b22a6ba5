"""Company and index pages, quality checks, repair and log retention."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bourselight import catalog
from bourselight.plans import monitor, pages, quality


def snapshot(spark, rows, schema):
    return spark.createDataFrame(rows, schema).to(catalog.snapshot_schema())


def test_index_medians_and_coverage(spark):
    rows = [("LOSS", -42.8, 1.0, -15.0, -4807.9), ("CHEAP", 12.0, 1.5, 18.0, 500.0), ("MID", 24.0, 3.0, 4.0, 800.0),
            ("DEAR", 60.0, 8.0, 12.0, 900.0), ("EMPTY", 99.0, 9.0, 99.0, None)]
    snap = snapshot(spark, rows, "symbol string, pe double, pb double, returnonequity double, net_profit double")
    company = snap.select("symbol", F.col("symbol").alias("name"), F.lit("x").alias("sector"))
    links = spark.createDataFrame([("T", r[0]) for r in rows] + [("T", "543210"), ("T", "REIT")], "index_symbol string, symbol string")
    members = pages.index_members(links, snap, company)
    medians = pages.index_medians(members).collect()[0]
    assert (medians["median_pe"], medians["median_pb"], medians["median_returnonequity"]) == (24.0, 2.25, 8.0)
    cover = pages.index_coverage(members).collect()[0]
    assert (cover["count"], cover["with_fundamentals"], cover["outside_universe"]) == (7, 4, 2)


def test_peers_are_limited_before_their_medians(spark):
    rows = [(f"C{i}", 100.0 - i, float(i)) for i in range(6)]
    snap = snapshot(spark, rows, "symbol string, market_cap double, pe double")
    company = snap.select("symbol", F.lit(None).cast("string").alias("sub_industry"), F.lit("Banks").alias("sector"), F.lit("x").alias("industry"))
    got = pages.company_peers(snap, company, limit=4).collect()
    assert {(r["peer_group"], r["peer_count"], r["median_market_cap"], r["median_pe"]) for r in got} == {("Banks", 4, 98.5, 2.0)}
    assert len(got) == 6


def test_search_order(spark):
    company = spark.createDataFrame([("REL", "Zeta", "x"), ("RELX", "Alpha", "x"), ("A", "Reliance", "x"), ("B", "Pure rel", "x"), ("C", "None", "x"), ("D", "Relaxo", "x")], "symbol string, name string, sector string")
    quote = spark.createDataFrame([("D", 1.0, 10.0), ("A", 1.0, 99.0)], "symbol string, current_price double, market_cap double")
    assert [r["symbol"] for r in pages.search(company, quote, " rel ").collect()] == ["REL", "RELX", "A", "D", "B"]
    assert pages.search(company, quote, "  ").collect() == []
    assert pages.search(company, quote, "%").collect() == []


def test_movers(spark):
    d = dt.date(2026, 8, 6)
    quotes = spark.createDataFrame([("A", d, 1.0, 3.0), ("B", d, 1.0, -2.0), ("C", d, 1.0, None), ("D", d, 1.0, -5.0)], "index_symbol string, quote_date date, close_price double, change_pct double")
    master = quotes.select("index_symbol", F.col("index_symbol").alias("index_name"))
    got = [(r["side"], r["position"], r["index_symbol"]) for r in pages.movers(quotes, master, 2).orderBy("side", "position").collect()]
    assert got == [("gainer", 1, "A"), ("gainer", 2, "B"), ("loser", 1, "D"), ("loser", 2, "B")]


def test_download_order(spark):
    company = spark.createDataFrame([(s,) for s in "ABCDEF"], "symbol string")
    links = spark.createDataFrame([("NIF50", "B"), ("OTHER", "C"), ("OTHER", "B"), ("BSE100", "A"), ("NIF50", "ETF")], "index_symbol string, symbol string")
    quote = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 9.0), ("D", 50.0), ("E", 3.0)], "symbol string, market_cap double")
    rows = pages.download_order(company, links, quote).orderBy("tier", F.desc("cap"), "symbol").collect()
    assert [r["symbol"] for r in rows] == ["B", "A", "C", "D", "E", "F"]


def test_trends_need_three_points(spark):
    rows = [("A", y, v) for y, v in ((1, -1.0), (2, None), (3, 2.0), (4, -0.5))] + [("B", 1, 1.0), ("B", 2, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, year int, value double")
    got = [r.asDict() for r in pages.trends(df, ["symbol"], "year").collect()]
    assert got == [{"symbol": "A", "points": 3, "first": -1.0, "last": -0.5, "low": -1.0, "high": 2.0, "rising": True, "crosses_zero": True}]


def test_return_shares_have_a_floor_of_one(spark):
    df = spark.createDataFrame([("A", "1Y", -20.0), ("A", "3Y", 5.0), ("B", "1Y", 0.5)], "index_symbol string, horizon string, return_pct double")
    got = {(r["index_symbol"], r["horizon"]): (r["share"], r["negative"]) for r in pages.return_shares(df).collect()}
    assert got == {("A", "1Y"): (1.0, True), ("A", "3Y"): (0.25, False), ("B", "1Y"): (0.5, False)}


PRICE = "symbol string, quote_date date, open double, high double, low double, close double, volume double"
QUOTE = "symbol string, current_price double, change_pct double, market_cap double, volume double"


def damaged(spark):
    d = dt.date(2026, 8, 6)
    prices = spark.createDataFrame([("A", d, 1.0, 2.0, 1.0, 1.5, 5.0), ("B", d, 0.0, 0.0, 0.0, 0.0, 0.0), ("C", d, -1.0, 2.0, 1.0, 1.5, 5.0), ("D", d, 1.0, 1.0, 1.0, None, 0.0)], PRICE)
    quotes = spark.createDataFrame([("A", 0.0, -100.0, 5.0, 0.0), ("B", 10.0, -100.0, 0.0, 0.0), ("C", 10.0, 1.0, 5.0, 0.0)], QUOTE)
    index = spark.createDataFrame([("X", d, 0.0, 0.0, 0.0, 0.0), ("Y", d, 20.0, 0.0, 0.0, 5.0)], "index_symbol string, quote_date date, pe double, pb double, div_yield double, market_cap double")
    master = spark.createDataFrame([("X", 0.0), ("Y", 1.0)], "index_symbol string, market_cap double")
    return prices, quotes, index, master


def test_repair_counts_and_is_idempotent(spark):
    prices, quotes, index, master = damaged(spark)
    found = {r["rule"]: r["changed"] for r in quality.repair_report(prices, quotes, index, master).collect()}
    assert found == {"price_rows_removed": 2, "quote_changes_cleared": 1, "quote_rows_corrected": 2, "index_valuations_cleared": 1, "index_market_caps_cleared": 2}
    fixed = (quality.repaired_prices(prices), quality.repaired_quotes(quotes), quality.repaired_index_quotes(index), quality.repaired_index_master(master))
    assert {r["changed"] for r in quality.repair_report(*fixed).collect()} == {0}
    assert {r["symbol"] for r in fixed[0].collect()} == {"A", "D"}
    assert {tuple(r) for r in fixed[1].collect()} == {("A", None, None, 5.0, 0.0), ("B", 10.0, -100.0, None, 0.0), ("C", 10.0, 1.0, 5.0, 0.0)}


def test_log_retention_keeps_the_newest(spark):
    logs = spark.range(1, 101)
    assert sorted(r["id"] for r in monitor.trim_logs(logs, 10).collect()) == list(range(91, 101))
    assert monitor.trim_logs(logs, 1000).count() == 100


@pytest.mark.parametrize(("scope", "want"), [('{"symbols": 5}', 5), ('{"symbols": "x"}', None), ("{}", None), ("oops", None), (None, None)])
def test_planned_symbols(spark, scope, want):
    df = spark.createDataFrame([(scope,)], "s string")
    assert df.select(monitor.planned_symbols(F.col("s"))).collect()[0][0] == want
