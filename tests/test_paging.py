"""Stored orders, key pages and the search index against plain sorts and scans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bourselight.plans import pages, search_index
from bourselight.plans.paging import StoredOrder, next_page
from bourselight.plans.screen import ordered, paged


@pytest.fixture(scope="module")
def quoted(spark):
    rng = random.Random(4)
    rows = [(f"S{k:03}", f"Name {rng.randrange(30)}", rng.choice([None, 1.0, 2.0, rng.random()]), 5.0) for k in range(150)]
    return spark.createDataFrame(rows, "symbol string, name string, pe double, market_cap double").repartition(8)


@pytest.mark.parametrize("descending", [True, False])
def test_any_page_of_a_stored_order_is_that_of_a_sort(spark, quoted, tmp_path, descending):
    order = StoredOrder.write(quoted, str(tmp_path / "o"), ["name", "pe"], "pe", descending)
    for page, size, cap in [(1, 10, None), (7, 20, None), (8, 20, None), (2, 100, None), (9, 10, 85), (99, 10, None), (1, 25, 25)]:
        want = paged(quoted, ["name", "pe"], "pe", descending, page, size, cap).collect()
        assert order.page(page, size, cap).collect() == want
    plan = order.page(1000, 50)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(position,49951)" in plan


def test_an_empty_screen_has_empty_pages(spark, quoted, tmp_path):
    order = StoredOrder.write(quoted.limit(0), str(tmp_path / "o"), ["name"])
    assert order.page().collect() == []


@pytest.mark.parametrize("descending", [True, False])
def test_key_pages_go_through_all_rows(quoted, descending):
    want = [(r.pe, r.symbol) for r in ordered(quoted, "pe", descending).collect()]
    got, after = [], None
    while True:
        rows = [(r.pe, r.symbol) for r in next_page(quoted, after, "pe", descending, 40).collect()]
        if not rows:
            break
        got, after = got + rows, rows[-1]
    assert got == want


COMPANIES = [("TATA", "Tata Steel"), ("TATB", None), ("AB", "Straße und Öl"), ("B", "ab"), ("XAB", "tAtA motors"), ("É1", "")]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    company = spark.createDataFrame([(s, n, None) for s, n in COMPANIES], "symbol string, name string, sector string")
    return company, search_index.build(spark, str(tmp_path_factory.mktemp("index")), company, buckets=4)


@pytest.mark.parametrize("term", ["t", "ta", "tat", "tata", "Tata S", "ab", "stra", "öl", "é", "zz", "  ", "tata motors ltd", "ttt"])
def test_the_index_finds_what_a_scan_finds(spark, indexed, term):
    company, index = indexed
    quote = spark.createDataFrame([(s, 1.0, float(k)) for k, (s, _) in enumerate(COMPANIES)], "symbol string, current_price double, market_cap double")
    assert search_index.search(index, quote, term).collect() == pages.search(company, quote, term).collect()


def test_a_search_reads_the_buckets_of_its_grams(spark, tmp_path):
    company = spark.range(200).select(F.concat(F.lit("S"), "id").alias("symbol"), F.concat(F.lit("name "), "id").alias("name"), F.lit("x").alias("sector"))
    index = search_index.build(spark, str(tmp_path / "i"), company, buckets=16)
    files = search_index.candidates(index, "S17").inputFiles()
    assert 0 < len(files) < len(index.read("posting").inputFiles())
