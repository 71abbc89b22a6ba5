"""Large figures, rejected payloads, ratio families and log limits: nothing is dropped without being counted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bourselight import session
from bourselight.functions.parse import to_int
from bourselight.plans import monitor, pages, statements
from bourselight.session import stored_once
from bourselight.sources.landing import LANDING_SCHEMA, payload_account, read_landing, rejects, write_landing
from bourselight.sources.testbed import Testbed, _decimal_sum
from workload import landed as calls


def test_sums_of_large_figures(spark):
    df = spark.createDataFrame([(5_000_000.25,), (123_456_789_012.5,)], "v double")
    assert df.agg(_decimal_sum("v").alias("s")).first().s == 123_461_789_012.75


def test_sums_are_those_of_decimals(spark):
    """Figures with more places, negative, huge, missing and without a value, as sums of decimals have them."""
    figures = [1.005, 2.675, -0.015, 0.1, -7.25, 9e15, -8.9e15, 12345678901234.56, 1e13, None, float("nan"), 0.0]
    rows = [(k, v) for k in range(3) for v in figures[k:]] + [(3, None), (4, 9e15), *[(5, 9e15)] * 40, (6, -0.01)]
    df = spark.createDataFrame(rows, "k int, v double")
    decimals = F.sum(F.col("v").cast("decimal(18,2)")).cast("double")
    found = df.groupBy("k").agg(_decimal_sum("v").alias("s"), decimals.alias("d")).collect()
    assert len(found) == 7 and [r.s for r in found] == [r.d for r in found]


def landed(spark, payloads, endpoint="/api/v1/daily-quotes/A"):
    rows = [(endpoint, "A", {}, p, None) for p in payloads]
    return spark.createDataFrame(rows, LANDING_SCHEMA)


def test_rejected_payloads(spark):
    payloads = ['{"price": []}', '{"price": [{"close_price": 1}]}', '{"price": [', "", None, " ", "busy", '{"error": 1}', '{"price": null}', '{"price": 3}']
    account = payload_account(landed(spark, payloads)).first()
    assert (account.payloads, account.taken, account.empty, account.not_json, account.no_entries) == (10, 1, 3, 2, 4)
    found = rejects(landed(spark, payloads))
    assert found.count() == 9 and {r.reason for r in found.collect()} == {"empty", "not JSON", "no entries"}
    archived = landed(spark, ["", "x"], "/api/v1/holidays-calendar")
    assert rejects(archived).count() == 0 and payload_account(archived).first().asDict() == {
        "target": "archive_only", "payloads": 2, "taken": 2, "empty": 0, "not_json": 0, "no_entries": 0, "entries": 0
    }


@pytest.mark.parametrize(
    ("endpoint", "payload", "entries"),
    [
        ("/api/v1/quote/all", '{"A": {"volume": 1}, "B": {}, "C": null, "error": "busy"}', 2),
        ("/api/v1/quote/all", "{}", 0),
        ("/api/v1/stock-symbols", "[]", 0),
        ("/api/v1/stock-symbols", ' [{"symbol": "A"}, {}]', 2),
        ("/api/v1/company-profile/A", '{"name": null}', 0),
        ("/api/v1/company-profile/A", '{"name": "A", "sector": "S"}', 1),
        ("/api/v1/corporate-actions/split/A", '{"split": [{}, {}], "bonus": [{}], "x": 1}', 3),
        ("/api/v1/financial-metrics/A", '{"financial_metrics": {"a": 1, "b": null, "c": 2}}', 2),
        ("/api/v1/index/master/all", "[]", 0),
        ("/api/v1/shareholdings/distribution/A", '{"distributions": [{}]}', 1),
    ],
)
def test_entries_of_every_shape(spark, endpoint, payload, entries):
    account = payload_account(landed(spark, [payload], endpoint)).first()
    assert (account.entries, account.no_entries) == (entries, int(entries == 0))


def test_entries_are_cut_out_once(spark):
    plan = payload_account(landed(spark, ['{"price": [{}]}']))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1


def test_lists_are_counted_from_one_parse(spark):
    """A payload is parsed once for its fault and its list; what is no list is counted by its text, as before."""
    payloads = ['{"price": [{"a": 1}, 2, "x", null, [3], true]}', '{"price": "[1, 2]"}', '{"price": {"a": 1, "b": null}}', '{"price": [1], "x": ', '{"price": [1], "price": [2]}']
    df = payload_account(landed(spark, payloads))
    assert [(r.payloads, r.taken, r.not_json, r.entries) for r in df.collect()] == [(5, 3, 2, 9)]
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.lower().count("parsejson") == 1 and "variant_get" in plan


def test_one_bad_year_costs_one_row(spark):
    found = spark.createDataFrame([("3000000000",), ("2024.0",), ("x",), (None,)], "v string").select(to_int("v").alias("y"))
    assert [r.y for r in found.collect()] == [None, 2024, None, None]


def test_ratio_families(spark):
    cells = spark.createDataFrame([("A", "le", "x", 1.0), ("A", "zz", "y", 2.0)], "symbol string, family string, label string, value double")
    assert [r.family for r in statements.named_families(cells).orderBy("label").collect()] == ["leverage", "zz"]
    for name in ("leverage", "solvency", "le"):
        assert statements.ratio_family(cells, name).count() == 1
    with pytest.raises(ValueError, match="unknown ratio family"):
        statements.ratio_family(cells, "zz")


def test_statuses_and_log_limit(spark):
    tasks = spark.createDataFrame([(1, "done"), (1, "paused"), (1, None)], "run_id int, status string")
    assert monitor.task_counts(tasks).first().asDict() == {"run_id": 1, "done": 1, "skipped": 0, "failed": 0, "other": 2}
    with pytest.raises(ValueError, match="at most 500"):
        monitor.newest_logs(tasks, limit=501)


def test_listing_tells_its_total(spark):
    rows = spark.range(5).select(F.lit(1).alias("place"), F.col("id").cast("string").alias("index_name"), F.col("id").cast("string").alias("index_symbol"))
    assert [(r.index_name, r.total) for r in pages.listed_in_order(rows, 2).collect()] == [("0", 5), ("1", 5)]


def test_stored_tables_follow_their_files(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    source = str(folder / "t.parquet")

    def stored():
        return stored_once(spark, str(folder), "t", lambda: spark.read.parquet(source)).count()

    spark.range(3).write.parquet(source)
    assert stored() == 3
    spark.range(7).write.mode("overwrite").parquet(source)
    assert stored() == 7


def test_tables_are_derived_from_small_shares_of_files(spark, tmp_path, monkeypatch):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    draw, folder = random.Random(1), tmp_path / "data"
    folder.mkdir()
    pq.write_table(pa.table({"v": [draw.random() for _ in range(40_000)]}), folder / "t.parquet", row_group_size=1000)
    monkeypatch.setattr(session, "DERIVE_BYTES", 32 << 10)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    stored = stored_once(spark, str(folder), "shares", lambda: spark.read.parquet(str(folder / "t.parquet")))
    assert len(stored.inputFiles()) > 4 and stored.count() == 40_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Lines of four suppliers over three years, some without a date."""
    folder = str(tmp_path_factory.mktemp("small"))
    lines = spark.range(400).selectExpr(
        "id AS l_orderkey", "id % 7 AS l_partkey", "id % 4 AS l_suppkey", "CAST(id % 5 AS INT) AS l_linenumber",
        "CAST(1 + id % 13 AS DOUBLE) AS l_quantity", "CAST(100 + id AS DOUBLE) AS l_extendedprice",
        "CAST(id % 9 AS DOUBLE) / 100 AS l_discount", "CAST(id % 6 AS DOUBLE) / 100 AS l_tax",
        "element_at(array('A', 'N', 'R'), CAST(id % 3 + 1 AS INT)) AS l_returnflag",
        "CASE WHEN id % 5 < 2 THEN 'O' ELSE 'F' END AS l_linestatus",
        "CASE WHEN id % 31 > 0 THEN timestamp'1995-01-10' + make_interval(0, CAST(id % 37 AS INT)) END AS l_shipdate",
    )
    lines.write.parquet(f"{folder}/lineitem.parquet")
    return folder


def _files(df):
    return [f.rsplit("/", 1)[1] for f in df.inputFiles()]


def test_derived_tables_are_stored_small(spark, small):
    assert all(f.endswith(".zstd.parquet") for f in _files(Testbed(spark, small).prices))


def test_trailing_ratios_are_those_of_all_years(spark, small):
    t = Testbed(spark, small)
    made = Testbed.ratios.func.__closure__
    ratios = next(c.cell_contents for c in made if callable(c.cell_contents))(t)
    found = {(r.symbol, r.statement_type, r.field_name): (r.year, r.value) for r in ratios.where("header = 'TTM'").collect()}
    brute = t.lineitem.groupBy("symbol", "statement_type").agg(
        F.max("year").alias("year"), F.max("l_discount").alias("d"), F.min("l_quantity").alias("q")
    ).collect()
    assert len(found) == 6 * len(brute)
    for r in brute:
        assert found[r.symbol, r.statement_type, "returnOnEquity"] == (r.year, r.d * 3)
        assert found[r.symbol, r.statement_type, "cashConversionCycle"] == (r.year, r.q - 5)
    ratios.collect()
    assert "ReusedExchange" in ratios._jdf.queryExecution().executedPlan().toString()


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [part.split(",")[0] for part in plan.split("Exchange hashpartitioning(")[1:]]


def _underived(t, name):
    return next(c.cell_contents for c in getattr(Testbed, name).func.__closure__ if callable(c.cell_contents))(t)


def test_lines_are_grouped_by_numbers(spark, small):
    t = Testbed(spark, small)
    for name in ("statement_wide", "prices", "ratios", "metrics"):
        df = _underived(t, name)
        assert all(key.startswith("l_suppkey#") for key in _exchanges(df)), name
        assert "decimal(28,2)" not in df._jdf.queryExecution().optimizedPlan().toString()
    wide = {(r.symbol, r.statement_type, r.statement_code, r.period_kind, r.header): r for r in _underived(t, "statement_wide").collect()}
    keys = ["symbol", "statement_type", "statement_code"]
    years = t.lineitem.groupBy(*keys, "year").agg(F.sum("l_extendedprice").alias("e")).collect()
    half = t.lineitem.where("month(day) > 6").groupBy(*keys).agg(F.sum("l_extendedprice").alias("e"), F.max("year").alias("year")).collect()
    assert {k[4] for k in wide if k[3] == "annual"} == {f"Mar {y}" for y in (1995, 1996, 1997, 1998)} | {None}
    for r in years:
        row = wide[r.symbol, r.statement_type, r.statement_code, "annual", r.year and f"Mar {r.year}"]
        assert (row.year, row.e) == (r.year, r.e * 1234567.89) and (row.period_end is None) == (r.year is None)
    for r in half:
        row = wide[r.symbol, r.statement_type, r.statement_code, "ttm", "TTM"]
        assert (row.year, row.e) == (r.year, r.e * 1234567.89)
    assert len([k for k in wide if k[3] == "ttm"]) == len(half) and len([k for k in wide if k[3] == "annual"]) == len(years)


def test_constituents_shuffle_lines_once(spark, small):
    spark.createDataFrame([(0, 5), (1, 6), (2, 6), (3, None)], "s_suppkey long, s_nationkey int").write.parquet(f"{small}/supplier.parquet")
    spark.createDataFrame([(5, 1, "E"), (6, 1, "F")], "n_nationkey int, n_regionkey int, n_name string").write.parquet(f"{small}/nation.parquet")
    found = _underived(Testbed(spark, small), "constituents")
    lines = Testbed(spark, small).table("lineitem").collect()
    want = {("F" if r.l_suppkey else "E", str(r.l_partkey + 1000000 * (r.l_orderkey % 50 == 0))) for r in lines if r.l_suppkey < 3}
    assert len(_exchanges(found)) == 1 and sorted((r.index_symbol, r.symbol) for r in found.collect()) == sorted(want)


def test_landed_files_are_compressed(spark, tmp_path):
    folder = str(tmp_path / "landing")
    write_landing(landed(spark, ['{"price": []}', "x"]), folder)
    assert all(f.endswith(".json.gz") for f in _files(read_landing(spark, folder)))
    assert {r.payload for r in read_landing(spark, folder).collect()} == {'{"price": []}', "x"}


def test_payload_texts_are_made_after_the_shuffle(spark, small):
    t = Testbed(spark, small)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    for call, text in ((calls.prices, "date_format"), (calls.statements, "revenueFromOperations")):
        plan = call(t)._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
        assert len(plan) == 2 and text not in plan[1]
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    payload = calls.statements(t).where("symbol = '1' AND params['statement_code'] = 'pl'").first().payload
    assert '"profitBeforeTax"' in payload and '"header":' in payload and '"equityCapital"' not in payload


def test_price_files_by_symbol_cost_one_shuffle(spark, small):
    t = Testbed(spark, small)
    sent = calls.prices(t, 8)
    assert sent._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    as_rows = lambda df: sorted((r.symbol, len(r.payload)) for r in df.collect())
    assert as_rows(sent) == as_rows(calls.prices(t))


def test_rows_are_grouped_behind_one_shuffle(spark, small):
    t = Testbed(spark, small)
    for call in (calls.prices, calls.statements, calls.basics, calls.ratios, calls.metrics):
        plan = call(t)._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
        assert len(plan) == 2 and "collect_list" not in plan[1], call.__name__


def test_valuations_are_shuffled_once(spark, tmp_path):
    orders = spark.range(60).selectExpr(
        "id AS o_orderkey", "id % 4 AS o_custkey", "element_at(array('F', 'O'), CAST(id % 2 + 1 AS INT)) AS o_orderstatus",
        "CAST(100 + id AS DOUBLE) AS o_totalprice", "timestamp'1995-01-10' + make_interval(0, CAST(id % 30 AS INT)) AS o_orderdate",
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    t = Testbed(spark, str(tmp_path))
    sent = calls.price_ratios_daily(t).unionByName(calls.price_ratios_annual(t))
    found = {r.target: (r.payloads, r.entries) for r in payload_account(sent).collect()}
    years = t.price_ratios.select("symbol", "statement_type", F.year("quote_date").alias("y"))
    groups = years.select("symbol", "statement_type").distinct().count()
    assert found == {"price_ratio_daily": (years.distinct().count(), years.count()), "price_ratio_annual": (groups, years.distinct().count())}
    sent.collect()
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
