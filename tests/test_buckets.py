"""Tables maintained by touched buckets: what stays, what switches together, what is taken once, what is removed."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bourselight.operators import merge
from bourselight.operators.buckets import COMPACT, KEEP, Append, Conflict, Layout, Tables, Write

QUOTES = "symbol string, price double"


def quotes(spark, pairs):
    return spark.createDataFrame(pairs, QUOTES)


def upsert(old, new):
    return merge.upsert(old, new, ["symbol"], [F.col("price").desc()])


def live(tables):
    return {t: {p: tuple(f) for p, f in parts.items()} for t, parts in tables.version().tables.items()}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def tables(spark, tmp_path):
    made = Tables(spark, str(tmp_path / "t"), {"quote": Layout(("symbol",), 8), "note": Layout(("symbol",), 8)})
    made.commit(quote=Write(quotes(spark, [(f"S{k}", float(k)) for k in range(100)])))
    return made


def test_only_touched_buckets_are_written(spark, tables):
    before = live(tables)["quote"]
    assert len(before) == 8
    batch = quotes(spark, [("S7", 700.0), ("NEW", 1.0)])
    touched = tables.touched("quote", batch)
    assert tables.commit(quote=Write(batch, upsert))
    after = live(tables)["quote"]
    assert {p for p in before if before[p] != after[p]} == set(touched) and 1 <= len(touched) <= 2
    want = {f"S{k}": float(k) for k in range(100)} | {"S7": 700.0, "NEW": 1.0}
    assert rows(tables.read("quote")) == sorted(want.items())
    # The files of the touched buckets are all that a merge reads.
    read = tables.holding("quote", batch).inputFiles()
    assert {re.search(r"_part=(\d+)", f)[1] for f in read} == set(touched)


def test_a_bucket_may_become_empty_and_fill_again(spark, tables):
    batch = quotes(spark, [("S7", 7.0)])
    part = tables.touched("quote", batch)[0]
    tables.commit(quote=Write(batch, lambda old, new: old.limit(0)))
    assert part not in live(tables)["quote"] and tables.holding("quote", batch).count() == 0
    tables.commit(quote=Write(batch, upsert))
    assert rows(tables.holding("quote", batch)) == [("S7", 7.0)]


def test_two_tables_switch_together_or_not_at_all(spark, tables):
    tables.commit(note=Write(quotes(spark, [("S1", 0.0)])))
    old = rows(tables.read("quote")), rows(tables.read("note"))

    def fails(current, new):
        # The first table is on disk by now.
        assert len(list(Path(tables.path, "quote").iterdir())) == 2
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        tables.commit(quote=Write(quotes(spark, [("S1", -1.0)]), upsert), note=Write(quotes(spark, [("S1", -1.0)]), fails))
    assert (rows(tables.read("quote")), rows(tables.read("note"))) == old
    tables.commit(quote=Write(quotes(spark, [("S1", -1.0)]), upsert), note=Write(quotes(spark, [("S1", -1.0)]), upsert))
    assert ("S1", -1.0) in rows(tables.read("quote")) and rows(tables.read("note")) == [("S1", -1.0)]


def test_restatement_reads_the_old_pair_until_both_are_written(spark, tmp_path):
    key = "symbol string, statement_type string, statement_code string, period_kind string, header string"
    p, q = ("A", "c", "pl", "annual", "Mar 2026"), ("A", "c", "pl", "annual", "Mar 2025")
    periods = spark.createDataFrame([(*p, 1), (*q, 1)], f"{key}, version int")
    lines = spark.createDataFrame([(*p, "sales", 1.0), (*p, "tax", 2.0), (*q, "tax", 3.0)], f"{key}, field_name string, value double")
    layout = Layout(("symbol",), 4)
    tables = Tables(spark, str(tmp_path / "t"), {"statement_period": layout, "statement_line": layout})
    tables.commit(statement_period=Write(periods), statement_line=Write(lines))
    writes = merge.restatement(
        spark.createDataFrame([(*p, 2)], f"{key}, version int"),
        spark.createDataFrame([(*p, "sales", 9.0)], f"{key}, field_name string, value double"),
    )
    seen, plain = [], writes["statement_line"].merge

    def watched(old, new):
        seen.append(rows(Tables(spark, tables.path, tables.layouts).read("statement_period")))
        return plain(old, new)

    writes["statement_line"].merge = watched
    tables.commit(**writes)
    assert seen == [[(*q, 1), (*p, 1)]]
    assert rows(tables.read("statement_period")) == [(*q, 1), (*p, 2)]
    assert rows(tables.read("statement_line")) == [(*q, "tax", 3.0), (*p, "sales", 9.0)]


def test_a_batch_is_taken_once(spark, tables):
    batch = Append(quotes(spark, [("X", 1.0)]))
    assert tables.commit(("s", 0), note=batch) and not tables.commit(("s", 0), note=batch)
    assert tables.commit(("other", 0), note=batch) and tables.commit(("s", 1), note=batch)
    assert not tables.commit(("s", 0), note=batch)
    assert tables.read("note").count() == 3


def test_of_two_commits_from_one_version_the_second_fails(spark, tables):
    def interrupted(old, new):
        other = Tables(spark, tables.path, tables.layouts)
        other.commit(quote=Write(quotes(spark, [("S1", 5.0)]), upsert))
        return upsert(old, new)

    with pytest.raises(Conflict):
        tables.commit(quote=Write(quotes(spark, [("S1", 6.0)]), interrupted))
    assert ("S1", 5.0) in rows(tables.read("quote"))
    assert not [f for f in Path(tables.path, "versions").iterdir() if not f.name.endswith((".json", ".crc"))]


def test_reading_does_not_grow_with_batches_and_old_folders_go(spark, tables):
    for k in range(2 * COMPACT + 3):
        tables.commit(note=Append(quotes(spark, [("A", float(k))])), quote=Write(quotes(spark, [("S1", float(-k))]), upsert))
    assert all(len(f) < COMPACT for f in live(tables)["note"].values())
    assert all(len(f) == 1 for f in live(tables)["quote"].values())
    assert rows(tables.read("note")) == [("A", float(k)) for k in range(2 * COMPACT + 3)]
    versions = [f for f in Path(tables.path, "versions").iterdir() if f.name.endswith(".json")]
    assert len(versions) <= KEEP
    bucket = tables.touched("quote", quotes(spark, [("S1", 0.0)]))[0]
    assert len(list(Path(tables.path, "quote").glob(f"*/_part={bucket}"))) <= KEEP


def test_years_and_missing_dates_have_their_own_buckets(spark, tmp_path):
    schema = "symbol string, day date, close double"
    tables = Tables(spark, str(tmp_path / "t"), {"price": Layout(("symbol",), 2, "day")})
    day = lambda y: dt.date(y, 3, 1)
    tables.commit(price=Write(spark.createDataFrame([("A", day(2020), 1.0), ("A", day(2021), 2.0), ("A", None, 0.0)], schema)))
    before = live(tables)["price"]
    assert {p.split("-")[1] for p in before} == {"2020", "2021", "none"}
    newest = lambda old, new: merge.keep_newest(old, new, ["symbol", "day"], [F.col("close").desc()])
    tables.commit(price=Write(spark.createDataFrame([("A", day(2021), 3.0), ("A", day(2021), 2.5)], schema), newest))
    after = live(tables)["price"]
    assert [p for p in before if before[p] != after[p]] == [next(p for p in before if p.endswith("2021"))]
    assert sorted(r.close for r in tables.read("price").collect()) == [0.0, 1.0, 3.0]
    # What is stored and newer stays.
    tables.commit(price=Write(spark.createDataFrame([("A", day(2021), 0.5)], schema), newest))
    assert sorted(r.close for r in tables.read("price").collect()) == [0.0, 1.0, 3.0]


def test_a_merge_may_not_move_rows_to_other_buckets(spark, tables):
    with pytest.raises(ValueError, match="does not touch"):
        tables.commit(quote=Write(quotes(spark, [("S1", 1.0)]), lambda old, new: tables.read("quote")))
    assert tables.version().number == 1


FETCHED = "endpoint string, symbol string, payload string, fetched_at timestamp, id int"


def fetched(spark, rows_):
    return spark.createDataFrame([(e, s, p, dt.datetime(2026, 1, d), i) for e, s, p, d, i in rows_], FETCHED)


def test_the_archive_takes_each_content_once(spark, tmp_path):
    store = merge.Archive(spark, str(tmp_path / "raw"))
    store.append(fetched(spark, [("e", "A", "{1}", 2, 2), ("e", "A", "{1}", 1, 9), ("e", "B", "{1}", 1, 3), ("e", "A", "{2}", 1, 4)]))
    assert sorted(r.id for r in store.index().collect()) == [3, 4, 9]
    store.append(fetched(spark, [("e", "A", "{2}", 5, 5), ("e", "A", "{3}", 6, 6), ("e", None, "{3}", 6, 7)]))
    assert sorted(r.id for r in store.index().collect()) == [3, 4, 6, 7, 9]
    assert sorted((r.symbol or "", r.payload) for r in store.latest().collect()) == [("", "{3}"), ("A", "{3}"), ("B", "{1}")]
    assert store.tables.read("payloads").count() == 5


def test_payloads_are_never_sorted(spark, tmp_path):
    store = merge.Archive(spark, str(tmp_path / "raw"))
    batch = fetched(spark, [("e", "A", "{1}", 2, 2)])
    store.append(batch)
    stored = spark.read.schema(batch.schema).parquet(_saved(batch, tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (store.latest(), merge.latest_payload(stored)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            window = plan[plan.index("Window"):]
            assert "payload#" not in window[: window.index("Relation")].split("WindowGroupLimit")[0]
            physical = df._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in physical and "SortMergeJoin" not in physical
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _saved(df, tmp_path):
    df.write.parquet(str(tmp_path / "saved"))
    return str(tmp_path / "saved")
