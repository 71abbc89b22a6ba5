"""Streams: contested stretches, late rows, resumable ingestion."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from bourselight.session import new_table_path
from bourselight.streaming import jobs
from workload.streams import PRICES

START = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize(("limit", "window", "seconds"), [(3, 60, 20000), (5, 60, 3000), (1, 10, 4000)])
def test_contested_stretches_hold_every_crowded_window(spark, limit, window, seconds):
    rng, rows = random.Random(limit), []
    for i in range(2500):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}"
        rows.append((i, START + dt.timedelta(milliseconds=rng.randrange(seconds) * 1000 + rng.choice([0, 0, 500])), key))
    log = spark.createDataFrame(rows, "request_id long, ts timestamp, client_key string").repartition(8)
    found = jobs.contested_stretches(log, limit, window).collect()
    bucket = lambda at: int(at.replace(tzinfo=dt.timezone.utc).timestamp()) // window
    for _, at, key in rows:
        crowd = sum(k == key and at - dt.timedelta(seconds=window) < other <= at for _, other, k in rows)
        if crowd > limit:
            assert any(r.client_key == key and r.first_bucket <= bucket(at) <= r.last_bucket for r in found)


def test_late_rows_count(spark, tmp_path):
    schema, folder = "created_at timestamp, level string", str(tmp_path / "log")
    for day in (3, 1, 2):
        rows = [(START + dt.timedelta(days=day, minutes=m), "ERROR") for m in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_folder(spark, folder, schema, files_per_batch=1)
    out = jobs.summed(stream, "late", "window_start timestamp, errors bigint, warnings bigint", ["window_start"], ["errors", "warnings"], jobs.level_counts)
    assert out.agg({"errors": "sum"}).first()[0] == 3 * 5 * 24


def price_file(day, close, hour=0):
    item = {"quote_date": day, "open_price": 1, "high_price": 9, "low_price": 1, "close_price": close, "volume": 1}
    return json.dumps({"endpoint": "/api/v1/daily-quotes/A", "symbol": "A", "params": {}, "payload": json.dumps({"price": [item]}),
                       "fetched_at": f"2026-01-01T{hour:02}:00:00Z"})


def price_tables(spark):
    return jobs.tables_of(spark, new_table_path(spark, "resume"), {"price": PRICES})


def closes(tables):
    return sorted((str(r["quote_date"]), r["close"]) for r in tables.read("price").collect())


def test_ingestion_resumes_and_the_last_write_wins(spark, tmp_path):
    folder, tables = tmp_path / "landing", price_tables(spark)
    folder.mkdir()

    def run():
        jobs.ingest(jobs.read_landing_stream(spark, str(folder), 1), tables, {"price": PRICES})
        return closes(tables)

    (folder / "1.json").write_text(price_file("2026-01-01", 5, 1))
    (folder / "x.json").write_text(price_file("2026-01-02", 6).replace("daily-quotes", "holidays-calendar"))
    assert run() == [("2026-01-01", 5.0)]
    assert run() == [("2026-01-01", 5.0)]
    (folder / "2.json").write_text(price_file("2026-01-01", 7, 2))
    (folder / "3.json").write_text(price_file("2025-01-03", 8))
    assert run() == [("2025-01-03", 8.0), ("2026-01-01", 7.0)]
    # A payload that was fetched earlier and lands later changes nothing.
    (folder / "4.json").write_text(price_file("2026-01-01", 9, 0))
    assert run() == [("2025-01-03", 8.0), ("2026-01-01", 7.0)]
    assert all(len(f) == 1 for f in tables.version().tables["price"].values())


def test_a_batch_that_dies_after_its_commit_is_not_taken_again(spark, tmp_path):
    folder, tables = tmp_path / "landing", price_tables(spark)
    folder.mkdir()
    (folder / "1.json").write_text(price_file("2026-01-01", 5, 1))
    commit = tables.commit

    def dies(*args, **writes):
        commit(*args, **writes)
        raise RuntimeError("killed")

    tables.commit = dies
    with pytest.raises(Exception, match="killed"):
        jobs.ingest(jobs.read_landing_stream(spark, str(folder), 1), tables, {"price": PRICES})
    version, tables.commit = tables.version().number, commit
    jobs.ingest(jobs.read_landing_stream(spark, str(folder), 1), tables, {"price": PRICES})
    assert tables.version().number == version and closes(tables) == [("2026-01-01", 5.0)]


@pytest.mark.parametrize("first", [5, 7])
def test_the_later_fetch_wins_inside_a_batch(spark, tmp_path, first):
    folder, tables = tmp_path / "landing", price_tables(spark)
    folder.mkdir()
    versions = [price_file("2026-01-01", 5, 1), price_file("2026-01-01", 7, 2)]
    (folder / "1.json").write_text("\n".join(versions if first == 5 else reversed(versions)))
    jobs.ingest(jobs.read_landing_stream(spark, str(folder), 1), tables, {"price": PRICES})
    assert closes(tables) == [("2026-01-01", 7.0)]
