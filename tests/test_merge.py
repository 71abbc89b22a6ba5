"""Table maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bourselight.operators import merge


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_last_write_wins(spark):
    cur = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, price double")
    batch = spark.createDataFrame([("B", 3.0, 1), ("B", None, 2), ("C", 5.0, 1)], "symbol string, price double, v int")
    out = merge.upsert(cur, batch, ["symbol"], [F.col("v").desc()])
    assert rows(out) == [("A", 1.0), ("B", None), ("C", 5.0)]


def test_profile_merge_keeps_what_it_does_not_bring(spark):
    cur = spark.createDataFrame([("A", "Alpha", "Banks"), ("B", "Beta", None)], "symbol string, name string, sector string")
    new = spark.createDataFrame([("A", None, None), ("B", None, "IT"), ("C", None, "Oil")], "symbol string, name string, sector string")
    assert rows(merge.merge_profiles(cur, new)) == [("A", "Alpha", "Banks"), ("B", "Beta", "IT"), ("C", "C", "Oil")]


def test_membership_is_replaced_not_accumulated(spark):
    cur = spark.createDataFrame([("X", "A"), ("X", "B"), ("Y", "A")], "index_symbol string, symbol string")
    batch = spark.createDataFrame([("X", "C")], "index_symbol string, symbol string")
    touched = spark.createDataFrame([("X",), ("Y",)], "index_symbol string")
    assert rows(merge.replace_groups(cur, batch, ["index_symbol"])) == [("X", "C"), ("Y", "A")]
    assert rows(merge.replace_groups(cur, batch, ["index_symbol"], touched)) == [("X", "C")]


def test_latest_payload(spark):
    t = dt.datetime
    archive = spark.createDataFrame([("e", "A", "old", t(2026, 1, 1), 1), ("e", "A", "new", t(2026, 1, 2), 2)],
                                    "endpoint string, symbol string, payload string, fetched_at timestamp, id int")
    assert [r["payload"] for r in merge.latest_payload(archive).collect()] == ["new"]


def test_family_is_written_back_from_the_newest_classified_period(spark):
    d = dt.date
    periods = spark.createDataFrame(
        [("A", "pl", "general", d(2024, 3, 31), 2024), ("A", "pl", "bank", d(2025, 3, 31), 2025),
         ("A", "pl", "unknown", d(2026, 3, 31), 2026), ("A", "bs", "general", d(2026, 3, 31), 2026)],
        "symbol string, statement_code string, schema_kind string, period_end date, year int")
    company = spark.createDataFrame([("A", None), ("B", "general")], "symbol string, schema_kind string")
    assert rows(merge.write_back_schema_kind(company, periods)) == [("A", "bank"), ("B", "general")]
