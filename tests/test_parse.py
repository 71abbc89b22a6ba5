"""Cleaning rules: dates, numbers, blanks, labels, hashes, redaction."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from bourselight.functions import parse


def apply(spark, rule, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, f"i int, v {kind}").select("i", rule(F.col("v")).alias("out"))
    return [r["out"] for r in sorted(out.collect(), key=lambda r: r["i"])]


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2026-08-06", dt.date(2026, 8, 6)),
        (" 2026-08-06 19:27:07", dt.date(2026, 8, 6)),
        ("2026-08-06T19:27:07", dt.date(2026, 8, 6)),
        ("20260331", dt.date(2026, 3, 31)),
        ("27-May-2026", dt.date(2026, 5, 27)),
        ("7-may-2026", dt.date(2026, 5, 7)),
        ("2026-02-30", None),
        ("27-Xyz-2026", None),
        ("06/08/2026", None),
        ("2026-8-6", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, text, day):
    assert apply(spark, parse.parse_date, [text]) == [day]


def test_numbers(spark):
    texts = ["1,234.5", " 12 ", "3.43%", "5 %", "-7e2", ".5", "5.", "+3", "-", "", "NA", "N/A", "null", "5d", "NaN",
             "inf", "Infinity", "true", "1.2.3", "e5", ".", ",", "--1", "5%%", None]
    want = [1234.5, 12.0, 3.43, 5.0, -700.0, 0.5, 5.0, 3.0] + [None] * 17
    assert apply(spark, parse.parse_number, texts) == want


def test_percent_text(spark):
    assert apply(spark, parse.parse_percent, ["0.28%", "-0.75%", "-100%", None, "%"]) == [0.28, -0.75, -100.0, None, None]


def test_missing_is_not_zero(spark):
    assert apply(spark, parse.positive_or_null, [1.0, 0.0, -1.0, None], "double") == [1.0, None, None, None]
    assert apply(spark, parse.zero_to_null, [1.0, 0.0, -1.0, None], "double") == [1.0, None, -1.0, None]
    assert apply(spark, parse.clean_text, [" a ", "   ", "", None]) == ["a", None, None, None]
    assert apply(spark, parse.to_int, ["2026", "12.9", "-12.9", "x"]) == [2026, 12, -12, None]


def test_quarter_labels_order_by_time(spark):
    months = apply(spark, parse.label_month, ["Jun 2026", "Mar 2026", "FY26", None])
    assert months == [dt.date(2026, 6, 1), dt.date(2026, 3, 1), dt.date(1, 1, 1), dt.date(1, 1, 1)]


def test_header_from_period_end(spark):
    rows = [("FY 2026", dt.date(2026, 3, 31)), ("", dt.date(2026, 3, 31)), (None, dt.date(2025, 12, 31)), (None, None)]
    df = spark.createDataFrame(rows, "h string, d date").coalesce(1)
    got = [r[0] for r in df.select(parse.header_or_period_end("h", "d")).collect()]
    assert got == ["FY 2026", "Mar 2026", "Dec 2025", None]


def test_text_hash_ignores_case_and_spacing(spark):
    a, b = apply(spark, parse.text_hash, ["  PE <\n 20 ", "pe < 20"])
    assert a == b == hashlib.sha256(b"pe < 20").hexdigest()[:16]


def test_redaction(spark):
    long = "x" * 5000
    assert apply(spark, parse.redact, [long]) == [long]
    stored = lambda c: parse.redact(c, parse.MESSAGE_LENGTH)
    got = apply(spark, stored, ["GET /q?token=abc&x=1 token=zz end", long])
    assert got == ["GET /q?token=REDACTED&x=1 token=REDACTED end", "x" * 4000]


def test_params_hash_does_not_depend_on_key_order(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"},), ({"a": "1", "b": "2"},)], "m map<string,string>")
    hashes = {r[0] for r in df.select(parse.params_hash("m")).collect()}
    text = json.dumps({"a": "1", "b": "2"}, sort_keys=True, separators=(",", ":"))
    assert hashes == {hashlib.sha256(text.encode()).hexdigest()}


def test_symbol_of_endpoint(spark):
    paths = ["/api/v1/financials/RELIANCE", "/api/v1/index/master", "/api/v1/quote/all", "/api/v1/quote", "/x/y/z/T",
             "/api/v1/corporate-actions/split/ABC/"]
    assert apply(spark, parse.symbol_of_endpoint, paths) == ["RELIANCE", "", "", "", "", "ABC"]
