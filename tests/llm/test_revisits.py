"""Revisit resolution on edge cases, against a plain search, and the query against its SQL."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from bourselight.llm.queries_records import OP8_SQL, op8
from bourselight.llm.revisits import canonical_url, resolve, with_body
from tests.llm.helpers import FOLDER
from tests.oracle import compare, connect

SCHEMA = "record_id long, url string, fetched timestamp, kind string, status int, digest string, headers map<string,string>, body string, full string"
DAY = dt.datetime(2024, 1, 1)


def record(i, url, minutes, kind, headers=None, digest=None):
    at = None if minutes is None else DAY + dt.timedelta(minutes=minutes)
    return (i, url, at, kind, 200 if kind == "response" else 304, digest, headers, f"body{i}", "x")


def run(spark, records):
    return {r.record_id: r for r in resolve(spark.createDataFrame(records, SCHEMA)).collect()}


def test_outcomes_and_headers(spark):
    u = "http://a.example/x"
    out = run(spark, [
        record(1, u, 0, "response", {"ETag": '"a"', "Content-Length": "9", "Age": "0", "X": "1"}, "d1"),
        record(2, "HTTP://WWW.a.example:80/x#top", 5, "revisit", {"etag": 'W/"a"', "content-length": "0", "AGE": "7"}),
        record(3, u, 6, "revisit", {"ETag": '"b"'}),
        record(4, u, -5, "revisit", {"ETag": '"a"'}),
        record(5, u, 7, "revisit", None),
        record(6, None, 7, "revisit", {"ETag": '"a"'}),
        record(7, u, None, "revisit", {"ETag": '"a"'}),
        record(8, u + "?utm_source=z&b=2&a=1", 0, "response", {"Last-Modified": "Mon"}, "d8"),
        record(9, u + "?a=1&b=2", 9000, "revisit", {"last-modified": "Mon", "ETag": '"q"'}),
        record(10, u + "?b=2&a=1", 9000, "revisit", {"last-modified": "Tue"}),
        record(11, u, 0, "revisit", {"ETag": '"a"'}),
        record(12, u, 3, None, None),
    ])
    assert {i: (r.outcome, r.refers_to) for i, r in out.items()} == {
        2: ("matched", 1), 3: ("mismatch", None), 4: ("unresolved", None), 5: ("unvalidated", 1), 6: ("unresolved", None),
        7: ("unresolved", None), 9: ("matched", 8), 10: ("mismatch", None), 11: ("matched", 1),
    }
    assert out[2].headers == {"age": "7", "content-length": "9", "etag": 'W/"a"', "x": "1"}
    assert (out[2].status, out[2].digest, out[3].headers, out[3].digest) == (200, "d1", None, None)


def test_latest_earlier_response_of_a_hot_url(spark):
    rng = random.Random(4)
    records = [record(i, rng.choice(["http://hot.example/"] * 9 + ["http://b.example/"]), rng.randrange(6000) / 4, rng.choice(["response", "revisit"])) for i in range(1500)]
    out = run(spark, records)
    for r in (r for r in records if r[3] == "revisit"):
        earlier = [o for o in records if o[3] == "response" and o[1] == r[1] and (o[2], o[0]) < (r[2], r[0])]
        assert out[r[0]].refers_to == (max(earlier, key=lambda o: (o[2], o[0]))[0] if earlier else None)


def test_empty_repeated_and_bodies(spark):
    assert run(spark, []) == {}
    records = [record(1, "http://a/", 0, "response"), record(2, "http://a/", 1, "revisit"), record(2, "http://a/", 1, "revisit")]
    frame = spark.createDataFrame(records, SCHEMA)
    assert [(r.record_id, r.refers_to, r.body) for r in with_body(resolve(frame), frame).collect()] == [(2, 1, "body1")] * 2


def test_null_record_ids_keep_their_own_headers(spark):
    u = "http://a/"
    records = [record(1, u, 0, "response", {"etag": "a"}, "d")]
    records += [record(None, u, k, "revisit", {"etag": "a", "age": str(k)}) for k in (1, 2, 3)]
    out = resolve(spark.createDataFrame(records, SCHEMA)).collect()
    assert sorted((r.record_id is None, r.refers_to, r.outcome, r.headers["age"]) for r in out) == [(True, 1, "matched", a) for a in "123"]


@pytest.mark.parametrize(("url", "want"), [
    ("HTTPS://WWW.Ex.com:443?b=2&a=1#f", "https://ex.com/?a=1&b=2"), ("http://ex.com/A?ref=1", "http://ex.com/A"), ("not a url", "not a url"), ("", ""), (None, None),
    ("http://a.example:443/x", "http://a.example:443/x"), ("https://a.example:80/x", "https://a.example:80/x"),
    ("http://www.a.example:80", "http://a.example/"), ("https://Bob:Pw@WWW.A.example:443/", "https://Bob:Pw@a.example/"),
    ("ftp://a.example:80/x", "ftp://a.example:80/x"),
])
def test_canonical(spark, url, want):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(canonical_url(frame["u"]).alias("c")).first().c == want


def test_query(spark):
    assert compare(op8, OP8_SQL, spark, connect(FOLDER), FOLDER)[0] == "ok"
