"""Joins, rankings and medians under heavy skew, against brute force."""

from __future__ import annotations

import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from bourselight.operators import spread
from bourselight.operators.spread import exact_median, exact_medians, lookup, numbered, top_n


def skewed(n=6000, seed=7):
    """Rows where one key holds two thirds, with repeated, negative, zero, tiny and huge values."""
    rng = random.Random(seed)
    kinds = [lambda: round(rng.gauss(20, 3), 2), lambda: rng.uniform(-1e9, 1e9), lambda: 0.0, lambda: 15.5,
             lambda: rng.uniform(-1e-9, 1e-9)]
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.67 else f"k{rng.randrange(40)}"
        rows.append((i, key, rng.choice(kinds)() if rng.random() > 0.05 else None))
    return rows


def test_exact_median_equals_brute_force(spark):
    rows = skewed()
    groups = defaultdict(list)
    for _, key, value in rows:
        if value is not None:
            groups[key].append(value)
    df = spark.createDataFrame(rows, "id long, key string, value double").repartition(8)
    got = {r["key"]: (r["median"], r["count"]) for r in exact_median(df, ["key"]).collect()}
    assert got == {k: (statistics.median(v), len(v)) for k, v in groups.items()}
    overall = exact_median(df, []).collect()
    assert [(r["median"], r["count"]) for r in overall] == [
        (statistics.median([v for vs in groups.values() for v in vs]), sum(map(len, groups.values())))
    ]


def test_median_averages_the_middle_two(spark):
    df = spark.createDataFrame([(v,) for v in (6.00, 8.24, 23.99, 50.45)], "value double")
    assert exact_median(df, []).collect()[0]["median"] == 16.115
    assert exact_median(df.where("value < 0"), []).collect() == []


def test_medians_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", None, None)], "k string, x double, y double")
    got = {r["k"]: (r["median_x"], r["median_y"]) for r in exact_medians(df, ["k"], {"x": F.col("x"), "y": F.col("y")}).collect()}
    assert got == {"a": (2.0, None), "b": (None, None)}


def test_top_n_of_a_hot_group_beyond_the_pre_shuffle_rank(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "id long, key string, value double").repartition(8)
    got = defaultdict(list)
    for r in top_n(df, ["key"], [F.col("id").desc()], 1500, spread=["id"]).collect():
        got[r["key"]].append((r["position"], r["id"]))
    want = defaultdict(list)
    for i, key, _ in sorted(rows, reverse=True):
        if len(want[key]) < 1500:
            want[key].append((len(want[key]) + 1, i))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_lookup_keeps_every_row_once(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "id long, key string, value double")
    keys = [("hot", 1), *[(f"k{i}", i) for i in range(0, 40, 2)]]
    dim = spark.createDataFrame(keys, "key string, n int")
    got = {r["id"]: r["n"] for r in lookup(df, dim, ["key"], ["id"]).collect()}
    assert got == {i: dict(keys).get(key) for i, key, _ in rows}
    assert lookup(df, dim, ["key"], ["id"], how="inner").count() == sum(key in dict(keys) for _, key, _ in rows)


def test_numbered_equals_brute_force(spark):
    rows = [(i, key, i % 97) for i, key, _ in skewed(3000)]
    df = spark.createDataFrame(rows, "id long, key string, day int").repartition(8)
    got = {r["id"]: r["position"] for r in numbered(df, ["key"], -F.col("day"), [F.col("day").desc(), F.col("id")]).collect()}
    want, seen = {}, defaultdict(int)
    for i, key, day in sorted(rows, key=lambda r: (-r[2], r[0])):
        seen[key] += 1
        want[i] = seen[key]
    assert got == want


def test_median_of_a_group_within_a_thousandth(spark):
    rng = random.Random(8)
    rows = [("hot", 100 + rng.random() / 10) for _ in range(4001)] + [("cold", float(k)) for k in range(10)] + [("cold", None)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(8)
    got = {r["key"]: (r["median"], r["count"]) for r in exact_median(df, ["key"]).collect()}
    hot = [v for k, v in rows if k == "hot"]
    assert got == {"hot": (statistics.median(hot), 4001), "cold": (4.5, 10)}


def test_a_hot_group_is_cut_to_its_middle(spark):
    rows = [("hot", 100 + k / 100_000) for k in range(40_000)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(8)
    measures = {"value": F.col("value")}
    inside = spread._in_brackets(df, ["key"], measures, spread._brackets(df, ["key"], measures))
    assert inside.count() <= 40_000 * 10 / spread.SKETCH + 2 and inside.agg(F.sum("_w")).scalar() is not None
    ranges = spread._middle_ranges(inside, ["key", "_name"])
    assert 0 < ranges.count() <= 2


def test_medians_need_no_nested_loop(spark):
    df = spark.createDataFrame([("a", 1.0)], "key string, value double")
    for keys in (["key"], []):
        plan = exact_median(df, keys)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_medians_of_extremes_and_infinities(spark):
    rows = [("a", v) for v in (float("-inf"), -1.7e308, 1.7e308, float("inf"), float("nan"))] + [("b", float("nan"))]
    df = spark.createDataFrame(rows, "key string, value double")
    assert [(r["key"], r["median"], r["count"]) for r in exact_median(df, ["key"]).collect()] == [("a", 0.0, 4)]
