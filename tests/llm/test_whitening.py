"""Whitening against an eigenvalue decomposition of the covariance, and its exact columns against whole numbers."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from bourselight.llm.queries_audit import op12
from bourselight.llm.whitening import whiten
from tests.llm.helpers import FOLDER

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(vector) -> tuple[int, ...] | None:
    if vector is None or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector)


def check(rows, got, tolerance=1e-9):
    """All rows of one length against numpy; returns how many components there are."""
    points = [(i, whole(v)) for i, v in rows]
    points = [(i, x) for i, x in points if x is not None]
    distinct = np.array(sorted({x for _, x in points}), dtype=np.int64)
    n, sums = len(distinct), [sum(int(v) for v in column) for column in distinct.T]
    centred = distinct - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    expect = defaultdict(list)
    for i, x in points:
        expect[i].append((sum((n * int(a) - s) ** 2 for a, s in zip(x, sums)), np.array(x) - np.array(sums) / n))
    found = defaultdict(lambda: defaultdict(list))
    for r in got:
        found[r.component][r.vec_id].append(r)
    kept = min(16, int((values > 1e-9 * values[0]).sum()))
    assert sorted(found) == list(range(1, kept + 1))
    for k in range(kept):
        assert set(found[k + 1]) == set(expect)
        signs = set()
        for i, want in expect.items():
            have = found[k + 1][i]
            assert len(have) == len(want)
            assert sorted(r.deviation for r in have) == sorted(d for d, _ in want)
            for r in have:
                row = next(x for d, x in want if d == r.deviation)
                z = row @ vectors[:, k] / math.sqrt(values[k])
                assert r.n == n and abs(abs(r.whitened) - abs(z)) < 1e-6 * max(1, abs(z))
                if abs(z) > 1e-6:
                    signs.add(np.sign(z) == np.sign(r.whitened))
                assert abs(r.explained - values[k] / values.sum()) <= 1e-9 * r.explained
                assert r.identity_error < tolerance
        assert len(signs) <= 1
    assert len({r.identity_error for r in got}) <= 1
    return kept


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()]
    assert check(rows, op12(spark, FOLDER).collect()) == 16


def frame(spark, rows):
    """Extra columns clash with names that the operator uses itself."""
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA + ", x string, d int")


def test_small_components_keep_their_digits(spark):
    noise = np.random.default_rng(3)
    base = noise.normal(size=(300, 3)) * [300.0, 3.0, 0.1]
    rows = [(k, [float(v) for v in (a + b, a - b, b + c)]) for k, (a, b, c) in enumerate(base)]
    assert check(rows, whiten(frame(spark, rows)).collect()) == 3


def test_constant_dimensions_and_few_rows(spark):
    noise = np.random.default_rng(5)
    rows = [(k, [float(v) for v in (*noise.normal(size=4), 7.0)]) for k in range(100)] + [(5, None)]
    rows += [(200, [0.5] * 4 + [7.0])] * 50  # copies of a row count once
    assert check(rows, whiten(frame(spark, rows)).collect()) == 4
    few = [(k, [float(k == j) for j in range(20)]) for k in range(6)]
    got = whiten(frame(spark, few)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5} and all(r.identity_error < 1e-9 for r in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    noise = np.random.default_rng(7)
    sound = [(None if k == 3 else k // 2, [float(v) for v in noise.normal(size=3)]) for k in range(60)]
    odd = [(90, None), (91, [nan, 0.0, 0.0]), (92, [0.0, -inf, 1.0]), (93, [0.0, None, 1.0]), (94, [])]
    other = [(100 + k, [float(v) for v in noise.normal(size=2)]) for k in range(40)]
    got = whiten(frame(spark, sound + odd + other)).collect()
    assert check(sound, [r for r in got if r.vec_id is None or r.vec_id < 90]) == 3
    assert check(other, [r for r in got if r.vec_id is not None and r.vec_id >= 90]) == 2


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whiten(frame(spark, rows)).collect() == []


def test_large_figures_stay_exact_or_fail(spark):
    rows = [(k, [float(2**23 * (k % 2)), float(k)]) for k in range(6)]
    got = whiten(frame(spark, rows)).collect()
    n, sums = 6, [3 * 2**29 + 6_000_000, 64 * 15 + 6_000_000]
    for r in got:
        x = (2**29 * (r.vec_id % 2) + 1_000_000, 64 * r.vec_id + 1_000_000)
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums)) > 2**60
    with pytest.raises(Exception, match="beyond"):
        whiten(frame(spark, [(1, [2.0**31]), (2, [0.0])])).collect()
