"""The filter audit against a plain count over all orders, and the adders against bit counts."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st

from bourselight.llm.filter_audit import PositionalCounter, audit, survival_words
from bourselight.llm.queries_audit import OP11_SQL, op11
from tests.llm.helpers import FOLDER, SCHEMA, docs_of, documents, stored, words
from tests.oracle import compare, connect

FIGURES = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
LABELS = "doc_id long, quality int, toxic int"


def plain_audit(docs: list[dict], labels: list[dict]) -> dict:
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    least: dict = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            least[t] = min(least.get(t, d["doc_id"]), d["doc_id"])
    parts = defaultdict(list)
    for d in docs:
        t, w, i = d["text"] or "", words(d["text"]), d["doc_id"]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        parts[d["lang"] or ""].append((i, {f for f in fails if fails[f]}))
    out, shapley = {}, defaultdict(int)
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            alive = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [
                    len(alive), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(rows):
    out = {(r.part, r.filter_order, r.step): tuple(r[f] for f in FIGURES) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark):
    labels = pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()
    assert as_dict(op11(spark, FOLDER).collect()) == plain_audit(documents(), labels)
    assert compare(op11, OP11_SQL, spark, connect(FOLDER), FOLDER)[0] == "ok"


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(300))
    rows = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (2, long, None), (3, None, ""), (4, "", "en"), (None, long, "en"),
        (5, "A#", "de"), (5, "a " * 400, "de"), (6, "É" * 10 + "\n\t \x0b", "de"), (7, long + "|", None), (0, "x" * 3_000_000, "de"),
    ]
    docs = [dict(doc_id=i, text=t, lang=x) for i, t, x in rows]
    labels = [(2, 1, 0), (2, None, 1), (None, 1, 1), (5, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame([(i, t, x, "s", 0, "p", 1) for i, t, x in rows], SCHEMA + ", part string, failed int")
    marks = spark.createDataFrame(labels, LABELS)
    got = as_dict(audit(stored(table, tmp_path), marks).collect())
    assert got == plain_audit(docs, [dict(doc_id=i, quality=q, toxic=t) for i, q, t in labels])
    assert all(kind == "bigint" for n, kind in audit(table, marks).dtypes if n in FIGURES)


def test_empty_tables(spark, tmp_path):
    marks = spark.createDataFrame([], LABELS)
    assert audit(stored(docs_of(spark, []), tmp_path), marks).collect() == []
    assert {r.part for r in audit(docs_of(spark, [(1, "a")]), marks).collect()} == {"en"}


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12))
def test_adders_count_every_bit(batches):
    counter = PositionalCounter()
    for batch in batches:
        counter.add(np.array(batch, np.uint32))
    flat = [w for b in batches for w in b]
    assert counter.counts() == [sum(w >> k & 1 for w in flat) for k in range(32)]
    assert all(len(w) < 3 for w in counter.waiting)


def test_a_survival_word_tells_every_subset():
    for failed, word in enumerate(survival_words().tolist()):
        assert [word >> s & 1 for s in range(32)] == [int(failed & s == 0) for s in range(32)]
