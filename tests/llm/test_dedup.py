"""Exact and near deduplication against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from bourselight.llm.common import with_row
from bourselight.llm.dart_minhash import near_duplicates, signatures
from bourselight.llm.queries import op6
from bourselight.llm.radix_dedup import exact_dedup
from tests.llm.helpers import FOLDER, docs_of, documents, folded, near_classes, stored

EDGE = [(1, None), (2, ""), (3, "Same Text"), (4, "same text"), (5, "same text "), (6, "x" * 300_000), (7, "X" * 300_000),
        (8, "x" * 299_999 + "y"), (9, "É"), (10, "é"), (11, "same text"), (11, "same text"), (None, "same text"), (None, "lone"), (12, "same")]


@pytest.mark.parametrize("extra", ["", "kept keep_id group_size row rid body n grp digit done"])
def test_exact_groups(spark, tmp_path, extra):
    docs = stored(docs_of(spark, EDGE, extra), tmp_path)
    out = exact_dedup(docs).join(with_row(docs).select("rid", "row.text"), "rid").collect()
    assert len(out) == len(EDGE)
    groups: dict[str, list] = {}
    for i, t in EDGE:
        groups.setdefault(folded(t), []).append(i)
    for r in out:
        group = groups[folded(r.text)]
        assert r.group_size == len(group)
        assert r.keep_id == max((i for i in group if i is not None), default=None)
    for text in groups:
        assert sum(r.kept for r in out if folded(r.text) == text) == 1


def test_exact_on_an_empty_table(spark, tmp_path):
    assert exact_dedup(stored(docs_of(spark, []), tmp_path)).count() == 0


def test_signatures_agree_as_often_as_weighted_sets_do():
    rng = np.random.default_rng(5)
    elements = rng.integers(1, 2**63, 300, dtype=np.uint64)
    a, b = rng.uniform(0.2, 9, 300), rng.uniform(0.2, 9, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    text = np.repeat([0, 1], 300)
    sig = signatures(text, np.concatenate((elements, elements)), np.concatenate((a, b)), 2, k=4000)
    assert (sig != 0).all()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def variants(seed: int):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, number = [], 0
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 240]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((number, " ".join(own) if group % 3 else " ".join(own).title()))
            number += 1
    return rows + [(number, None), (number + 1, ""), (number + 2, " \n"), (number + 3, "Ein"), (number + 4, "ein")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes(spark, tmp_path, seed):
    rows = variants(seed)
    want = near_classes(rows)
    out = near_duplicates(stored(docs_of(spark, rows, "kept n node label el doc"), tmp_path)).collect()
    assert {r.doc for r in out} == set(want)
    for r in out:
        assert (r.class_id, r.class_size) == (max(want[r.doc]), len(want[r.doc]))
        assert r.kept == (r.doc == r.class_id)


def test_weighted_near_classes(spark, tmp_path):
    line, other = "one two three four five ", "six seven eight nine ten "
    rows = [(1, line * 20 + other * 2), (2, line * 21 + other * 2), (3, line * 2 + other * 20)]
    out = {r.doc: r.class_id for r in near_duplicates(stored(docs_of(spark, rows), tmp_path), weighted=True).collect()}
    assert out == {1: 2, 2: 2, 3: 3}


def test_near_on_an_empty_table_and_repeated_rows(spark, tmp_path):
    assert near_duplicates(stored(docs_of(spark, []), tmp_path)).count() == 0
    out = near_duplicates(stored(docs_of(spark, [(1, "a b c d e f")] * 3 + [(None, "a b c d e f")]), tmp_path / "x")).collect()
    assert [r.class_id for r in out] == [1] * 4 and sum(r.kept for r in out) == 1


def test_query_on_the_smallest_table(spark):
    want = near_classes([(d["doc_id"], d["text"]) for d in documents()])
    out = op6(spark, FOLDER).collect()
    assert {r.doc_id: (r.class_id, r.class_size) for r in out} == {i: (max(c), len(c)) for i, c in want.items()}
