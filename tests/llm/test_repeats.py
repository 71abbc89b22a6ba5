"""Removal of repeated strings against a dictionary of all strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from bourselight.llm.queries_records import op10
from bourselight.llm.repeats import _least, remove_repeats
from tests.llm.helpers import FOLDER, docs_of, documents, stored


def brute(rows, length: int):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) per row."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def got(docs, length=200):
    return ordered(tuple(r)[1:6] for r in remove_repeats(docs, length).collect())


def passages(seed: int):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [prose(n) for n in (150, 199, 200, 201, 260, 700)]
    rows = []
    for i in range(60):
        text = prose(rng.randrange(300))
        for _ in range(rng.randrange(4)):
            passage = rng.choice(shared)
            cut = rng.randrange(1, 120) if rng.random() < 0.4 else 0
            text += passage[cut:] + prose(rng.randrange(60))
        rows.append((i, text))
    rows += [(100 + k, "z" * n) for k, n in enumerate((0, 199, 200, 201, 900))] + [(200, "xy" * 400), (201, None), (202, rows[5][1]), (202, rows[5][1])]
    return rows + [(None, rows[7][1]), (203, prose(60_000)), (204, rows[3][1][1:] + "!")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_strings(spark, tmp_path, seed):
    rows = passages(seed)
    docs = stored(docs_of(spark, rows, "rid seed n body cuts" if seed == 1 else ""), tmp_path)
    assert got(docs) == ordered(brute(rows, 200))


def test_nothing_and_little(spark, tmp_path):
    assert got(stored(docs_of(spark, []), tmp_path)) == []
    rows = [(1, "short"), (2, "short"), (3, None)]
    assert got(stored(docs_of(spark, rows), tmp_path / "x")) == ordered(brute(rows, 200))


def test_least_of_windows():
    values = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    for width in (1, 7, 169):
        assert _least(values, width).tolist() == [values[k : k + width].min() for k in range(500 - width + 1)]


def test_query(spark):
    rows = [(d["doc_id"], d["text"]) for d in documents()]
    assert ordered(tuple(r) for r in op10(spark, FOLDER).collect()) == ordered(brute(rows, 200))
