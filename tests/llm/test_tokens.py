"""Packing and token files against whole-text encoding."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bourselight.llm.common import Steps, with_row
from bourselight.llm.packing import TIERS, Piece, Waiting, balanced, pack, pack_tiers
from bourselight.llm.queries import op2, op7, tokenizer_path
from bourselight.llm.token_files import RAW, _tokenise, decode_codes, encode_codes, read_token_files, write_token_files
from bourselight.llm.token_ids import encoder
from tests.llm.helpers import FOLDER, crc, docs_of, documents, stored, whole_text_ids

EDGE = [(3, None), (1, ""), (2, " leading  double\n\nlines \t tab nbsp 　wide"), (5, "word " * 9000), (5, "repeat, repeat."),
        (4, "x" * 20_000), (None, "no id"), (9, "<|endoftext|> é́ 123,456. It's 'quoted' ")]


@given(st.text(alphabet=st.sampled_from(list("aé1.,'! \n\t  <|>文")) | st.characters(), max_size=60))
@settings(max_examples=300, deadline=None)
def test_cached_pieces_give_the_ids_of_the_whole_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder(tokenizer_path()).ids(text), "<u4").tolist() == whole_text_ids([text], 7)[0][:-1]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_codes_round_trip(values):
    control, data = encode_codes(np.array(values, np.uint32))
    assert decode_codes(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


@given(st.lists(st.integers(1, 2048), max_size=80))
@settings(deadline=None)
def test_windows_are_full(lengths):
    waiting = Waiting(2048)
    for k, n in enumerate(lengths):
        waiting.add(Piece(k, 0, n))
    windows = list(pack_tiers(waiting, TIERS, last=True))
    assert sum(sum(p.length for p in w) < t for t, w in windows) <= 1
    seen = defaultdict(list)
    for _, w in windows:
        for p in w:
            seen[p.doc] += range(p.start, p.start + p.length)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(lengths)}


def test_step_groups_are_balanced():
    groups = balanced([9, 1, 8, 2, 7, 3, 6, 4], 4)
    assert sorted(groups) == [0] * 4 + [1] * 4
    assert [sum(c for c, g in zip([9, 1, 8, 2, 7, 3, 6, 4], groups, strict=True) if g == k) for k in (0, 1)] == [20, 20]


def check_pieces(rows, pieces):
    texts = {}
    for (i, t), ids in zip(rows, whole_text_ids([t for _, t in rows], 1), strict=True):
        texts.setdefault(i, []).append(ids)
    sequences, covered = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        assert any(crc(ids[p.start : p.start + p.length]) == p.ids_crc32 and len(ids) == p.doc_tokens for ids in texts[p.doc_id])
        covered[p.doc_id] += range(p.start, p.start + p.length)
    for i, docs in texts.items():
        assert sorted(covered[i]) == sorted(k for ids in docs for k in range(len(ids)))
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(spark, tmp_path):
    docs = stored(docs_of(spark, EDGE, "rid tier length").coalesce(1), tmp_path)
    assert check_pieces(EDGE, pack(docs, tokenizer_path()).collect()) < 2048
    assert pack(stored(docs_of(spark, []), tmp_path / "e"), tokenizer_path()).count() == 0


def test_packing_query(spark):
    rows = [(d["doc_id"], d["text"]) for d in documents()]
    assert check_pieces(rows, op2(spark, FOLDER).collect()) < 2048


def expected_files(rows):
    out, start = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for (i, _), ids in zip(order, whole_text_ids([t for _, t in order], 0), strict=True):
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("extra", ["", "doc rid ids start shard"])
def test_token_files(spark, tmp_path, extra):
    docs = stored(docs_of(spark, EDGE, extra).coalesce(1), tmp_path)
    steps = Steps(spark, "test-files")
    write_token_files(docs, tokenizer_path(), steps)
    got = sorted((tuple(r) for r in read_token_files(steps).collect()), key=lambda r: r[1])
    assert got == expected_files(EDGE)


def test_frequent_ids_take_one_byte(spark, tmp_path):
    steps = Steps(spark, "test-ranks")
    ids = write_token_files(stored(docs_of(spark, [(1, "the the the cat")]), tmp_path), tokenizer_path(), steps)
    assert ids[0] == whole_text_ids([" the"], 0)[0][0]
    block = spark.read.parquet(steps.path("tokens")).first()
    assert (len(block.control), len(block.data)) == (2, 5)


def test_blocks_count_their_ids_in_two_bytes(spark, tmp_path):
    rows, path = [(1, "the cat, the cat"), (2, None)], tokenizer_path()
    docs = stored(docs_of(spark, rows).coalesce(1), tmp_path)
    raw = with_row(docs, doc=F.col("doc_id")).select("doc", "body").mapInArrow(lambda it: _tokenise(it, path), RAW).collect()
    ids = [i for r in raw for i in np.frombuffer(r.ids, "<u2").tolist()]
    assert sorted(ids) == sorted(i for one in whole_text_ids([t for _, t in rows], 0) for i in one)
    assert {r.width for r in raw} == {2}
    assert sum((Counter(dict(zip(r.seen, r.times, strict=True))) for r in raw), Counter()) == Counter(ids)


def test_token_files_of_an_empty_table(spark, tmp_path):
    steps = Steps(spark, "test-empty")
    write_token_files(stored(docs_of(spark, []), tmp_path), tokenizer_path(), steps)
    assert read_token_files(steps).count() == 0


def test_token_file_query(spark):
    rows = [(d["doc_id"], d["text"]) for d in documents()]
    assert sorted(tuple(r) for r in op7(spark, FOLDER).collect()) == sorted(expected_files(rows))
