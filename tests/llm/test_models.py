"""Language-model scores and piece lattices against plain versions."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from bourselight.llm import piece_lattice
from bourselight.llm.lm_score import ORDER, PRIOR, _score, cross_entropy_difference
from bourselight.llm.piece_lattice import SPACE, decode, encode, load, segment
from bourselight.llm.queries_models import op1, op4
from tests.llm.helpers import FOLDER, docs_of, documents, stored

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_scores(rows, good):
    """Scores by direct counting."""
    counts = {"t": [Counter() for _ in range(2 * ORDER)], "b": [Counter() for _ in range(2 * ORDER)]}
    padded = [(i, b"\0" * (ORDER - 1) + (t or "").encode()) for i, t in rows]
    for i, b in padded:
        for m in ["b", "t"] if i in good else ["b"]:
            for at in range(ORDER - 1, len(b)):
                for k in range(ORDER):
                    counts[m][k][b[at - k : at + 1]] += 1
                    counts[m][ORDER + k][b[at - k : at]] += 1

    def loss(m, gram):
        p = 1 / 256
        for k in range(ORDER):
            p = (counts[m][k][gram[ORDER - 1 - k :]] + PRIOR * p) / (counts[m][ORDER + k][gram[ORDER - 1 - k : -1]] + PRIOR)
        return -math.log2(p)

    out = []
    for i, b in padded:
        n = len(b) - ORDER + 1
        both = [sum(loss(m, b[at - 3 : at + 1]) for at in range(ORDER - 1, len(b))) / max(n, 1) for m in "tb"]
        out.append((i, n, *both))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0], r[1], r[2])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2:4] == pytest.approx(w[2:4], abs=2e-6)


def test_a_block_with_another_blocks_entries_fails():
    docs = pa.table({"rid": [1], "doc": [1], "body": ["abc"]})
    entries = pa.table({"gram": [int.from_bytes(b"abc", "big")], "target": [1.0], "background": [1.0]})
    for model in (entries, entries.slice(0, 0)):
        with pytest.raises(ValueError, match="another block"):
            _score((0,), docs, model)


def test_scores(spark, tmp_path):
    rows = [(1, "the cat sat"), (2, "the dog sat"), (3, "@@@ zzz"), (4, None), (5, ""), (6, "é" * 400), (6, "the cat"), (7, "the cat sat"), (None, "a\0b")]
    docs = stored(docs_of(spark, rows, "good gram block rid"), tmp_path)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (1, 0, 0), (3, 0, 1), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = cross_entropy_difference(docs, labels).collect()
    close([(r.doc, r.n_tokens, r.target_loss, r.background_loss) for r in out], plain_scores(rows, {1, 2}))
    scores = {r.doc: r.score for r in out if r.doc != 6}
    assert scores[2] < scores[3] and scores[4] == 0


def test_scores_without_documents_or_labels(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert cross_entropy_difference(stored(docs_of(spark, []), tmp_path), labels).count() == 0
    rows = [(1, "abc")]
    out = cross_entropy_difference(stored(docs_of(spark, rows), tmp_path / "x"), labels).first()
    assert out.target_loss == pytest.approx(8) and out.background_loss < 8


def test_score_query(spark):
    import pyarrow.parquet as pq

    good = {r["doc_id"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist() if r["quality"] == 1}
    rows = [(d["doc_id"], d["text"]) for d in documents()]
    close([tuple(r) for r in op1(spark, FOLDER).collect()], plain_scores(rows, good))


def by_library():
    """The library's encoder on the same model, read under the unigram rule."""
    import sentencepiece

    data = bytearray(open(MODEL, "rb").read())

    def varint(at):
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    def fields(at, end):
        while at < end:
            tag, body = varint(at)
            if tag & 7 == 2:
                size, body = varint(body)
                nxt = body + size
            else:
                nxt = varint(body)[1] if tag & 7 == 0 else body + (4 if tag & 7 == 5 else 8)
            yield tag >> 3, body, nxt
            at = nxt

    for number, body, nxt in fields(0, len(data)):
        if number == 2:
            for inner, at, _ in fields(body, nxt):
                if inner == 3:
                    assert data[at] == 2
                    data[at] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


def plain_path(unit, vocabulary):
    table = {p: (i, s) for p, i, s in vocabulary.pieces}
    best = [(0.0, 0, [])]
    for end in range(1, len(unit) + 1):
        found = None
        for start in range(max(0, end - vocabulary.longest), end):
            piece = unit[start:end]
            if piece in table or end - start == 1:
                i, s = table.get(piece, (None, vocabulary.unknown))
                ids = [i] if i is not None else [vocabulary.first_byte + b for b in piece.encode()]
                if found is None or best[start][0] + s > found[0]:
                    found = (best[start][0] + s, start, ids)
        best.append(found)
    out, at = [], len(unit)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [i for ids in reversed(out) for i in ids]


UNITS = ["▁the", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁x", "internationalisation", "▁été", "文字𝒳", "!!!...---", "\n\n\t", "▁", "aaaa" * 700, "123.456", "³½"]


def test_paths_of_units(spark):
    vocabulary = load(MODEL)
    units = spark.createDataFrame(list(enumerate(UNITS)), "uid long, unit string")
    got = {r.uid: r.ids for r in segment(units, vocabulary).collect()}
    assert got == {k: plain_path(u, vocabulary) for k, u in enumerate(UNITS)}


TEXTS = [(1, "The quick brown fox, jumped over 12 lazy dogs."), (2, None), (3, ""), (4, " "), (5, "  two  spaces \n\n lines\t"), (6, "▁ real ▁▁mark"),
         (7, "x" * 5000), (8, "emoji 😀 é́ 文字 \0 end"), (8, "twice"), (None, "no id"), (9, "word " * 3000)]


def test_texts_round_trip_and_match_the_library(spark, tmp_path):
    vocabulary, library = load(MODEL), by_library()
    docs = stored(docs_of(spark, TEXTS, "ids unit block uid"), tmp_path)
    out = decode(encode(docs, vocabulary, block_bytes=6000), vocabulary).collect()
    assert sorted((r.doc or 0, r.text) for r in out) == sorted((i or 0, (t or "").replace(SPACE, " ")) for i, t in TEXTS)
    ids = {r.text: np.frombuffer(r.ids, "<u4").tolist() for r in out}
    for text in (TEXTS[0][1], "twice", "no id", "x" * 5000):
        assert ids[text] == library.encode(text)


def test_real_words_match_the_library(spark, tmp_path):
    vocabulary, library = load(MODEL), by_library()
    words = sorted({w for d in documents()[:60] for w in (d["text"] or "").split() if w.isascii()})[:1500]
    units = spark.createDataFrame([(k, SPACE + w) for k, w in enumerate(words)], "uid long, unit string")
    got = {r.uid: r.ids for r in segment(units, vocabulary).collect()}
    assert [got[k] for k in range(len(words))] == [library.encode(w) for w in words]


def test_texts_are_encoded_where_they_are_read(spark, tmp_path):
    encoded = encode(stored(docs_of(spark, TEXTS), tmp_path), load(MODEL))
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()


def test_a_worker_holds_a_bounded_number_of_paths(monkeypatch):
    vocabulary = load(MODEL)
    monkeypatch.setattr(piece_lattice, "HELD", 50)
    lattice = piece_lattice.Lattice(vocabulary)
    texts = [f"text {k} of some words" for k in range(200)] + ["x" * 100 + " line\nend", "  "]
    for text in texts:
        ids = [i for unit in piece_lattice.UNIT.findall(SPACE + text.replace(" ", SPACE)) for i in plain_path(unit, vocabulary)]
        assert np.frombuffer(lattice.ids(text), "<u4").tolist() == ids
        assert len(lattice.units) + len(lattice.words) <= 60


def test_encode_nothing(spark, tmp_path):
    assert encode(stored(docs_of(spark, []), tmp_path), load(MODEL)).count() == 0


def test_piece_query(spark):
    import zlib

    vocabulary, texts = load(MODEL), {d["doc_id"]: d["text"] for d in documents()}
    held = {}
    for r in op4(spark, FOLDER).collect():
        assert r.decoded_alike
        if r.doc_id % 9 == 0:
            text = SPACE + (texts[r.doc_id] or "").replace(" ", SPACE)
            ids = []
            import regex

            for unit in regex.findall(rf"{SPACE}*[^{SPACE}]+|{SPACE}+$", text if texts[r.doc_id] else ""):
                if unit not in held:
                    held[unit] = plain_path(unit, vocabulary)
                ids += held[unit]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
