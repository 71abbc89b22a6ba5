"""Cross-parsing against a parse by plain substring search, automata against substrings, and held-out accuracy."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st

from bourselight.llm import languages
from bourselight.llm.languages import Parser, identify, sample, suffix_automaton, symbols
from bourselight.llm.queries_audit import op13
from tests.llm.helpers import FOLDER, SCHEMA, docs_of, stored

AB = st.text("ab ", max_size=30).map(str.encode)


def learned(names_and_texts):
    return [(n, len(t), s[3], *[x.tobytes() for x in s[:3]]) for n, t in names_and_texts for s in [suffix_automaton(t)]]


def plain_phrases(text: bytes, labelled: bytes) -> int:
    n = 0
    for begin in range(0, len(text), languages.SEGMENT):
        segment, at = text[begin : begin + languages.SEGMENT], 0
        while at < len(segment):
            size = 1
            while at + size < len(segment) and segment[at : at + size + 1] in labelled:
                size += 1
            at, n = at + size, n + 1
    return n


@given(AB)
def test_automaton_holds_exactly_the_substrings(text):
    source, symbol, target, states = suffix_automaton(text)
    follow = {(s, c): t for s, c, t in zip(source.tolist(), symbol.tolist(), target.tolist())}
    paths, count = [(0, b"")], 0
    while paths:
        state, path = paths.pop()
        assert path in text
        count += 1
        paths += [(t, path + bytes([c])) for (s, c), t in follow.items() if s == state]
    assert count == len({text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)})
    assert states <= max(2, 2 * len(text)) and len(follow) <= max(1, 3 * len(text))


@given(st.lists(AB.filter(len), min_size=1, max_size=3), st.lists(st.text("abz ", max_size=60).map(str.encode), min_size=1, max_size=6))
def test_phrases_are_longest_matches(labelled, texts):
    parser = Parser(learned([(str(k), t) for k, t in enumerate(labelled)]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert parser.phrases(data, offsets).tolist() == [[plain_phrases(t, l) for l in labelled] for t in texts]


def test_long_texts_are_parsed_whole(monkeypatch):
    monkeypatch.setattr(languages, "SEGMENT", 7)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abc "), n).tolist()) for n in (0, 1, 6, 7, 8, 1000, 15, 14)]
    parser = Parser(learned([("x", texts[5][:50]), ("y", b"cab")]))
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = parser.phrases(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got.tolist() == [[plain_phrases(t, texts[5][:50]), plain_phrases(t, b"cab")] for t in texts]


def test_symbols_are_letters_and_single_spaces():
    texts = ["a1 2b", "--", "", "é!É", "x\n\ny "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    out, cut = symbols(data, offsets)
    pieces = [out[a:b].tobytes().decode() for a, b in zip(cut, cut[1:])]
    assert pieces == ["a b", " ", "", "é É", "x y "]


def remainder(doc_id) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 4


def test_held_out_accuracy_and_whole_table(spark):
    folder = FOLDER.replace("0.001", "0.1")
    truth = {r["doc_id"]: r for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    got = op13(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(truth))
    right = total = 0
    for r in got:
        text, lang = truth[r.doc_id]["text"], truth[r.doc_id]["lang"]
        assert r.held_out == (remainder(r.doc_id) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
        if r.held_out and r.lang_pred != "und":
            total, right = total + 1, right + (r.lang_pred == lang)
    assert total > 2000 and right / total > 0.97


def test_prediction_reads_text_alone(spark, tmp_path):
    rows = [(k, f"the dog number {'abcdefghij'[k % 10]} was in the house and on the hill", "en", "s", 1) for k in range(60)]
    rows += [(100 + k, f"le chien numéro {'abcdefghij'[k % 10]} était dans la maison et sur la colline", "fr", "s", 1) for k in range(60)]
    odd = [(900, None), (901, ""), (902, "12 + 34 !"), (None, "the dog was on the hill"), (903, "la maison était sur la colline " * 90_000)]
    odd += [(904, "the house")] * 3
    held = next(k for k in range(1000, 2000) if remainder(k) == 2)
    out = {}
    for lang in ("en", "fr", None):
        extra = [(i, t, None if i != held else lang, "x", 0) for i, t in [*odd, (held, "dans la maison")]]
        docs = stored(spark.createDataFrame(rows + extra, SCHEMA).withColumnsRenamed({"source": "row"}), tmp_path / str(lang))
        out[lang] = sorted(((r.row.doc_id, r.lang_pred, r.score) for r in identify(docs).collect()), key=str)
    assert out["en"] == out["fr"] == out[None]
    got = {(i, p) for i, p, _ in out["en"] if i is None or i >= 900}
    assert got == {(900, "und"), (901, "und"), (902, "und"), (None, "en"), (903, "fr"), (904, "en"), (held, "fr")}
    assert len(out["en"]) == len(rows) + len(odd) + 1


def test_no_language_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the dog", None, "s", 1)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in identify(docs).collect()] == [("und", 0.0)]
    assert identify(stored(docs_of(spark, []), tmp_path)).collect() == []


def test_samples_are_bounded_and_hold_copies_once(spark):
    rows = [(f"text {'x' * 3} {k % 50} und so weiter bis zum ende", lang) for lang in ("de", "nl") for k in range(400)]
    found = sample(spark.createDataFrame(rows, "text string, lang string"), documents=20, piece=16, budget=200).collect()
    assert {r.lang for r in found} == {"de", "nl"} and all(len(r.sample) == 100 for r in found)


def test_nulls_in_a_batch_keep_their_place():
    parser = Parser(learned([("x", b"aaa"), ("y", b"bbb")]))
    names, score = parser.best(pa.array(["aa", "bb", "ab", ""]))
    assert names == ["x", "y", "x", "x"] and score[0] > 0 and score[2] == 0
