"""The pipeline against brute-force stages, each on what its predecessor kept."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from bourselight.llm.common import Steps
from bourselight.llm.queries import op5
from tests.llm.helpers import FOLDER, docs_of, documents, folded, near_classes, stored
from tests.llm.test_sanitise import BASE, fits
from tests.llm.test_tokens import check_pieces

NAMES = ["quality_rules", "exact_dedup", "near_dedup", "sanitise", "packing"]


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs, steps, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), Steps(spark, "test"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = steps.save(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    rows = {d["doc_id"]: d["text"] for d in documents()}
    want = {r.doc_id: rows[r.doc_id] for r in op5(spark, FOLDER).collect() if r.kept}
    assert set(kept["quality_rules"]) == set(want)
    groups = defaultdict(list)
    for i, t in want.items():
        groups[folded(t)].append(i)
    want = {max(g): rows[max(g)] for g in groups.values()}
    assert set(kept["exact_dedup"]) == set(want)
    classes = set(near_classes(list(want.items())).values())
    want = {max(c): rows[max(c)] for c in classes}
    assert set(kept["near_dedup"]) == set(want) == set(kept["sanitise"])
    for i, r in kept["sanitise"].items():
        found = any(fits(k, m.group()) for k, p in BASE.items() for m in p.finditer(want[i]))
        assert (r.text != want[i]) == found and r.n_chars == len(r.text)
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert check_pieces([(i, r.text) for i, r in kept["sanitise"].items()], pieces) < 2048


def test_odd_tables_pass_through(spark, tmp_path):
    text = "the story of a man who was in the house and of his dog that came to it with all of the things " * 1
    prose = text + " ".join(f"word{k} of the" for k in range(40))
    rows = [(1, prose), (2, prose.upper()), (3, prose), (3, prose), (None, None), (4, prose + " and mail a@b.example")]
    docs = stored(docs_of(spark, rows, "row rid kept body f clean"), tmp_path)
    empty = stored(docs_of(spark, []), tmp_path / "e")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stored(stage(spark, docs, ""), tmp_path / name)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(docs.columns) == 11
        assert stage(spark, empty, "").count() == 0
    assert [(r.doc_id, r.text) for r in docs.collect()] == [(4, prose + " and mail [EMAIL]")]
