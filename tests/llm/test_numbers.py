"""Row numbers stay with their rows although the splits of later scans move, as they do when executors come or go."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import corpus_pipeline
from bourselight.llm.common import Steps, numbered
from bourselight.llm.queries import op3
from bourselight.llm.repeats import remove_repeats
from tests.llm.helpers import docs_of

TEXTS = [f"text {k} " + " ".join(f"w{k}x{j}" for j in range(60)) for k in range(60)]


@contextmanager
def moved_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(name)
    spark.conf.set(name, "400b")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def table_of(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs_of(spark, list(enumerate(TEXTS + TEXTS[:20]))).repartition(5, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def test_numbers_are_stored(spark, tmp_path):
    docs = table_of(spark, tmp_path)
    rows = numbered(docs, Steps(spark, "test"))
    before = {r.rid: r.body for r in rows.select("rid", "body").collect()}
    with moved_splits(spark):
        assert {r.rid: r.body for r in rows.select("rid", "body", "row.doc_id").collect()} == before
    assert len(before) == 80


def test_digests_and_stages(spark, tmp_path):
    docs = table_of(spark, tmp_path)
    exact, digests = corpus_pipeline.exact(spark, docs, ""), op3(spark, str(tmp_path))
    cuts = remove_repeats(docs)
    with moved_splits(spark):
        assert sorted(r.doc_id for r in exact.collect()) == list(range(20, 80))
        texts = TEXTS + TEXTS[:20]
        assert all(r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in digests.collect())
        assert {r.doc for r in cuts.collect() if r.n_removed} == {*range(20), *range(60, 80)}
