"""A corpus pipeline of five stages over `documents`; each stage reads what its predecessor stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselight.llm.common import Steps, numbered, table
from bourselight.llm.dart_minhash import near_duplicates
from bourselight.llm.packing import pack
from bourselight.llm.quality_rules import judge
from bourselight.llm.queries import tokenizer_path
from bourselight.llm.radix_dedup import exact_dedup
from bourselight.llm.sanitise import sanitise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return judge(docs).where("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows = numbered(docs, Steps(spark, "exact"))
    kept = exact_dedup(docs, rows=rows).where("kept").select("rid")
    return rows.join(kept.hint("merge"), "rid", "left_semi").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    rows = numbered(docs, Steps(spark, "near"))
    kept = near_duplicates(docs, rows=rows).where("kept").select("rid")
    return rows.join(kept.hint("merge"), "rid", "left_semi").select("row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what reveals it replaced in their text."""
    text = F.when(F.col("row.text").isNotNull(), F.col("clean"))
    return sanitise(docs).select(
        *[
            {"text": text, "n_chars": F.length(text).cast("long")}.get(c, F.col(f"row.`{c}`")).alias(c)
            for c in docs.columns
        ]
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack(docs, tokenizer_path()).drop("rid")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("sanitise", private),
    ("packing", packed),
]

# Near-duplicate classes and token packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages in order, each to the stored result of the one before."""
    steps, docs = Steps(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = steps.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
