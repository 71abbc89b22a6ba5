"""Registered queries on language models and sentence pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselight.llm.common import table
from bourselight.llm.lm_score import cross_entropy_difference
from bourselight.llm.piece_lattice import decode, encode, load
from bourselight.llm.registry import query


@query("op1_cross_entropy_difference")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        F.col("doc").alias("doc_id"), "n_tokens",
        *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")],
    )


@query("op4_piece_lattice")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = decode(encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return coded.select(
        F.col("doc").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("decoded_alike"),
    )
