"""One registered query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselight.llm import queries_audit, queries_models, queries_records  # noqa: F401
from bourselight.llm.common import Steps, numbered, table
from bourselight.llm.dart_minhash import near_duplicates
from bourselight.llm.packing import pack
from bourselight.llm.quality_rules import RULES, STOP_WORDS, judge
from bourselight.llm.radix_dedup import exact_dedup, normalised
from bourselight.llm.registry import query
from bourselight.llm.sanitise import KINDS, joined, sanitise
from bourselight.llm.token_files import read_token_files, write_token_files

_STOP = "|".join(sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))


def _rules_sql() -> str:
    parts = []
    for r in RULES:
        value = f"(CASE WHEN {r.per} > 0 THEN {r.measure}::DOUBLE / {r.per} ELSE 0.0 END)" if r.per else r.measure
        parts += [f"{value} >= {float(r.low)!r}"] if r.low is not None else []
        parts += [f"{value} <= {float(r.high)!r}"] if r.high is not None else []
    return " AND ".join(parts)


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT k, doc_id, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
tri AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS c FROM tri) WHERE c > 1),
cover AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY k),
f AS (SELECT w.k, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
  len(ls)::BIGINT AS n_lines,
  len(list_filter(ws, lambda x: regexp_full_match(lower(x), '(?:{_STOP})[.,;:!?]?')))::BIGINT AS n_stop_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '\\pL')))::BIGINT AS n_letter_words,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-•*·]')))::BIGINT AS n_bullet_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN cover ON w.k = cover.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_rules_sql()}) AS kept
FROM f
"""


@query("op5_quality_rules", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words",
        "base_failed", "kept",
    )


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""


@query("op3_exact_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = numbered(docs, Steps(spark, "exact"))
    digests = rows.select("rid", F.sha2(normalised(F.col("body")), 256).alias("text_sha256"))
    return exact_dedup(docs, rows=rows).join(digests.hint("merge"), "rid").select(
        F.col("doc").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def tokenizer_path() -> str:
    """The public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_dart_minhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("doc").alias("doc_id"), "class_id", "class_size", "kept"
    )


@query("op2_hierarchical_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("rid")


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Steps(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), steps)
    return read_token_files(steps)


@query("op9_sanitise")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id",
        *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base_list")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
