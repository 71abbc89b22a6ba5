"""Registered queries on filters, vectors and languages, with their SQL where SQL can express them."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from bourselight.llm.common import table
from bourselight.llm.filter_audit import FILTERS, audit
from bourselight.llm.languages import identify
from bourselight.llm.registry import query
from bourselight.llm.whitening import whiten

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
f AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
  100 * len(regexp_extract_all(w.t, '[A-Z]')) > 3 * length(w.t) AS c, regexp_matches(w.t, '[#$%&*|]') AS d,
  coalesce(doc_id > first_id, false) AS e FROM w JOIN firsts ON w.t = firsts.t),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
  FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed, count(*) AS n,
  sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT o.filter_order, s.step, ('ABCDE'.instr(substr(o.filter_order, s.step, 1)) - 1)::INT AS k,
  list_sum([1 << ('ABCDE'.instr(x) - 1) for x in string_split(substr(o.filter_order, 1, s.step - 1), '') if x <> ''])::INT AS pre
  FROM (VALUES {_ORDERS}) AS o(filter_order), (SELECT unnest(range(1, 6))::INT AS step) AS s),
g AS (SELECT part, filter_order, step, k,
  sum(CASE WHEN failed & (coalesce(pre, 0) | (1 << k)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN failed & coalesce(pre, 0) = 0 AND failed & (1 << k) <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN failed & coalesce(pre, 0) <> 0 AND failed & (1 << k) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN failed = 1 << k THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN failed & coalesce(pre, 0) = 0 AND failed & (1 << k) <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN failed & coalesce(pre, 0) = 0 AND failed & (1 << k) <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, o GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM g
"""


@query("op11_filter_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("row.doc_id", "held_out", "lang_pred", "score")
