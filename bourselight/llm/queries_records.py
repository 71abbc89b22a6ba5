"""Registered queries on repeated strings and web records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselight.llm.captures import captures
from bourselight.llm.common import table
from bourselight.llm.registry import query
from bourselight.llm.repeats import remove_repeats
from bourselight.llm.revisits import resolve


@query("op10_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


_TRACK = r"^(?:utm_[^=&]*|ref|gclid|fbclid)(?:=|$)"
OP8_SQL = f"""
WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^http', 'HTTP'), '#.*$', '') || '#again' AS spelt,
  '"' || substr(md5(html), 1, 12) || '"' AS tag, md5(html) AS digest, length(html) AS size FROM pages),
r AS (SELECT page_id * 4 + k AS record_id, CASE WHEN k = 2 THEN spelt ELSE url END AS raw, k,
  1600000000 + (page_id * 37 % 700) * 86400 + page_id % 86000 + CASE k WHEN 0 THEN 0 WHEN 1 THEN -40000 WHEN 2 THEN 90000 ELSE 200000 END AS ts,
  CASE WHEN k = 3 THEN '"other"' ELSE tag END AS tag, digest, size FROM p, (VALUES (0), (1), (2), (3)) AS x(k)),
b AS (SELECT *, regexp_replace(trim(raw), '#.*$', '') AS bare FROM r),
a AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
  regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1) AS authority FROM b),
u AS (SELECT *, scheme || '://' || regexp_extract(authority, '^(.*@)', 1)
  || regexp_replace(regexp_replace(lower(regexp_replace(authority, '^.*@', '')), '^www\\.', ''),
    CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '')
  || CASE WHEN regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) = '' THEN '/'
     ELSE regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) END AS base,
  list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACK}'))) AS q FROM a),
c AS (SELECT record_id, k, ts, tag, digest, size, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM u),
j AS (SELECT v.record_id, v.url, v.k, v.tag, f.record_id AS old, f.tag AS old_tag, f.digest, f.size,
  row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS n
  FROM c v LEFT JOIN c f ON f.k = 0 AND f.url = v.url AND (f.ts, f.record_id) < (v.ts, v.record_id) WHERE v.k > 0),
o AS (SELECT *, CASE WHEN old IS NULL THEN 'unresolved' WHEN old_tag = tag THEN 'matched' ELSE 'mismatch' END AS outcome FROM j WHERE n = 1)
SELECT record_id, url, CASE WHEN outcome = 'matched' THEN old END AS refers_to, outcome,
  CASE WHEN outcome = 'matched' THEN 200 END::INTEGER AS status, CASE WHEN outcome = 'matched' THEN digest END AS digest,
  CASE WHEN outcome = 'matched' THEN 'age: ' || k || chr(10) || 'content-length: ' || size || chr(10) || 'etag: W/' || tag END AS headers
FROM o
"""


@query("op8_not_modified", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.withColumn("headers", F.array_join(lines, "\n"))
