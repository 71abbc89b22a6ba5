"""Archive records that the page table implies: each page fetched once, and asked for again later on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def captures(pages: DataFrame) -> DataFrame:
    """Four records per page: the fetch, a revisit before it, one after it under another spelling, and one of a changed page."""
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    day = F.pmod(F.col("page_id") * 37, F.lit(700))
    spelt = F.concat(F.regexp_replace(F.regexp_replace("url", "^http", "HTTP"), "#.*$", ""), F.lit("#again"))
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(shift).alias("shift"))
            for k, (kind, shift) in enumerate([("response", 0), ("revisit", -40_000), ("revisit", 90_000), ("revisit", 200_000)])
        ]
    )
    rows = pages.select("page_id", "url", spelt.alias("spelt"), tag.alias("tag"), F.md5("html").alias("digest"), F.length("html").alias("size"), day.alias("day"), F.explode(kinds).alias("c")).select("*", "c.*")
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("day") * 86_400 + F.pmod("page_id", F.lit(86_000)) + F.col("shift"))
    first = F.col("k") == 0
    return rows.select(
        (F.col("page_id") * 4 + F.col("k")).cast("long").alias("record_id"),
        F.when(F.col("k") == 2, F.col("spelt")).otherwise(F.col("url")).alias("url"),
        at.alias("fetched"), "kind", F.when(first, 200).otherwise(304).alias("status"),
        F.when(first, F.col("digest")).alias("digest"),
        F.when(first, F.create_map(F.lit("ETag"), F.col("tag"), F.lit("Content-Length"), F.col("size").cast("string"), F.lit("Age"), F.lit("0")))
        .when(F.col("k") == 3, F.create_map(F.lit("etag"), F.lit('"other"')))
        .otherwise(F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), F.col("tag")), F.lit("content-length"), F.lit("0"), F.lit("age"), F.col("k").cast("string"))).alias("headers"),
    )
