"""Streams: landing files into tables, content dedupe, request rates, log counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bourselight.operators import merge
from bourselight.operators.buckets import Layout, Tables, Write
from bourselight.sources.landing import LANDING_SCHEMA, routed
from bourselight.streaming import sinks


def read_folder(spark: SparkSession, folder: str, schema: str | StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def read_landing_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


@dataclass(frozen=True)
class Target:
    """A table that landed payloads go to: its route, normaliser and key, whose first column lays out its buckets.

    `newest_first` orders the versions of a row, whatever batches they come in. Without it the later batch wins, and inside a
    batch the greatest figures.
    """

    route: str
    normalise: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    newest_first: tuple[str, ...] = ()
    year_of: str | None = None
    buckets: int = 8

    def layout(self) -> Layout:
        return Layout((self.keys[0],), self.buckets, self.year_of)

    def merged(self, batch: DataFrame) -> Write:
        rows = self.normalise(routed(batch, self.route))
        order = [F.col(c).desc_nulls_last() for c in self.newest_first or rows.columns]
        into = merge.keep_newest if self.newest_first else merge.upsert
        return Write(rows, lambda current, new: into(current, new, self.keys, order))


def tables_of(spark: SparkSession, path: str, targets: dict[str, Target]) -> Tables:
    return Tables(spark, path, {name: target.layout() for name, target in targets.items()})


def ingest(landing: DataFrame, tables: Tables, targets: dict[str, Target], name: str = "ingest") -> None:
    """One landing stream to all tables: each micro-batch is merged into the buckets it touches, of all tables in one commit.

    A batch that runs again after a failure finds itself taken. The checkpoint lies beside the tables: run it again to go on
    from where the last run ended. A stream that begins anew without its checkpoint needs another name.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        # Every target reads the batch; its files are read once. A lost block is read again from the landing.
        held = batch.persist()
        try:
            tables.commit((name, batch_id), **{table: target.merged(held) for table, target in targets.items()})
        finally:
            held.unpersist()

    sinks.run(landing, name, f"{tables.path}/checkpoint-{name}", take)


def archive(fetched: DataFrame, store: merge.Archive, name: str = "archive") -> None:
    """Fetched payloads into the content archive, which is the stream's only state: what it holds is not stored again."""
    sinks.run(fetched, name, f"{store.tables.path}/checkpoint-{name}", lambda batch, n: store.append(batch, (name, n)))


def window_counts(log: DataFrame, time: str, window: str, slide: str, keys: Sequence[str], counts: dict[str, Column]) -> DataFrame:
    """Counts per key and sliding window of the rows at hand. Counts combine before the shuffle."""
    spans = log.groupBy(F.window(time, window, slide).alias("w"), *keys).agg(*[c.alias(n) for n, c in counts.items()])
    return spans.select(*keys, F.col("w.start").alias("window_start"), *counts)


def request_rates(access_log: DataFrame, window: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Requests per client in sliding windows."""
    return window_counts(access_log, "ts", window, slide, ["client_key"], {"requests": F.count("*")})


def level_counts(logs: DataFrame, window: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Errors and warnings in rolling windows."""
    counts = {
        "errors": F.count_if(F.col("level").isin("ERROR", "CRITICAL")),
        "warnings": F.count_if(F.col("level") == "WARNING"),
    }
    return window_counts(logs, "created_at", window, slide, [], counts)


def summed(
    stream: DataFrame, name: str, schema: str, keys: Sequence[str], sums: Sequence[str], count: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Counts of a stream as sums of the counts of its micro-batches.

    Counts add up, so batches keep no state and need no watermark: a row counts however late it comes. A batch that
    runs again overwrites its own counts.
    """
    path = sinks.write_changes(stream, name, "append", count)
    changes = sinks.read_changes(stream.sparkSession, path, schema)
    return changes.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def contested_stretches(access_log: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Stretches of time where a client may go over its limit: (client_key, first_bucket, last_bucket, requests).

    Time is cut into buckets of one window. A window covers its own bucket and the one before, so only where these two
    hold more than `limit` requests can anything be refused; contested buckets that follow each other are one stretch.
    """
    bucket = F.floor(F.unix_micros("ts") / (window_seconds * 1_000_000)).cast("bigint")
    counts = access_log.groupBy("client_key", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    by_time = W.partitionBy("client_key").orderBy("bucket")
    follows = F.lag("bucket").over(by_time) == F.col("bucket") - 1
    pair = F.col("n") + F.when(follows, F.lag("n").over(by_time)).otherwise(0)
    contested = counts.withColumn("pair", pair).where(F.col("pair") > limit)
    starts = contested.withColumn("new", F.coalesce((F.lag("bucket").over(by_time) < F.col("bucket") - 1).cast("int"), F.lit(1)))
    stretches = starts.withColumn("stretch", F.sum("new").over(by_time))
    return stretches.groupBy("client_key", "stretch").agg(
        F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.sum("n").alias("requests")
    ).drop("stretch")
