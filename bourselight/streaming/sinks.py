"""How streams write: bounded runs over all input at hand, and tables of counts with one folder per micro-batch.

A batch overwrites its own folder, so a batch that runs again after a failure leaves the same content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bourselight.session import new_table_path

BATCH = "batch"


def run(stream: DataFrame, name: str, checkpoint: str, take: Callable[[DataFrame, int], object], mode: str = "append") -> None:
    """Run a stream over all input that is available, handing each micro-batch on."""

    def hand_on(batch: DataFrame, batch_id: int) -> None:
        take(batch, batch_id)

    query = (
        stream.writeStream.queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(hand_on)
        .start()
    )
    query.awaitTermination()


def write_changes(
    stream: DataFrame,
    name: str,
    mode: str = "update",
    each_batch: Callable[[DataFrame], DataFrame] | None = None,
    path: str | None = None,
) -> str:
    """Run a stream over all input that is available and return the folder of its changes.

    Pass the same `path` again to go on from where the last run ended: the checkpoint lies beside the changes.
    """
    path = path or new_table_path(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if each_batch is None else each_batch(batch)
        rows.write.mode("overwrite").parquet(f"{path}/changes/{BATCH}={batch_id}")

    run(stream, name, f"{path}/checkpoint", write, mode)
    return path


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {BATCH} bigint").parquet(f"{path}/changes")
