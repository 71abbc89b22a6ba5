"""Connected components by label propagation with pointer jumping, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselight.llm.common import Steps


def components(edges: DataFrame, steps: Steps, name: str) -> DataFrame:
    """(node, label) for every node with an edge (a, b); label is the smallest node of its component.

    A round gives each node the smallest label among its neighbours and itself, then follows that label to its own
    label, so long chains shrink by half. Each round is stored; the driver sees one flag per round.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = steps.save(both.distinct(), f"{name}-edges")
    labels = steps.save(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")),
        f"{name}-0",
    )
    turn = 0
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
            .select(F.col("a").alias("node"), "m")
        )
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        turn += 1
        moved = steps.save(
            lower.join(jump, "low", "left").select("node", "was", F.coalesce(F.least("low", "far"), "low").alias("label")),
            f"{name}-{turn}",
        )
        steps.drop(f"{name}-{turn - 1}")
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels
