"""Exact deduplication by distributed most-significant-digit radix partitioning.

Texts that are equal after lower-casing A-Z form a group. Groups are found by splitting on successive digits of the
normalised bytes: a round takes the next digit of every text still in question, counts each (group, digit), and splits
the group by it. A group of one row is settled at once; a group whose texts have ended is a group of equal texts. Equality is
decided by the bytes alone; no digest takes part. Digits widen from round to round (64 bytes, then four times as many,
up to 256 KiB), so a text of n bytes meets about log(n) rounds, each over what the round before left.

Scale: the first round moves ids and 64 bytes of each text; the texts of rows whose first digit others share are then
fetched once and stored for the later rounds. Rounds count with partial aggregates, so a group of copies reaches the
shuffle as one row per task, and its number comes back by a join whose hot side Spark splits (adaptive skew join). Joins are
merge joins at every size, so plans do not change as tables grow. The driver sees one flag per round.

Defined results: null text counts as empty; all empty texts are equal; of equal texts the row with the largest doc_id stays
(a null id is the smallest; of rows that repeat an id, exactly one); an empty table gives an empty table; decisions are
joined to stored rows by number, so a document's own columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight.llm.common import Steps, numbered

FIRST_DIGIT, WIDEN, LAST_DIGIT = 64, 4, 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(body: Column) -> Column:
    return F.translate(body, UPPER, LOWER).cast("binary")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: DataFrame | None = None) -> DataFrame:
    """(rid, doc, keep_id, group_size, kept) for every row; `rid` is the row's number in `rows`, which are `docs` as `numbered`."""
    steps = Steps(docs.sparkSession, "radix")
    rows = numbered(docs, steps, text) if rows is None else rows
    rows = rows.select("rid", F.col("row")[doc_id].alias("doc"), normalised(F.col("body")).alias("bytes"))
    state = rows.withColumn("grp", F.lit(-1).cast("long"))
    settled, offset, width, turn = [], 0, FIRST_DIGIT, 0
    while True:
        # An ended text has no more bytes, and so differs from one that goes on with the same digit.
        digits = state.select(
            "rid", "doc", "grp", F.substring("bytes", offset + 1, width).alias("digit"),
            (F.octet_length("bytes") <= offset + width).alias("ended"),
        )
        shared = steps.save(
            digits.groupBy("grp", "digit", "ended")
            .agg(F.count("*").alias("n"), F.max(F.struct("doc", "rid")).alias("keep"))
            .where("n > 1")
            .withColumn("next", F.monotonically_increasing_id()),
            f"groups{turn}",
        )
        found = digits.join(shared.hint("merge"), ["grp", "digit", "ended"], "left").select(
            "rid", "doc", "n", "keep", F.col("next").alias("grp"), (F.col("n").isNull() | F.col("ended")).alias("done")
        )
        split = steps.save(found, f"split{turn}", by="done")
        settled.append(split.where("done").select("rid", "doc", "n", "keep"))
        left = split.where("not done").select("rid", "grp")
        if left.isEmpty():
            break
        state = steps.save(state.drop("grp").join(left.hint("merge"), "rid"), f"state{turn}")
        if turn:
            steps.drop(f"state{turn - 1}")
        offset, width, turn = offset + width, min(width * WIDEN, LAST_DIGIT), turn + 1
    return reduce(DataFrame.unionAll, settled).select(
        "rid",
        "doc",
        F.when(F.col("n").isNull(), F.col("doc")).otherwise(F.col("keep.doc")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("keep.rid") == F.col("rid"))).alias("kept"),
    )
