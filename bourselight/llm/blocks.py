"""Blocks of documents: bounded groups that one task handles together with the table entries they need.

Look-ups from millions of documents into a table that may not be broadcast go by block: each block lists its distinct
keys once, the keys are joined to the table, and block and entries meet in one task. Shuffles then carry distinct keys
per block, not one row per occurrence, and a frequent key is one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20


def with_block(rows: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """Adds `block`: the rows of an input partition spread by number over as many blocks as it takes for `size` bytes each.

    Blocks follow the input's partitions (the upper bits of `rid`), so a task lists the keys of its own blocks only. A block
    holds about `size` bytes; a single longer text fills one alone, as it is never split.
    """
    partition = F.shiftright("rid", 33)
    found = rows.agg(F.sum(F.octet_length("body")).alias("bytes"), F.max(partition).alias("last")).first()
    per = 1 + (found["bytes"] or 0) // (size * ((found["last"] or 0) + 1))
    return rows.withColumn("block", (partition * per + F.pmod(F.xxhash64("rid"), F.lit(per))).cast("int"))
