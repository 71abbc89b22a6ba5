"""Screens as a stored order, so that any page costs what the first one does.

`offset` sorts and keeps all rows before a page. Here the matches of a screen are sorted once, numbered from 1 and stored in
that order; a page is a range of positions, for which Parquet's statistics leave out all other files and row groups. The total
is stored beside it. Key pages go on from the last row shown, for readers that page through a screen that is not stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselight import catalog
from bourselight.plans.screen import MAX_PAGE, display, ordered, page_bounds

POSITION = "position"
_ROWS_BITS = 33


class StoredOrder:
    """The matches of a screen in its order, at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(
        cls, found: DataFrame, path: str, columns: Sequence[str] | None = None, sort_by: str | None = None, descending: bool = True
    ) -> StoredOrder:
        """Sort and number the matches. Numbers come from the counts of the sorted parts, so no task sees all rows."""
        made = cls(found.sparkSession, path)
        rows = display(ordered(found, sort_by, descending), columns).withColumn("_id", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{made.path}/sorted")
        stored = made.spark.read.schema(rows.schema).parquet(f"{made.path}/sorted")
        part = F.shiftright("_id", _ROWS_BITS)
        counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        # One row for each part of the sort.
        placed = stored.withColumn("_part", part).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
        within = F.col("_id").bitwiseAND(F.lit((1 << _ROWS_BITS) - 1))
        numbered = placed.withColumn(POSITION, F.col("_before") + within + 1).drop("_part", "_before", "_id")
        numbered.write.mode("overwrite").parquet(f"{made.path}/rows")
        counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{made.path}/total")
        return made

    def page(self, page: int = 1, page_size: int = MAX_PAGE, row_cap: int | None = None) -> DataFrame:
        """The rows of a page with the true total and whether the cap cut it, as `screen.paged` gives them."""
        offset, size = page_bounds(page, page_size, row_cap)
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col(POSITION).between(offset + 1, offset + size))
        total = self.spark.read.parquet(f"{self.path}/total").select("total").scalar()
        capped = F.lit(False) if row_cap is None else F.col("total") > row_cap
        return rows.orderBy(POSITION).drop(POSITION).withColumn("total", total).withColumn("capped", capped)


def next_page(
    found: DataFrame, after: tuple | None, sort_by: str | None = None, descending: bool = True, page_size: int = MAX_PAGE
) -> DataFrame:
    """The rows that follow the row (value of the order column, symbol) `after`, or the first ones: no earlier row is kept.

    NULLs are last either way; among them, and among equal values, symbols rise.
    """
    entry = catalog.find(sort_by) if sort_by else None
    key = F.col(entry.key if entry else "market_cap")
    if after is not None:
        value, symbol = after
        later_symbol = F.col("symbol") > symbol
        if value is None:
            beyond = key.isNull() & later_symbol
        else:
            past = key < F.lit(value) if descending else key > F.lit(value)
            beyond = past | key.isNull() | ((key == F.lit(value)) & later_symbol)
        found = found.where(beyond)
    return ordered(found, sort_by, descending).limit(max(1, min(page_size, MAX_PAGE)))
