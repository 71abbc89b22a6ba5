"""Joins, rankings and medians that hold when one key owns a large share of the rows.

All helpers are deterministic: salts are hashes of row content, never random, so a task that is run again
after a lost executor produces the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16

# Above this rank Spark no longer cuts groups before the shuffle, so the cut is made in two steps.
PRE_SHUFFLE_RANK = 1000

# Ranks of a quantile sketch are off by one in so many at most; brackets are cut into so many ranges.
SKETCH = 10_000
RANGES = 4096


def _salt(spread: Sequence[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int")


def lookup(
    fact: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join a fact to a smaller frame that is unique on `on`, where one key may hold much of the fact.

    Rows of a hot key are split over `salts` tasks by the content of the `spread` columns; the smaller frame is
    repeated once per salt. Where Spark knows or measures the smaller side to be small it broadcasts it instead.
    """
    salted = fact.withColumn("_salt", _salt(spread, salts))
    repeated = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[str] = (),
    rank_name: str = "position",
) -> DataFrame:
    """The first n rows of each group in the given total order, numbered from 1.

    Spark cuts each group to n rows before the shuffle for ranks up to 1000. For a larger n the rows are first
    cut per salt, so no task sorts more than its share of a hot group. Rows are spread by all their columns unless
    `spread` names some. The result is the same for every n.
    """
    if n > PRE_SHUFFLE_RANK:
        # Maps have no hash; any other columns do, and equal rows may as well share a salt.
        spread = spread or [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
        per_salt = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", _salt(spread, SALTS))
            .withColumn("_rank", F.row_number().over(per_salt))
            .where(F.col("_rank") <= n)
            .drop("_salt", "_rank")
        )
    within = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(within)).where(F.col(rank_name) <= n)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Column,
    order: Sequence[Column],
    position_name: str = "position",
) -> DataFrame:
    """Number all rows of every group from 1, without sorting a whole group in one task.

    `coarse` has to rise with `order` (the date of rows ordered by date). Counts per coarse value give each slice
    its offset, and only the slices are sorted.
    """
    sliced = df.withColumn("_slice", coarse)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumn(position_name, (F.col("_offset") + F.row_number().over(within)).cast("bigint"))
        .drop("_slice", "_offset")
    )


def _value(of: Column) -> Column:
    """A figure that counts for a median: NULL and NaN do not."""
    number = of.cast("double")
    return F.when(~F.isnan(number), number)


def _brackets(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """(keys, _bounds): per measure how many values a group has, and two values that surely enclose its middle.

    Quantile sketches of a bounded size combine before the shuffle. A rank is off by one in `SKETCH` at most, so the
    bracket lies four times that to either side of the middle.
    """
    around = [0.5 - 4 / SKETCH, 0.5 + 4 / SKETCH]
    bounds = [
        F.struct(
            F.lit(name).alias("name"), F.count(_value(c)).alias("n"),
            F.percentile_approx(_value(c), around, SKETCH).alias("ends"),
        )
        for name, c in measures.items()
    ]
    return df.groupBy(*keys).agg(F.array(*bounds).alias("_bounds"))


def _in_brackets(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], brackets: DataFrame) -> DataFrame:
    """(keys, _name, _n, _from, _to, _v, _w): counted values inside the bracket, and one row without a value for all below.

    Values above count nowhere. A group keeps about eight in `SKETCH` of its values.
    """
    rows = df.select(*keys, *[_value(c).alias(f"_m{i}") for i, c in enumerate(measures.values())])
    if keys:
        rows = lookup(rows, brackets, keys, [f"_m{i}" for i in range(len(measures))])
    else:
        rows = rows.withColumn("_bounds", brackets.scalar())
    entries = [
        F.struct(F.col("_bounds")[i].alias("b"), F.col(f"_m{i}").alias("v")) for i in range(len(measures))
    ]
    long = rows.select(*keys, F.inline(F.array(*entries)))
    low, high = F.col("b.ends")[0], F.col("b.ends")[1]
    held = long.where(F.col("v") <= high)
    return held.groupBy(*keys, F.col("b.name").alias("_name"), F.when(F.col("v") >= low, F.col("v")).alias("_v")).agg(
        F.count("*").alias("_w"), F.min("b.n").alias("_n"), F.min(low).alias("_from"), F.min(high).alias("_to")
    )


def _middle_ranges(counted: DataFrame, group: list[str]) -> DataFrame:
    """Rows of the ranges of values that hold the middle of their group; `_before` counts what lies below the range.

    A bracket is cut into equal ranges, so a group with very many values near its middle is sorted range by range.
    """
    # The width of finite values may overflow; halves of it do not.
    width = F.col("_to") / 2 - F.col("_from") / 2
    place = F.when(width > 0, F.floor((F.col("_v") / 2 - F.col("_from") / 2) / width * RANGES)).otherwise(0)
    placed = counted.withColumn("_r", F.when(F.col("_v").isNull(), -1).otherwise(F.coalesce(place, F.lit(0))).cast("int"))
    ranges = placed.groupBy(*group, "_r").agg(F.sum("_w").alias("_in"), F.min("_n").alias("_all"))
    upto = F.sum("_in").over(W.partitionBy(*group).orderBy("_r").rowsBetween(W.unboundedPreceding, 0))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    held = ranges.withColumn("_upto", upto).where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_in") < high))
    bounds = held.select(*group, "_r", low.alias("_low"), high.alias("_high"), (F.col("_upto") - F.col("_in")).alias("_before"))
    return placed.join(bounds, [*group, "_r"])


def exact_medians(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], counts: bool = False) -> DataFrame:
    """Exact medians of several measures per group, one column per measure: the midpoint on an even count.

    The input is read twice: for sketches that bracket the middle, then to count what lies below the bracket and each
    value inside. No task holds or sorts a whole group. NULL and NaN do not count; every group of the input appears, and
    without keys there is one row. With `counts` each measure has a count of its values, too.
    """
    keys = list(keys)
    brackets = _brackets(df, keys, measures)
    ranges = _middle_ranges(_in_brackets(df, keys, measures, brackets), [*keys, "_name"])
    inside = W.partitionBy(*keys, "_name", "_r").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    rank = F.col("_before") + F.sum("_w").over(inside)
    middle = ranges.withColumn("_rank", rank).where(
        (F.col("_rank") >= F.col("_low")) & (F.col("_rank") - F.col("_w") < F.col("_high"))
    )
    found = middle.groupBy(*keys).agg(
        *[
            ((F.min(F.when(F.col("_name") == n, F.col("_v"))) + F.max(F.when(F.col("_name") == n, F.col("_v")))) / 2).alias(f"_of{i}")
            for i, n in enumerate(measures)
        ]
    )
    both = brackets.join(found, keys, "left") if keys else brackets.select(
        "*", F.inline(F.array(found.select(F.struct(*found.columns)).scalar()))
    )
    out = []
    for i, name in enumerate(measures):
        n = F.col("_bounds")[i]["n"]
        missed = F.raise_error(F.lit(f"no middle of {name} inside its bracket")).cast("double")
        out.append(F.when(n > 0, F.coalesce(f"_of{i}", missed)).alias(f"median_{name}"))
        out += [n.alias(f"count_{name}")] if counts else []
    return both.select(*keys, *out)


def exact_median(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The exact median per group as (keys, median, count). Groups without a value do not appear."""
    found = exact_medians(df, keys, {"value": F.col(value)}, counts=True)
    renamed = found.withColumnsRenamed({"median_value": "median", "count_value": "count"})
    return renamed.where(F.col("count") > 0)
