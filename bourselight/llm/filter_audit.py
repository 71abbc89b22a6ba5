"""Filter interaction audit by truth-table survival words.

A document fails some of five filters, A to E. Its survival word has 32 bits: bit S is set where the document survives the
subset S of filters, which is where S holds none of the filters it fails. The positional popcount of all words of a part is
therefore the number of documents that survive each subset, and every figure of an audit follows from these 32 counts: what
a chain of filters keeps after a step is the count of the subset applied so far, in whatever order.

Inside a task the words of a part and label are added by carry-save adders: three words of one weight become a sum word of
that weight and a carry word of twice the weight, 32 counters at a time. What is left, two words a weight at most, is counted
bit by bit. A task yields one row per part and label it has met, so shuffles carry 32 counts per task and part, and a part
that holds nearly all documents is no hot key.

Filter E asks for the least id of each text. Least ids are found per digest (combined before the shuffle), then joined back by
digest and id, a key that no two texts share, so a text with a million copies spreads over all tasks.

Null text counts as empty, null language as part ''. A row with a null id is compared with no other (never fails E, makes no
other fail it) and has no label. Rows with one id and one text are copies of each other with no smaller id: none fails E by
them. A document with several label rows is good or toxic where any row says so. An empty table has no part and no rows.
Columns of the input other than those named are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight.llm.common import SPACE, Steps, ship_package

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
_PARTIAL = "part string, good boolean, toxic boolean, alive array<long>"
# Parts and labels that a task keeps adders for at once; beyond it the counts so far are yielded and start anew.
HELD_GROUPS = 4096


def text_features(body: Column) -> dict[str, Column]:
    """What the filters on a single text look at."""
    words = F.array_remove(F.split(body, f"{SPACE}+"), "")
    return {
        "n_words": F.size(words),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_upper": F.regexp_count(body, F.lit("[A-Z]")),
        "n_points": F.length(body),
        "has_symbol": body.rlike("[#$%&*|]"),
    }


def failed_bits(n_words: Column, n_distinct: Column, n_upper: Column, n_points: Column, has_symbol: Column) -> Column:
    """Bits 0 to 3 for the filters A to D that a text fails."""
    tests = (
        n_words < 200,
        100 * n_distinct.cast("long") < 50 * n_words.cast("long"),
        100 * n_upper.cast("long") > 3 * n_points.cast("long"),
        has_symbol,
    )
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0)).cast("int")


def survival_words() -> np.ndarray:
    """The survival word of each set of failed filters."""
    subsets = np.arange(SUBSETS, dtype=np.uint64)
    alive = (subsets[:, None] & subsets[None, :]) == 0
    return (alive.astype(np.uint64) << subsets[None, :]).sum(axis=1, dtype=np.uint64).astype(np.uint32)


class PositionalCounter:
    """How many of the added words have each bit set: words wait by weight and are combined three at a time."""

    def __init__(self) -> None:
        self.waiting: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        carried, weight = words.astype(np.uint32), 0
        while len(carried):
            if weight == len(self.waiting):
                self.waiting.append(np.zeros(0, np.uint32))
            words, carries = np.concatenate((self.waiting[weight], carried)), []
            while len(words) >= 3:
                third = len(words) // 3
                a, b, c = (words[k * third : (k + 1) * third] for k in range(3))
                either = a ^ b
                carries.append((a & b) | (either & c))
                words = np.concatenate((either ^ c, words[3 * third :]))
            self.waiting[weight] = words
            carried = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
            weight += 1

    def counts(self) -> list[int]:
        bits = np.arange(32, dtype=np.uint32)
        totals = [0] * 32
        for weight, words in enumerate(self.waiting):
            for bit, n in enumerate(((words[:, None] >> bits) & 1).sum(axis=0)):
                totals[bit] += int(n) << weight
        return totals


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, held = survival_words(), {}

    def flush() -> pa.RecordBatch:
        rows = [(*key, adder.counts()) for key, adder in held.items()]
        held.clear()
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "good", "toxic", "alive"]
        )

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        names = parts.dictionary.to_pylist()
        label = batch.column("label").to_numpy().astype(np.int64)
        key = parts.indices.to_numpy().astype(np.int64) * 4 + label
        order = np.argsort(key, kind="stable")
        words = table[batch.column("failed").to_numpy()[order]]
        found, starts = np.unique(key[order], return_index=True)
        for k, run in zip(found.tolist(), np.split(words, starts[1:])):
            name = (names[k // 4], bool(k & 1), bool(k & 2))
            held.setdefault(name, PositionalCounter()).add(run)
            if len(held) >= HELD_GROUPS:
                yield flush()
    yield flush()


def failures(documents: DataFrame, labels: DataFrame, steps: Steps) -> DataFrame:
    """(part, failed, label) of every document: its bits of failed filters, and 1 if it is good plus 2 if it is toxic."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = documents.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        failed_bits(**text_features(body)).alias("failed"), F.unhex(F.sha2(body, 256)).alias("digest"),
    )
    narrow = steps.save(narrow, "narrow")
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    told = narrow.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copied = F.when(F.col("is_first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)
    label = F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))
    return told.select("part", (F.col("failed") + copied).cast("int").alias("failed"), label.cast("int").alias("label"))


def survivors(failed: DataFrame) -> DataFrame:
    """(part, alive, alive_good, alive_toxic): per part, how many documents survive each of the 32 subsets of filters."""
    ship_package(failed.sparkSession)
    partial = failed.mapInArrow(_count_words, _PARTIAL)
    each = partial.select("part", "good", "toxic", F.posexplode("alive").alias("subset", "n"))
    kinds = {"alive": F.lit(True), "alive_good": F.col("good"), "alive_toxic": F.col("toxic")}
    sums = each.groupBy("part", "subset").agg(*[F.sum(F.when(k, F.col("n")).otherwise(0)).alias(n) for n, k in kinds.items()])
    # One list of 32 entries a part.
    lists = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *kinds))).alias("counts"))
    return lists.select("part", *[F.col(f"counts.{n}").alias(n) for n in kinds])


def _shapley(letter: int) -> Column:
    """What one filter removes, summed over all orders: a subset comes first in as many orders as its factorials say."""
    n, others, terms = len(FILTERS), [k for k in range(len(FILTERS)) if k != letter], []
    for size in range(n):
        for before in combinations(others, size):
            s = sum(1 << k for k in before)
            removed = F.element_at("alive", s + 1) - F.element_at("alive", (s | 1 << letter) + 1)
            terms.append(removed * (factorial(size) * factorial(n - 1 - size)))
    return sum(terms[1:], terms[0])


def audit(documents: DataFrame, labels: DataFrame, steps: Steps | None = None) -> DataFrame:
    """One row per part, order of the five filters and step; see the module for the rules on odd rows."""
    steps = steps or Steps(documents.sparkSession, "filter-audit")
    counted = steps.save(survivors(failures(documents, labels, steps)), "survivors")
    steps.drop("narrow")
    each = counted.withColumn("shapleys", F.array(*[_shapley(k) for k in range(len(FILTERS))]))
    orders = " ".join("".join(p) for p in permutations(FILTERS))
    rows = each.withColumn("filter_order", F.explode(F.split(F.lit(orders), " "))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    )
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    prefix = F.substr("filter_order", F.lit(1), F.col("step") - 1)
    before = sum((F.when(F.instr(prefix, c) > 0, 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), F.col("number") + 1)

    def at(subset: Column | int, name: str = "alive") -> Column:
        return F.element_at(name, (F.lit(subset) if isinstance(subset, int) else subset).cast("int") + 1)

    rows = rows.withColumn("number", F.instr(F.lit(FILTERS), letter) - 1).withColumn("before", before.cast("int"))
    rows = rows.withColumn("bit", bit).withColumn("after", F.col("before").bitwiseOR(bit))
    gone = lambda name: at(F.col("before"), name) - at(F.col("after"), name)
    return rows.select(
        "part", "filter_order", "step", at(F.col("after")).alias("kept"), gone("alive").alias("removed"),
        (at(0) - at(F.col("bit")) - gone("alive")).alias("redundant"),
        (at(SUBSETS - 1 - F.col("bit")) - at(SUBSETS - 1)).alias("unique_fails"),
        gone("alive_good").alias("good_lost"), gone("alive_toxic").alias("toxic_lost"),
        F.element_at("shapleys", F.col("number") + 1).alias("shapley"),
    )
