"""Cross-entropy difference of two n-gram models, as a score per document.

A target model (documents labelled good) and a background model (all documents) are matched: they share the vocabulary
(the 256 byte values and a start mark), the order (four bytes) and the smoothing, and differ in counts alone. The loss of a
byte is -log2 of its probability after the three before it; a document's score is the mean over its bytes of target loss
minus background loss, so lower means closer to the target.

Each order's distribution backs off to the next lower one with weight PRIOR / (PRIOR + count of the history), down to the
uniform distribution. Every position contributes one four-gram (histories are padded at the start of a text), so
counts of lower orders are sums over four-grams, and the relational model is a chain of group-bys and equi-joins.

Scale: tasks count four-grams with numpy and emit distinct ones; nothing is sampled, so the model grows with the corpus.
The model is a distributed table; only histories of at most one byte are broadcast (256 and 65,536 rows at most). Documents
meet the part of the model they need by blocks.

Defined results: null and empty texts have no tokens and score 0; a text's rows are scored each; labels of an id are
merged (good if any says so); labels without documents are ignored; without any target document both models back off to
the uniform distribution where counts are missing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight.llm.blocks import with_block
from bourselight.llm.common import Steps, with_row
from bourselight.llm.hashing import slices, text_bytes

ORDER, PRIOR = 4, 4.0


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte the four-gram that ends there, as an unsigned 32-bit number; zeros pad the start of a text."""
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    padded = np.zeros(len(data) + (ORDER - 1) * len(sizes), np.uint32)
    at = np.arange(len(data)) + (ORDER - 1) * (text + 1)
    padded[at] = data
    out = np.zeros(len(data), np.uint32)
    for back in range(ORDER - 1, -1, -1):
        out = out << np.uint32(8) | padded[at - back]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n, n_target): distinct four-grams of a slice of texts with their counts."""
    for batch in batches:
        good = np.asarray(batch["good"].to_numpy(zero_copy_only=False), bool)
        for a, b in slices(batch["body"], 16 << 20):
            data, offsets = text_bytes(batch["body"].slice(a, b - a))
            keys, back, n = np.unique(grams(data, offsets), return_inverse=True, return_counts=True)
            in_target = np.bincount(back, weights=np.repeat(good[a:b], np.diff(offsets)), minlength=len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(in_target.astype(np.int64))],
                names=["gram", "n", "n_target"],
            )


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = np.asarray(batch["block"])
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order], prepend=-1))
        for rows in np.split(order, cuts[1:]):
            if len(rows):
                keys = np.unique(grams(*text_bytes(batch["body"].take(pa.array(rows)))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), blocks[rows[0]], np.int32)), pa.array(keys.astype(np.int64))], names=["block", "gram"]
                )


def _score(key: tuple, docs: pa.Table, model: pa.Table) -> pa.Table:
    order = np.argsort(model["gram"].to_numpy())
    known = model["gram"].to_numpy()[order].astype(np.uint32)
    losses = [model[c].to_numpy()[order] for c in ("target", "background")]
    out = []
    for chunk in docs.to_batches():
        data, offsets = text_bytes(chunk["body"])
        keys = grams(data, offsets)
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        if len(keys) and not (len(known) and np.array_equal(known[at], keys)):
            raise ValueError("a block met the model entries of another block")
        n = np.diff(offsets)
        sums = [np.concatenate(([0.0], np.cumsum(x[at]))) if len(at) else np.zeros(1) for x in losses]
        means = [(s[offsets[1:]] - s[offsets[:-1]]) / np.maximum(n, 1) for s in sums]
        out.append(
            pa.RecordBatch.from_arrays(
                [chunk["rid"], chunk["doc"], pa.array(n.astype(np.int64)), *[pa.array(m) for m in means]],
                names=["rid", "doc", "n_tokens", "target_loss", "background_loss"],
            )
        )
    return pa.Table.from_batches(out) if out else pa.table({"rid": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "target_loss": pa.array([], pa.float64()), "background_loss": pa.array([], pa.float64())})


def model(counts: DataFrame) -> DataFrame:
    """(gram, target, background): losses in bits of the last byte of each four-gram under both models."""
    both = ("n", "n_target")
    named = lambda k: [F.sum(c).alias(f"{c}{k}") for c in both]
    key = lambda k: F.col("gram").bitwiseAND((1 << 8 * k) - 1)
    losses = counts
    for k in range(ORDER, 0, -1):
        # Counts of the last k bytes, and of the k - 1 before the last one.
        end, history = key(k).alias(f"end{k}"), F.shiftright(key(k), 8).alias(f"history{k}")
        ends = counts.groupBy(end).agg(*named(f"_end{k}"))
        histories = counts.groupBy(history).agg(*named(f"_history{k}"))
        small = (lambda d: F.broadcast(d)) if k <= 2 else (lambda d: d)  # at most 65,536 rows
        losses = losses.withColumns({f"end{k}": key(k), f"history{k}": F.shiftright(key(k), 8)})
        losses = losses.join(small(ends), f"end{k}").join(small(histories), f"history{k}")

    def loss(c: str) -> Column:
        p = F.lit(1 / 256)
        for k in range(1, ORDER + 1):
            p = (F.col(f"{c}_end{k}") + PRIOR * p) / (F.col(f"{c}_history{k}") + PRIOR)
        return -F.log2(p)

    return losses.select("gram", loss("n_target").alias("target"), loss("n").alias("background"))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc, n_tokens, target_loss, background_loss, score) for every row of `docs`.

    `labels` has doc_id and quality; documents with quality 1 are the target.
    """
    steps = Steps(docs.sparkSession, "lm")
    # Stored once: blocks follow row numbers, which have to be the same in every job.
    rows = steps.save(with_row(docs, text, doc=F.col(f"`{doc_id}`").cast("long")).select("rid", "doc", "body"), "rows")
    good = labels.where("quality = 1").select(F.col("doc_id").alias("doc")).distinct().withColumn("good", F.lit(True))
    marked = rows.join(good.hint("merge"), "doc", "left").select("body", F.coalesce("good", F.lit(False)).alias("good"))
    counts = steps.save(
        marked.mapInArrow(_count, "gram long, n long, n_target long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")),
        "counts",
    )
    losses = steps.save(model(counts), "model")
    blocked = with_block(rows)
    needed = blocked.select("block", "body").mapInArrow(_needed, "block int, gram long").distinct()
    entries = needed.join(losses.hint("merge"), "gram").select("block", "gram", "target", "background")
    scored = blocked.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(
        _score, "rid long, doc long, n_tokens long, target_loss double, background_loss double"
    )
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
