"""Removal of long repeated byte strings by hashed seeds and blocks.

Every byte that lies in a string of `length` bytes which also starts elsewhere is removed. This is no Burrows-Wheeler
transform and extends no interval backwards: seeds picked by least hash are keys that Spark groups by, at three fixed
levels of agreement, and what occurs once is dropped at each. By estimate, a transform of the whole corpus would cost
several times its size on disk; it was not measured.

1. Agreement of 32 bytes. Of the seeds inside each string of `length` bytes the one with the least hash represents it, so
   equal strings have equal seeds at equal offsets. Consecutive strings with one seed form a run, about one per 85
   bytes. Seeds that occur once are dropped: their strings are unique.
2. Where all runs of a seed agree in all their bytes, all their strings repeat. The others bring their bytes (at most
   twice `length`) and are cut into blocks of 13 strings: a block needs agreement of the bytes that its strings share.
   Blocks of one place are dropped, blocks that agree altogether are repeated.
3. Agreement of `length` bytes: the strings of blocks still open, one by one.

Keys are two 64-bit hashes (seed and bytes). Work and memory follow the input: a hot string is one row per task after
partial aggregation, and comes back through joins whose hot side Spark splits. Steps are stored in the shared folder.

Defined results: null is empty; texts below `length` bytes are kept whole; overlaps count; repeated rows are documents of
their own, so each loses what the other has; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselight.llm.common import Steps, numbered
from bourselight.llm.hashing import _BYTE, U, _powers, mix, slices, text_bytes

LENGTH, SEED, BLOCK = 200, 32, 13
_POSITION = U((1 << 28) - 1)


def _ranges(data: np.ndarray):
    """A function of (first, last + 1) that hashes byte ranges, equal for equal bytes."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return lambda a, b: mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every window: running minima from both sides of blocks of the window's width."""
    n = len(values)
    padded = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(n - width + 1)
    return np.minimum(after[at], before[at + width - 1])


def runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text, seed hash, hash of all bytes, first string, last string, place of the seed) of every run."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)) + (np.zeros(0, np.int64),) * 3
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return none
    hashed = _ranges(data)
    at = np.arange(len(data) - SEED + 1)
    seeds = hashed(at, at + SEED)
    least = _least((seeds & ~_POSITION) | at.astype(np.uint64), length - SEED + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    whole = np.flatnonzero(np.arange(len(least)) + length <= offsets[1:][text])
    place = (least[whole] & _POSITION).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], (np.diff(whole) > 1) | (np.diff(place) != 0))))
    tails = np.append(heads[1:], len(whole)) - 1
    first, last, place = whole[heads], whole[tails], place[heads]
    extent = hashed(first, last + length) + (place - first).astype(np.uint64) * U(0x9FB21C651E98DF25)
    owner = text[first]
    return owner, mix(seeds[place]), mix(extent), first - offsets[owner], last - offsets[owner], place - offsets[owner]


def _find_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body = batch["body"]
        for a, b in slices(body):
            rid = np.asarray(batch["rid"])[a:b]
            owner, seed, extent, first, last, place = runs(*text_bytes(body.slice(a, b - a)), length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[owner]), pa.array(seed.view(np.int64)), pa.array(extent.view(np.int64))]
                + [pa.array(x.astype(np.int32)) for x in (first, last, place)],
                names=["rid", "seed", "extent", "first", "last", "place"],
            )


def _blocks(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """A row per block of strings of each run. Blocks are numbered by the strings' distance to the seed."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            data, offsets = text_bytes(part["bytes"])
            first, last, place = (np.asarray(part[c]).astype(np.int64) for c in ("first", "last", "place"))
            low, high = place - last, place - first  # distances of the run's strings to its seed
            count = high // size - low // size + 1
            row = np.repeat(np.arange(len(first)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (low // size)[row]
            near, far = np.maximum(number * size, low[row]), np.minimum(number * size + size - 1, high[row])
            origin = offsets[:-1][row] + (place - first)[row]  # the seed's place in the bytes
            hashed = _ranges(data)
            shared = hashed(origin - number * size, origin + length - np.minimum(number * size + size - 1, length - SEED))
            extent = mix(hashed(origin - far, origin + length - near) + ((far << 16) + near).astype(np.uint64))
            take = lambda c: np.asarray(part[c])[row]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(take("rid")), pa.array(take("seed")), pa.array(take("n")),
                    pa.array(mix(shared + number.astype(np.uint64)).view(np.int64)), pa.array(extent.view(np.int64)),
                    pa.array((place[row] - far).astype(np.int32)), pa.array((place[row] - near).astype(np.int32)),
                    part["place"].take(pa.array(row)),
                ],
                names=["rid", "seed", "n", "shared", "extent", "first", "last", "place"],
            )


def _with_bytes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that a document's row lists."""
    for batch in batches:
        for rid, body, wanted in zip(batch["rid"].to_pylist(), batch["body"], batch["wanted"].to_pylist(), strict=True):
            data = body.as_buffer()
            columns = [[w[c] for w in wanted] for c in ("seed", "n", "first", "last", "place")]
            pieces = [data[w["first"] : w["last"] + length].to_pybytes() for w in wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rid] * len(wanted), pa.int64())]
                + [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 3, strict=True)]
                + [pa.array(pieces, pa.binary())],
                names=["rid", "seed", "n", "first", "last", "place", "bytes"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, spans, removed = [], [], []
        for body, cuts in zip(batch["body"], batch["cuts"].to_pylist(), strict=True):
            data, out, at, n = body.as_buffer(), [], 0, 0
            end = -1
            for first, last in sorted((c["first"], c["last"]) for c in cuts or []):
                if first > end:
                    if end >= 0:
                        at = end
                    out.append(data[at:first])
                    n += 1
                end = max(end, last)
            out.append(data[max(end, 0) :] if n else data)
            kept.append(b"".join(out))
            spans.append(n)
            removed.append(len(data) - len(kept[-1]))
        yield pa.RecordBatch.from_arrays(
            [
                batch["rid"], batch["doc"], pa.array([len(x) for x in batch["body"].cast(pa.large_binary()).to_pylist()], pa.int64()),
                pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()),
            ],
            names=["rid", "doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def repeated_ranges(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, first, last): byte ranges [first, last) of documents that consist of repeated strings; they may overlap."""
    steps = Steps(rows.sparkSession, "repeats")
    found = steps.save(
        rows.select("rid", "body").mapInArrow(
            lambda it: _find_runs(it, length), "rid long, seed long, extent long, first int, last int, place int"
        ),
        "runs",
    )
    # Stored, so that the join below reads two shuffles and Spark can split a hot seed; so are the groups of `level`.
    seeds = steps.save(
        found.groupBy("seed").agg(F.count("*").alias("places"), F.min("extent").alias("low"), F.max("extent").alias("high"))
        .where("places > 1").select("seed", (F.col("low") == F.col("high")).alias("alike")),
        "seeds",
    )
    shared = steps.save(found.join(seeds.hint("merge"), "seed"), "shared", by="alike")
    steps.drop("runs")
    span = lambda df: df.select("rid", "first", (F.col("last") + length).alias("last"))
    unlike = shared.where("not alike")
    # Runs that agree altogether repeat as well; one of them stands for all where others are compared with them.
    texts = unlike.groupBy("seed", "extent").agg(
        F.count("*").alias("n"), F.min(F.struct("rid", "first", "last", "place")).alias("one")
    )
    texts = steps.save(texts.select("seed", "extent", "n", "one.*"), "texts")
    copied = unlike.join(texts.where("n > 1").select("seed", "extent"), ["seed", "extent"], "left_semi")
    wanted = texts.groupBy("rid").agg(F.collect_list(F.struct("seed", "n", "first", "last", "place")).alias("wanted"))
    columns = "rid long, seed long, n long, first int, last int, place int, "
    bodies = rows.select("rid", F.col("body").cast("binary").alias("body")).join(wanted.hint("merge"), "rid")
    held = steps.save(bodies.mapInArrow(lambda it: _with_bytes(it, length), columns + "bytes binary"), "held")

    def level(df: DataFrame, size: int, name: str) -> DataFrame:
        """Blocks of `size` strings of runs that agree with another run in the bytes that the block's strings share."""
        schema = "rid long, seed long, n long, shared long, extent long, first int, last int, place int"
        blocks = steps.save(df.mapInArrow(lambda it: _blocks(it, length, size), schema), f"{name}-blocks")
        groups = steps.save(
            blocks.groupBy("seed", "shared").agg(F.sum("n").alias("places"), F.min("extent").alias("low"), F.max("extent").alias("high"))
            .where("places > 1").select("seed", "shared", (F.col("low") == F.col("high")).alias("alike")),
            f"{name}-groups",
        )
        return steps.save(blocks.join(groups.hint("merge"), ["seed", "shared"]).drop("shared", "extent"), name)

    blocks = level(held, BLOCK, "level1")
    open_ = blocks.where("not alike").select("rid", "seed", "place", "first", "last").groupBy("rid", "seed", "place").agg(
        F.collect_list(F.struct("first", "last")).alias("parts")
    )
    part = held.select("rid", "seed", "n", "place", F.col("first").alias("origin"), "bytes").join(open_, ["rid", "seed", "place"]).select(
        "rid", "seed", "n", "place", "origin", "bytes", F.inline("parts")
    )
    narrowed = part.select(
        "rid", "seed", "n", "first", "last", "place",
        F.expr(f"substring(bytes, first - origin + 1, last - first + {length})").alias("bytes"),
    )
    strings = level(narrowed, 1, "level2")
    return (
        span(shared.where("alike")).unionAll(span(copied))
        .unionAll(span(blocks.where("alike and n = 1"))).unionAll(span(strings.where("n = 1")))
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of every document, in bytes."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    rows = numbered(docs, Steps(docs.sparkSession, "documents")).select("rid", "row.doc", "body")
    cuts = repeated_ranges(rows, length).groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))
    schema = "rid long, doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    joined = rows.withColumn("body", F.col("body").cast("binary")).join(cuts.hint("merge"), "rid", "left")
    return joined.mapInArrow(_cut, schema)
