"""Token files: frequency-ranked ids in byte-aligned codes of variable length, with the control bytes apart.

Ids are replaced by their rank in the corpus, most frequent first (ties by id), so frequent ids take one byte. A code
takes one to four bytes; two bits per id in a stream of its own give the length, four ids to a control byte. A file holds
blocks in ascending order of document id: the documents' ids and lengths, the control bytes and the data bytes. The rank
table is stored beside them; until it is known, blocks hold plain ids with counts of each. Decoding expands control bytes to lengths through a table of 256 x 4 entries and gathers the
bytes with numpy; nothing is decoded id by id.

Spark sorts documents by range of (id, row), so a hot id is split as well; each task writes its blocks through Spark's
writer, which commits whole files only. The one thing collected is the rank table, bounded by the vocabulary.

Defined results: null and empty texts have the end id alone; rows that repeat an id all stay, in order of their row;
a null id sorts first; an empty table gives no blocks; only the id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourselight.llm.common import Steps, with_row
from bourselight.llm.token_ids import encoder

END = 0
BLOCK_IDS = 1 << 20
RAW = "shard int, before long, docs array<long>, lengths array<long>, width int, ids binary, seen array<long>, times array<long>"
FILE = "shard int, before long, docs array<long>, lengths array<long>, control binary, data binary"
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_codes(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = values.astype("<u4", copy=False)
    size, widest = np.ones(len(values), np.uint8), int(values.max(initial=0)).bit_length()
    for bits in (8, 16, 24):
        if widest > bits:
            size += values >= 1 << bits
    control = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    control[: len(values)] = size - 1
    control = control.reshape(-1, 4)
    control = control[:, 0] | control[:, 1] << 2 | control[:, 2] << 4 | control[:, 3] << 6
    # No value has more bytes than the widest.
    width = max(1, -(-widest // 8))
    raw = values.view(np.uint8).reshape(-1, 4)[:, :width]
    return control.tobytes(), raw[np.arange(width, dtype=np.uint8) < size[:, None]].tobytes()


def decode_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of a block."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1])) if n else np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    out = raw[begin].astype(np.uint32)
    for k in (1, 2, 3):
        some = np.flatnonzero(size > k)
        out[some] |= raw[begin[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    fields = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _tokenise(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, shard, before = encoder(path).ids, TaskContext.get().partitionId(), 0
    docs, lengths, held, size = [], [], [], 0
    end = np.array([END], "<u4").tobytes()

    def block():
        ids = np.frombuffer(b"".join(held), "<u4")
        times = np.bincount(ids)
        seen = np.flatnonzero(times)
        # Ids of small vocabularies take two bytes until their ranks are known.
        width = 2 if len(times) <= 1 << 16 else 4
        return _batch([[shard], [before], [docs], [lengths], [width], [ids.astype(f"<u{width}").tobytes()], [seen], [times[seen]]], RAW)

    for batch in batches:
        for doc, text in zip(batch["doc"].to_pylist(), batch["body"], strict=True):
            ids = encode(text.as_py()) + end
            docs.append(doc)
            lengths.append(len(ids) // 4)
            held.append(ids)
            size += len(ids) // 4
            if size >= BLOCK_IDS:
                yield block()
                before, docs, lengths, held, size = before + size, [], [], [], 0
    if docs:
        yield block()


def _encode(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = [
            encode_codes(rank[np.frombuffer(ids.as_buffer(), f"<u{width}")])
            for width, ids in zip(batch["width"].to_pylist(), batch["ids"], strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch[c] for c in ("shard", "before", "docs", "lengths")]
            + [pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
            names=["shard", "before", "docs", "lengths", "control", "data"],
        )


def write_token_files(docs: DataFrame, tokenizer: str, steps: Steps, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Write the files (`tokens` and `ranks` in the folder of `steps`); returns the ids in order of rank."""
    rows = with_row(docs, text, doc=F.col(f"`{doc_id}`").cast("long")).select("doc", "rid", "body")
    ordered = rows.repartitionByRange("doc", "rid").sortWithinPartitions("doc", "rid").select("doc", "body")
    raw = steps.save(ordered.mapInArrow(lambda it: _tokenise(it, tokenizer), RAW), "raw")
    counts = raw.select(F.explode(F.arrays_zip("seen", "times")).alias("c")).groupBy("c.seen").agg(F.sum("c.times").alias("n"))
    by_rank = sorted((-r.n, r.seen) for r in counts.collect())  # at most one row per entry of the vocabulary
    ids = np.array([i for _, i in by_rank], np.int64)
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    steps.save(raw.drop("seen", "times").mapInArrow(lambda it: _encode(it, rank), FILE), "tokens")
    steps.save(docs.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "rank long, id long"), "ranks")
    steps.drop("raw")
    return ids


def _decode(batches: Iterator[pa.RecordBatch], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids = ids.astype("<u4")
    for batch in batches:
        for row in batch.to_pylist():
            values = ids[decode_codes(row["control"], row["data"], sum(row["lengths"]))]
            data, n = memoryview(values.tobytes()), np.array(row["lengths"], np.int64)
            ends = np.cumsum(n)
            crc = [zlib.crc32(data[4 * (e - m) : 4 * e]) for e, m in zip(ends, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["docs"], pa.int64()), pa.array(np.full(len(n), row["shard"]), pa.int32()),
                    pa.array(row["before"] + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "shard", "within", "n_tokens", "ids_crc32"],
            )


def read_token_files(steps: Steps) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = steps.spark.read.parquet(steps.path("tokens"))
    ranks = steps.spark.read.parquet(steps.path("ranks")).orderBy("rank").collect()
    ids = np.array([r.id for r in ranks], np.int64)
    # One row per shard: the ids before it.
    totals = files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = totals.select(
        "shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base")
    )
    docs = files.mapInArrow(lambda it: _decode(it, ids), "doc_id long, shard int, within long, n_tokens long, ids_crc32 long")
    return docs.join(before, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
