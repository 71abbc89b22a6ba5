"""Hierarchical packing of documents into windows of several lengths.

A document's tokens are routed to the smallest tier (2048, 1024, 512, 256) that holds them; what a long document has
beyond full 2048-token windows is cut off first and forms windows of its own. Tiers are packed from the longest down: a
window opens with the longest waiting piece, and the gap it leaves is filled with the largest pieces of shorter tiers that
fit; when none fits, the smallest longer one is cut to fill the gap exactly and its rest waits again. So every window of
every tier is full, and only the last few tokens of a partition meet padding. Windows of a tier then form step groups of
equal tokens; a window's cost is the sum of its squared piece lengths (attention), and groups are balanced by dealing
windows in order of cost back and forth.

The work is local to a partition: blocks of tokens are packed as they stream by, what is left over joins the next block,
and no shuffle is needed. Memory is bounded by the block; a task that runs again makes the same windows.

Defined results: null and empty texts are one end token; a text longer than any window spans several; repeated rows are
packed each for itself (`rid` tells them apart); an empty table gives an empty table; only the id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselight.llm.common import with_row
from bourselight.llm.token_ids import encoder

TIERS = (2048, 1024, 512, 256)
END = 1
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 15
COLUMNS = (
    "rid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class Piece(NamedTuple):
    doc: int
    start: int
    length: int


def tier_of(length: int, tiers=TIERS) -> int:
    return min((t for t in tiers if t >= length), default=tiers[0])


class Waiting:
    """Pieces by length, with the largest up to a bound and the smallest above one found through one bit set."""

    def __init__(self, limit: int):
        self.by_length: list[list[Piece]] = [[] for _ in range(limit + 1)]
        self.lengths, self.tokens = 0, 0

    def add(self, piece: Piece) -> None:
        self.by_length[piece.length].append(piece)
        self.lengths |= 1 << piece.length
        self.tokens += piece.length

    def _take(self, length: int) -> Piece:
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.lengths &= ~(1 << length)
        self.tokens -= length
        return piece

    def largest(self, most: int) -> Piece | None:
        low = self.lengths & ((1 << (most + 1)) - 1)
        return self._take(low.bit_length() - 1) if low else None

    def smallest_above(self, length: int) -> Piece | None:
        high = self.lengths >> (length + 1)
        return self._take(length + 1 + (high & -high).bit_length() - 1) if high else None


def pack_tiers(waiting: Waiting, tiers=TIERS, last: bool = False) -> Iterator[tuple[int, list[Piece]]]:
    """(tier, pieces) of windows, each exactly full. With `last` the rest follows, as one window that is not full."""
    for tier in tiers:
        lower = max((t for t in tiers if t < tier), default=0)  # pieces above this belong to the tier
        while waiting.tokens >= tier and waiting.lengths >> (lower + 1):
            window, gap = [], tier
            while gap:
                piece = waiting.largest(gap)
                if piece is None:
                    piece = waiting.smallest_above(gap)
                    waiting.add(Piece(piece.doc, piece.start + gap, piece.length - gap))
                    piece = Piece(piece.doc, piece.start, gap)
                window.append(piece)
                gap -= piece.length
            yield tier, window
    if last and waiting.tokens:
        window = []
        while piece := waiting.largest(tiers[0]):
            window.append(piece)
        yield tiers[0], window


def balanced(costs: list[int], size: int) -> list[int]:
    """Group number of each window: ceil(n / size) groups, filled back and forth in order of falling cost."""
    groups = -(-len(costs) // size)
    out = [0] * len(costs)
    for place, i in enumerate(sorted(range(len(costs)), key=lambda i: -costs[i])):
        turn, at = divmod(place, groups)
        out[i] = at if turn % 2 == 0 else groups - 1 - at
    return out


def _pack(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, waiting = encoder(path).ids, Waiting(TIERS[0])
    docs: dict[int, tuple] = {}  # of documents with waiting pieces: (row number, id, ids)
    number = window_no = step_no = 0
    high = TaskContext.get().partitionId() << 40
    windows: list[tuple[int, list[Piece]]] = []

    def flushed(last: bool) -> pa.RecordBatch:
        nonlocal window_no, step_no, windows
        windows += pack_tiers(waiting, TIERS, last)
        out: list[tuple] = []
        for tier in TIERS:
            own = [w for t, w in windows if t == tier]
            groups = balanced([sum(p.length**2 for p in w) for w in own], STEP_TOKENS // tier)
            for window, group in zip(own, groups, strict=True):
                offset = 0
                for p in window:
                    rid, doc, ids = docs[p.doc]
                    crc = zlib.crc32(memoryview(ids)[4 * p.start : 4 * (p.start + p.length)])
                    out.append((rid, doc, p.start, p.length, crc, len(ids) // 4, high + window_no, offset, tier, high + step_no + group))
                    offset += p.length
                window_no += 1
            step_no += max(groups, default=-1) + 1
        windows = []
        left = {p.doc for at in waiting.by_length for p in at}
        for k in [k for k in docs if k not in left]:
            del docs[k]
        kinds = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
        columns = zip(*out, strict=True) if out else [[]] * 10
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    seen = 0
    for batch in batches:
        for rid, doc, text in zip(batch["rid"].to_pylist(), batch["doc"].to_pylist(), batch["body"], strict=True):
            ids = encode(text.as_py()) + np.array([END], "<u4").tobytes()
            n = len(ids) // 4
            docs[number] = (rid, doc, ids)
            full = n - n % TIERS[0]
            windows += [(TIERS[0], [Piece(number, s, TIERS[0])]) for s in range(0, full, TIERS[0])]
            if n > full:
                waiting.add(Piece(number, full, n - full))
            number, seen = number + 1, seen + n
            if seen >= BLOCK_TOKENS:
                seen = 0
                yield flushed(False)
    yield flushed(True)


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: its document, the tokens it covers, their CRC, its sequence and place there, tier and step."""
    rows = with_row(docs, text, doc=F.col(f"`{doc_id}`").cast("long")).select("rid", "doc", "body")
    return rows.mapInArrow(lambda it: _pack(it, tokenizer), COLUMNS)
