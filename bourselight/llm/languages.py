"""Language of a text by cross-parsing: the language whose labelled text explains it with the fewest phrases wins.

Cross-parsing cuts a text from left to right into phrases, each the longest string from there on that occurs anywhere in the
labelled text of a language. Phrases times log2 of that text's length, per symbol, estimate the cross-entropy of the text
against the language, so the estimates of languages with labelled texts of unlike lengths compare.

Labelled text is a bounded sample, the one thing that is: of each language the documents with the least text hash, at most
`documents` of them and `slice` symbols from the middle of each, and all languages together at most `budget` symbols. Copies
of a text have one hash and count once. Least hashes are found on narrow rows (language, hash), cut per task before the
shuffle; texts are fetched for the sample alone.

Each language's suffix automaton is built in a task of its own. Its edges are the only strings that can go on, so the longest
match is the walk until an edge is missing. Edges of all languages (three a symbol at most, bounded by `budget`) are sent to
the tasks, where one table of next states holds every language: a missing edge leads to where a walk from the start would be
after this symbol, marked as the end of a phrase.

Tasks read whole texts. A batch of texts is cut into segments of `SEGMENT` symbols, and all segments walk all automata at
once, one step a symbol, as arrays. A phrase also ends where a segment does, at most once in `SEGMENT` symbols; a text of any
length is thus a bounded number of steps. There is no shuffle: the largest text costs its own length.

Symbols are the bytes of the lower-case text, with every run of bytes that are no letters as one space; a byte that no labelled
text has ends a phrase. Prediction reads the text alone.

Null texts and texts without a letter (Unicode category L) are `und` with score 0. So is every text where no language has a
labelled text (an empty table has no rows). The score is 1 - fewest / second fewest, 1 where only one language is learned. Of
languages that need equally many phrases the first by name wins, with score 0. A null id is not held out but teaches nothing,
as its remainder is unknown. Repeated rows each get their row. Columns of the input other than those named are kept apart in
`row`, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselight.llm.common import ship_package
from bourselight.llm.hashing import slices, text_bytes

UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
DOCUMENTS, SLICE, BUDGET = 128, 512, 1 << 18
SEGMENT = 2048
SALTS = 64
_EDGES = "lang string, size int, states int, source binary, symbol binary, target binary"
END = np.int32(-(2**31))
SPACE_BYTE = 32

_KIND = np.arange(256, dtype=np.uint8)
_KIND[[b for b in range(128) if not chr(b).isalpha()]] = SPACE_BYTE


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in learning; never null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of texts: letters' bytes, and one space for every run of others."""
    kinds = _KIND[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    keep = (kinds != SPACE_BYTE) | first[:-1]
    keep[1:] |= kinds[:-1] != SPACE_BYTE
    held = np.concatenate(([0], np.cumsum(keep)))
    return kinds[keep], held[offsets]


def suffix_automaton(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Edges (source, symbol, target) and the number of states of the automaton of all strings within a text; 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in follow[at]:
            follow[at][symbol] = new
            at = link[at]
        if at >= 0:
            there = follow[at][symbol]
            if length[at] + 1 == length[there]:
                link[new] = there
            else:
                # The strings of `there` up to this length now also end here: they become a state of their own.
                copy = len(follow)
                follow.append(dict(follow[there]))
                length.append(length[at] + 1)
                link.append(link[there])
                while at >= 0 and follow[at].get(symbol) == there:
                    follow[at][symbol] = copy
                    at = link[at]
                link[there] = link[new] = copy
        last = new
    counts = np.array([len(f) for f in follow])
    source = np.repeat(np.arange(len(follow), dtype=np.int32), counts)
    symbol = np.array([s for f in follow for s in f], np.uint8)
    target = np.array([t for f in follow for t in f.values()], np.int32)
    return source, symbol, target, len(follow)


def sample(labelled: DataFrame, documents: int = DOCUMENTS, piece: int = SLICE, budget: int = BUDGET) -> DataFrame:
    """(lang, sample) of (lang, text) rows: a bounded text of each language from the documents with the least text hash."""
    lettered = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = lettered.withColumn("h", F.xxhash64("text"))
    known = hashed.groupBy("lang", "h").agg(F.lit(1).alias("one")).select("lang", "h")
    # Cut per language and salt first, so that the task of a language gets a bounded number of rows from any input.
    salt, place = F.pmod("h", F.lit(SALTS)), F.row_number()
    few = known.withColumn("salt", salt).withColumn("p", place.over(W.partitionBy("lang", "salt").orderBy("h"))).where(F.col("p") <= documents)
    chosen = few.select("lang", "h", place.over(W.partitionBy("lang").orderBy("h")).alias("place")).where(F.col("place") <= documents)
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - piece) / 2).cast("int"))
    cut = F.lower(F.substr("text", middle, F.lit(piece)))
    # At most `documents` narrow keys a language, of languages whose automata are sent to all tasks anyway.
    pieces = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "place").agg(F.min(cut).alias("cut"))
    joined = pieces.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "cut"))), lambda p: p["cut"]), " ").alias("sample"))
    each = joined.withColumn("share", F.floor(F.lit(budget) / F.count("*").over(W.partitionBy(F.lit(0)))).cast("int"))
    return each.select("lang", F.substr("sample", F.lit(1), "share").alias("sample"))


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("sample").to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            text, _ = symbols(data, np.array([0, len(data)]))
            source, symbol, target, states = suffix_automaton(text.tobytes())
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "lang": lang, "size": len(text), "states": states, "source": source.tobytes(),
                        "symbol": symbol.tobytes(), "target": target.tobytes(),
                    }
                ],
                schema=pa.schema([
                    ("lang", pa.string()), ("size", pa.int32()), ("states", pa.int32()), ("source", pa.binary()),
                    ("symbol", pa.binary()), ("target", pa.binary()),
                ]),
            )


class Parser:
    """The automata of all languages as one table, and the count of phrases of texts."""

    def __init__(self, languages: list[tuple]):
        languages = sorted(languages)
        self.names = [row[0] for row in languages]
        self.bits = np.array([np.log2(max(2, row[1])) for row in languages])
        edges = [tuple(np.frombuffer(b, k) for b, k in zip(row[3:], (np.int32, np.uint8, np.int32))) for row in languages]
        known = np.unique(np.concatenate([e[1] for e in edges]))
        self.width = len(known) + 1
        # Symbol 0 stands for all bytes that no labelled text has.
        self.number = np.zeros(256, np.int32)
        self.number[known] = np.arange(1, self.width)
        first, tables = 0, []
        self.starts = np.zeros(len(languages), np.int32)
        for k, ((source, symbol, target), row) in enumerate(zip(edges, languages)):
            start = first * self.width
            # A symbol that the labelled text lacks is a phrase of its own: it leads to a last state without any edge.
            again = np.full(self.width, start + row[2] * self.width, np.int32)
            root = source == 0
            again[self.number[symbol[root]]] = (first + target[root]) * self.width
            # Without an edge the phrase ends, and the walk goes on as from the start.
            table = np.broadcast_to(again | END, (row[2] + 1, self.width)).copy()
            table[0] = again
            table[source, self.number[symbol]] = (first + target) * self.width
            self.starts[k], first = start, first + row[2] + 1
            tables.append(table.ravel())
        self.table = np.concatenate(tables)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) in each language (column)."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[:-1][owner] + within * SEGMENT
        length = np.minimum(offsets[1:][owner] - begin, SEGMENT)
        # Longest first, so that segments still going on are always the leading ones.
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        going = np.searchsorted(-length, -np.arange(SEGMENT), side="left")
        lanes, languages = len(order), len(self.names)
        state = np.repeat(self.starts[:, None], lanes, axis=1)
        ended = np.ones((languages, lanes), np.int32)
        numbers = self.number[data]
        for step in range(int(length[0]) if lanes else 0):
            n = going[step]
            found = self.table.take(state[:, :n] + numbers[begin[:n] + step])
            ended[:, :n] -= found >> 31
            state[:, :n] = found & np.int32(0x7FFFFFFF)
        out = np.zeros((len(sizes), languages))
        for k in range(languages):
            out[:, k] = np.bincount(owner, weights=ended[k], minlength=len(sizes))
        return out

    def best(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and score of each text of a batch."""
        data, offsets = symbols(*text_bytes(column))
        cost = self.phrases(data, offsets) * self.bits
        winner, rows = cost.argmin(axis=1), np.arange(len(cost))
        fewest = cost[rows, winner]
        cost[rows, winner] = np.inf
        second = cost.min(axis=1)
        return [self.names[w] for w in winner], 1 - np.divide(fewest, second, out=np.zeros(len(cost)), where=second > 0)


_HELD: list = [None, None]


def _parser(languages: list[tuple]) -> Parser:
    """The table of the languages, made once a worker process."""
    if _HELD[0] is not languages:
        _HELD[:] = [languages, Parser(languages)]
    return _HELD[1]


def predict(docs: DataFrame, languages: list[tuple], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(row, lang_pred, score) of every document, by its text alone; `row` holds the columns to keep."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    text = F.col("text").cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(row, F.when(lettered, F.lower(text)).alias("lower"))
    if not languages:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(languages)  # at most three edges for each symbol of the budget

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("lower")):
                part = batch.slice(first, last - first)
                known = part.column("lower").is_valid().to_numpy(zero_copy_only=False)
                names, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if known.any():
                    names[known], score[known] = _parser(sent.value).best(part.column("lower").filter(pa.array(known)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(names, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"]
                )

    return rows.mapInArrow(parse, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(row, held_out, lang_pred, score) of every document; languages are learned from the rows that are not held out."""
    ship_package(docs.sparkSession)
    teaches = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    labelled = docs.where(teaches).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    languages = [tuple(r) for r in sample(labelled).repartition("lang").mapInArrow(_build, _EDGES).collect()]
    kept = keep if "doc_id" in keep else ("doc_id", *keep)
    return predict(docs, languages, kept).select("row", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
