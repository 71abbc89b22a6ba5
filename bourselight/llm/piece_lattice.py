"""Sentence-piece encoding by a lattice of pieces, and decoding.

Text is put behind one space, spaces become U+2581, and the text falls into units that no piece of the vocabulary crosses:
a run of spaces with the letters, or with the other characters, that follow. A unit's lattice has an edge for every substring
that is a piece. Its ends are folded from left to right (Viterbi): the best score at an end is the best of score at the start
plus the piece's score, ties going to the longest piece. A character without a piece is an edge of its own with a score below
all others and becomes byte pieces. The path is read back from the end.

This is the segmentation of greatest total score (the unigram rule) over the pieces and scores of the given model; the tests
hold it against the sentencepiece library reading the same model under that rule. decode(encode(text)) is the text for every
text without U+2581; a literal U+2581 is what the model writes for a space, and decodes to one.

Scale: texts stay in the tasks that read them and nothing is shuffled. The piece table (32,000 rows) goes to every worker; a
worker builds a unit's lattice once and holds the paths of `HELD` units and words at most, then starts anew, so memory does not
grow with the corpus. A unit of n characters takes n steps of at most a piece's length and about 100 bytes a character, which
bounds a single unbroken run of letters by a worker's memory, not the length of texts.

Defined results: null and empty texts have no pieces; repeated rows are encoded each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselight.llm.common import with_row

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
BLOCK_BYTES = 8 << 20
HELD = 400_000  # paths that a worker holds, of units and words together, before it starts anew
LONG = 64  # the paths of longer texts are not held
MARKS = ".,;:!?"
LATIN_END = "\u0250"  # below it, all Unicode versions agree on what a letter is
UNIT = regex.compile(rf"{SPACE}*\p{{L}}+|{SPACE}*[^\p{{L}}{SPACE}]+|{SPACE}+")


class Vocabulary(NamedTuple):
    pieces: tuple[tuple[str, int, float], ...]  # ordinary pieces: text, id, score
    first_byte: int  # id of <0x00>; the others follow
    longest: int
    unknown: float


def load(path: str) -> Vocabulary:
    """The piece table of a model file. Checks what the units rely on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of_bytes = [i for i in range(model.get_piece_size()) if model.is_byte(i)]
    pieces = tuple(
        (model.id_to_piece(i), i, model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    )
    if of_bytes != list(range(of_bytes[0], of_bytes[0] + 256)):
        raise ValueError("the model needs 256 byte pieces in a row")
    crossing = [p for p, _, _ in pieces if len(UNIT.findall(p)) > 1]
    if crossing:
        raise ValueError(f"pieces cross units: {crossing[:5]}")
    return Vocabulary(pieces, of_bytes[0], max(len(p) for p, _, _ in pieces), min(s for _, _, s in pieces) - UNKNOWN_PENALTY)


class Lattice:
    """Best paths through the lattices of units, for use inside tasks.

    An edge is a piece that stands at a place of the unit; places are folded from left to right. The pieces that begin at a
    start are found by a walk through a tree of their characters.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.unknown, self.first_byte = vocabulary.unknown, vocabulary.first_byte
        self.longest = vocabulary.longest
        # Node: the nodes behind it by character, and (score, id as bytes, length) of the piece that ends here.
        self.tree: list = [{}, None]
        for piece, i, score in vocabulary.pieces:
            node = self.tree
            for character in piece:
                node = node[0].setdefault(character, [{}, None])
            node[1] = (score, _as_bytes([i]), len(piece))
        self.units, self.words = _Paths(self._path), _Paths(self._word)

    def _path(self, unit: str) -> bytes:
        """Ids of the path of greatest score; of equal scores at an end, the longest piece."""
        tree, longest, n = self.tree, self.longest, len(unit)
        best, last = [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            before, node, end = best[start], tree, start
            for character in unit[start : start + longest]:
                node = node[0].get(character)
                if node is None:
                    break
                end += 1
                edge = node[1]
                if edge is not None:
                    score = before + edge[0]
                    # Starts come in ascending order, so an equal score leaves the longer piece.
                    if score > best[end]:
                        best[end], last[end] = score, edge
            score = before + self.unknown
            if score > best[start + 1] and not self._is_piece(unit[start]):
                # A character without a piece is an edge of its own.
                best[start + 1] = score
                last[start + 1] = (self.unknown, _as_bytes([self.first_byte + b for b in unit[start].encode()]), 1)
        out, at = [], n
        while at:
            _, ids, length = last[at]
            out.append(ids)
            at -= length
        out.reverse()
        return b"".join(out)

    def _is_piece(self, character: str) -> bool:
        node = self.tree[0].get(character)
        return node is not None and node[1] is not None

    def _word(self, word: str) -> bytes:
        if word.isalpha() and max(word) < LATIN_END:
            return self._path(SPACE + word)
        if word[-1] in MARKS and word[:-1].isalpha() and max(word) < LATIN_END:
            return self.words[word[:-1]] + self.units[word[-1]]
        return b"".join(map(self.units.__getitem__, UNIT.findall(SPACE + word)))

    def ids(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if len(self.units) + len(self.words) > HELD:
            self.units.clear()
            self.words.clear()
        words = text.split(" ")
        if "" in words or SPACE in text:
            return b"".join(map(self.units.__getitem__, UNIT.findall(SPACE + text.replace(" ", SPACE))))
        return b"".join(map(self.words.__getitem__, words))


class _Paths(dict):
    """Text -> its ids, made on the first look-up and held if the text is short, within a line and ends with no mark."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) <= LONG and "\n" not in text and (text[-1] not in MARKS or len(text) == 1):
            self[text] = ids
        return ids


def _as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def lattice(vocabulary: Vocabulary) -> Lattice:
    return Lattice(vocabulary)


def segment(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(uid, ids) for a table of units (uid, unit)."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = lattice(vocabulary).units
        for batch in batches:
            ids = [np.frombuffer(path[unit.as_py()], "<u4").astype(np.int32) for unit in batch["unit"]]
            yield pa.RecordBatch.from_arrays([batch["uid"], pa.array(ids, pa.list_(pa.int32()))], names=["uid", "ids"])

    kind = units.schema["uid"].dataType.simpleString()
    return units.select("uid", "unit").mapInArrow(paths, f"uid {kind}, ids array<int>")


def encode(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, doc, ids, text_crc32): ids as little-endian unsigned 32-bit bytes, and the CRC of the text in UTF-8."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = lattice(vocabulary).ids
        for batch in batches:
            begin, ids, sums, size = 0, [], [], 0
            for at, body in enumerate(batch["body"], 1):
                ids.append(ids_of(body.as_py()))
                sums.append(zlib.crc32(body.as_buffer()))
                size += len(body.as_buffer())
                # What goes on together is bounded by its texts, however long they are.
                if size >= block_bytes or at == len(batch):
                    part = batch.slice(begin, at - begin)
                    yield pa.RecordBatch.from_arrays(
                        [part["rid"], part["doc"], pa.array(ids, pa.binary()), pa.array(sums, pa.int64())], names=["rid", "doc", "ids", "text_crc32"]
                    )
                    begin, ids, sums, size = at, [], [], 0

    rows = with_row(docs, text, doc=F.col(f"`{doc_id}`").cast("long")).select("rid", "doc", "body")
    return rows.mapInArrow(coded, "rid long, doc long, ids binary, text_crc32 long")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds `text` to a table with `ids`."""
    pieces = {i: p.replace(SPACE, " ").encode() for p, i, _ in vocabulary.pieces}
    pieces |= {vocabulary.first_byte + b: bytes([b]) for b in range(256)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(map(pieces.__getitem__, np.frombuffer(ids.as_buffer(), "<u4").tolist()))[1:].decode() for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    schema = ", ".join(f"{n} {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(read, f"{schema}, text string")


