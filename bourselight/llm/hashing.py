"""Vectorised hashing of the words of many texts at once, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _SPACE = U(0x9E3779B97F4A7C15), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for positions below n."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, n + 1 offsets); null reads as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word in order. A-Z count as a-z; words end at spaces and at the end of a text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[data]] * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingles(words: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of `width` words; a text with fewer words has one shingle of all of them."""
    if not len(words):
        return words, text
    n = np.bincount(text)
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    place = np.arange(len(words)) - begin[text]
    heads = np.flatnonzero((place <= n[text] - width) | (place == 0))
    out = np.zeros(len(heads), np.uint64)
    for k in range(width):
        at = np.minimum(heads + k, len(words) - 1)
        same = (heads + k < len(words)) & (text[at] == text[heads])
        out = mix(out * U(3) + np.where(same, words[at], U(0)))
    return out, text[heads]


def slices(column: pa.Array, limit: int = 4 << 20):
    """Runs of rows (first, last) whose texts hold about `limit` bytes; a longer text is a run of its own."""
    sizes = np.nan_to_num(column.cast(pa.large_binary()).fill_null(b"").to_pandas().map(len).to_numpy(dtype=np.int64))
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield begin, len(sizes)
