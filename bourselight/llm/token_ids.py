"""Token ids of many texts with a public tokenizer, for use inside tasks.

Byte-level vocabularies never merge across the start of a word, so a text is cut before each single space that stands
between two characters that are not white space, and each piece is encoded once per worker: later occurrences are a
dictionary look-up. The ids are those of the library for the whole text (the tests compare both).
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache


HELD_PIECES = 1_000_000  # pieces that a worker holds, of both kinds together, before it starts anew
LONG_PIECE = 64  # longer pieces are encoded but not held
LATIN_END = "\u0250"  # below it, all Unicode versions agree on what a letter is


def _byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_BYTE_CHARACTERS = _byte_characters()


class OtherSpace(Exception):
    """A piece borders on white space, so the text has to be cut with more care."""


class Pieces(dict):
    """Word -> ids of the word behind `prefix`, as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer, prefix: str):
        super().__init__()
        self.tokenizer, self.prefix, self.marks, self.bare = tokenizer, prefix, {}, self

    def encode(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()

    def encode_letters(self, letters: str) -> bytes:
        """Ids of the prefix and letters, which split no further: the library's model alone, on their byte characters."""
        text = "".join(map(_BYTE_CHARACTERS.__getitem__, (self.prefix + letters).encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def mark(self, mark: str) -> bytes:
        """Ids of a mark or line end that stands between two characters which are not white space."""
        if mark not in self.marks:
            self.marks[mark] = self.encode(mark)
        return self.marks[mark]

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise OtherSpace
        head, line_end, tail = word.partition("\n")
        if line_end and not head[-1].isspace() and not tail[0].isspace():
            # No piece crosses a single line end, and what follows it has no space in front.
            return self[head] + self.mark(line_end) + self.bare[tail]
        latin = max(word) < LATIN_END
        if latin and word.isalpha():
            ids = self.encode_letters(word)
        elif latin and word[-1] in ".,;:!?" and word[:-1].isalpha():
            ids = self[word[:-1]] + self.mark(word[-1])  # letters and marks are split before anything merges
        else:
            ids = self.encode(self.prefix + word)
        if len(word) <= LONG_PIECE:
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.first, self.later = Pieces(self.tokenizer, ""), Pieces(self.tokenizer, " ")
        self.later.bare = self.first

    def ids(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if len(self.first) + len(self.later) > HELD_PIECES:
            self.first.clear()
            self.later.clear()
        words = text.split(" ")
        try:
            return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))
        except OtherSpace:
            return b"".join(self.later[p[1:]] if p[0] == " " and p[1:] in self.later else self.first.encode(p) for p in _cut(words))


def _cut(words: list[str]) -> list[str]:
    """Pieces of a text with runs of white space: cut only before a space between two other characters."""
    out: list[list[str]] = [[words[0]]]
    for before, word in zip(words, words[1:], strict=False):
        if before and word and not before[-1].isspace() and not word[0].isspace():
            out.append([" ", word])
        else:
            out[-1] += [" ", word]
    return ["".join(p) for p in out if p != [""]]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)
