"""Small tables and brute-force versions that the tests of the operators share."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(folder: str = FOLDER) -> list[dict]:
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


def docs_of(spark, rows, extra: str = ""):
    """A documents table of (doc_id, text) pairs; `extra` names clashing text columns."""
    names = [n for n in extra.split() if n]
    schema = SCHEMA + "".join(f", `{n}` string" for n in names)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(names)) for i, t in rows], schema)


def stored(df, tmp_path):
    """As a stored table, which is what the operators read."""
    path = str(tmp_path / "docs.parquet")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def whole_text_ids(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def folded(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text: str | None) -> frozenset:
    w = words(folded(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_classes(rows) -> dict[int, frozenset]:
    """Connected components of pairs of similarity 0.8 or more, by all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    out = defaultdict(set)
    for i in ids:
        out[root(i)].add(i)
    return {i: frozenset(out[root(i)]) for i in ids}
