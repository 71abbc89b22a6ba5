"""Near-duplicate classes by DartMinHash signatures, banded joining and exact checks.

A document is a weighted set of shingles (five words, A-Z lower-cased). For every element a Poisson process, seeded by
the element alone, throws darts at the plane of (weight, rank). The weight axis is cut into dyadic levels [0, 1), [1, 2),
[2, 4), ...; a dart counts if its weight lies below the element's. Every dart belongs to one of k coordinates, and the
earliest dart per coordinate is the signature, so two documents agree on a coordinate with the probability of their
weighted Jaccard similarity. Only darts up to rank t / weight are thrown, t = k ln k + 2k in all whatever the length of the text;
where a coordinate stays empty the bound is doubled, so signatures are exact.

Candidates come from bands of four coordinates. A pair of similarity 0.8 misses all 24 bands with probability 3e-6.
Documents with the same set of shingles are one node. In each bucket every node is tested against one pivot; all tests
are exact intersections. Where nodes of a bucket still lie in different classes afterwards, the nodes outside the bucket's
largest class are tested against all nodes of other classes there, so no link inside a bucket is lost, though no
group is ever expanded into all its pairs. Classes are connected components of the links.

In the registered query every shingle weighs 1, so similarity is the Jaccard similarity of the sets; `weighted=True`
weighs a shingle by its count.

Defined results: null and blank texts have no shingles and stay alone; a text of one to four words is one shingle; of
a class the row with the largest doc_id stays (of rows repeating that id, one); an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight.llm.common import Steps, numbered
from bourselight.llm.components import components
from bourselight.llm.hashing import U, mix, shingles, slices, text_bytes, word_hashes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
K = BANDS * ROWS
THOSE, THESE = 512, 256  # nodes in a block of a class, and of nodes compared with it


def weighted_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, element, count) of the distinct shingles of each text, ordered by text and element."""
    h, text = shingles(*word_hashes(data, offsets), WIDTH)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _darts(text, element, weight, bound):
    """All darts below the rank bound of their text: (text, rank, identity)."""
    out, level = [], 0
    while True:
        low, span = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        some = np.flatnonzero(weight > low)
        if not len(some):
            break
        t, e, w, r, turn = text[some], element[some], weight[some], np.zeros(len(some)), 0
        while len(t):
            seed = mix(e + U(((level << 32) + 2 * turn + 1) * 0xD6E8FEB86659FD93 % 2**64))
            r = r - np.log(_uniform(seed)) / span
            hit = np.flatnonzero(r < bound[t])
            t, e, w, r, seed = t[hit], e[hit], w[hit], r[hit], seed[hit]
            counts = low + span * _uniform(mix(seed ^ U(0xA5A5A5A5A5A5A5A5))) < w
            out.append((t[counts], r[counts], mix(seed + U(0x5851F42D4C957F2D))[counts]))
            turn += 1
        level += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """n x k identities of the earliest darts; rows of texts without elements stay 0."""
    sig = np.zeros((n, k), np.uint64)
    mass = np.bincount(text, weights=weight, minlength=n)
    bound = (k * math.log(k) + 2 * k) / np.maximum(mass, 1e-300)
    open_ = mass > 0
    while open_.any():
        part = open_[text]
        t, r, d = _darts(text[part], element[part], weight[part].astype(float), bound)
        cell = t * k + (d % U(k)).astype(np.int64)
        last = np.argsort(-r, kind="stable")  # of repeated cells numpy keeps the last value assigned: the earliest dart
        found = np.zeros(n * k, np.uint64)
        found[cell[last]] = d[last]
        found = found.reshape(n, k)
        full = open_ & (found != 0).all(axis=1)
        sig[full] = found[full]
        open_ &= ~full
        bound = np.where(open_, bound * 2, bound)
    return sig


def _sketch(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body = batch.column("body")
        for a, b in slices(body):
            data, offsets = text_bytes(body.slice(a, b - a))
            text, element, count = weighted_sets(data, offsets)
            n = b - a
            weight = count if weighted else np.ones(len(count))
            sig = signatures(text, element, weight, n)
            keys = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                keys = mix(keys * U(3) + sig[:, r::ROWS])
            ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n))))
            sums = []  # the set as two sums over its elements: 128 bits that no order changes
            for salt in (0x1234567, 0x89ABCDEF1):
                run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(element + U(salt)) * weight.astype(np.uint64))))
                sums.append(run[ends[1:]] - run[ends[:-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").slice(a, n),
                    batch.column("doc").slice(a, n).cast(pa.int64()),
                    pa.array(np.bincount(text, minlength=n), pa.int64()),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                ],
                names=["rid", "doc", "n", "set1", "set2", "bands"],
            )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body = batch.column("body")
        for a, b in slices(body):
            text, element, count = weighted_sets(*text_bytes(body.slice(a, b - a)))
            ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=b - a)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").slice(a, b - a),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(element.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(count.astype(np.int32))),
                ],
                names=["node", "el", "w"],
            )


def _similarity(weighted: bool) -> Column:
    if not weighted:
        both = F.size(F.array_intersect("a_el", "b_el"))
        return both / (F.size("a_el") + F.size("b_el") - both)
    pairs = F.concat(F.arrays_zip(F.col("a_el").alias("e"), F.col("a_w").alias("w")), F.arrays_zip(F.col("b_el").alias("e"), F.col("b_w").alias("w")))
    # Equal elements of the two sorted lists become neighbours; their smaller weight is shared.
    shared = F.aggregate(
        F.array_sort(pairs),
        F.struct(F.lit(None).cast("long").alias("e"), F.lit(0).alias("w"), F.lit(0).cast("long").alias("sum")),
        lambda s, p: F.struct(
            p["e"].alias("e"), p["w"].alias("w"),
            (s["sum"] + F.when(s["e"].eqNullSafe(p["e"]), F.least(s["w"], p["w"])).otherwise(0)).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    return shared / (total("a_w") + total("b_w") - shared)


def _compare(key: tuple, those: pa.Table, these: pa.Table, weighted: bool) -> pa.Table:
    """Links (a, b) between nodes of a block of a class and a block of nodes around it, by exact similarity."""
    found: list[tuple[int, int]] = []
    if those.num_rows and these.num_rows:
        node, label = those["node"].to_numpy(), those["label"].to_numpy()
        bands = those["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        sets = [(np.asarray(e.values).view(np.uint64), np.asarray(w.values) if weighted else np.ones(len(e.values))) for e, w in zip(those["el"], those["w"], strict=True)]
        mass = np.array([w.sum() for _, w in sets])
        for row in range(these.num_rows):
            x, x_label = these["node"][row].as_py(), these["label"][row].as_py()
            x_el = np.asarray(these["el"][row].values).view(np.uint64)
            x_w = np.asarray(these["w"][row].values) if weighted else np.ones(len(x_el))
            total = x_w.sum()
            near = (label != x_label) & (bands == np.asarray(these["bands"][row].values)).any(axis=1)
            near &= (np.minimum(mass, total) >= SIMILARITY * np.maximum(mass, total))
            at = np.flatnonzero(near)
            if not len(at):
                continue
            el, w = np.concatenate([sets[i][0] for i in at]), np.concatenate([sets[i][1] for i in at])
            owner = np.repeat(np.arange(len(at)), [len(sets[i][0]) for i in at])
            place = np.minimum(np.searchsorted(x_el, el), len(x_el) - 1)
            both = np.bincount(owner, weights=np.where(x_el[place] == el, np.minimum(w, x_w[place]), 0.0), minlength=len(at))
            alike = at[both >= SIMILARITY * (mass[at] + total - both)]
            found += [(min(x, int(node[i])), max(x, int(node[i]))) for i in alike]
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _against_classes(around: DataFrame, facts: DataFrame, weighted: bool) -> DataFrame:
    """Links between nodes `around` a class (class, node) and all nodes of that class or around it.

    Both sides are cut into blocks of bounded size and every block of one meets every block of the other, so no task
    holds a whole class and no pair becomes a row unless it is a link.
    """
    classes = around.select("class").distinct()
    inside = facts.select("node", F.col("label").alias("class")).join(classes.hint("merge"), "class").select("class", "node")
    those = inside.unionAll(around)
    parts = (
        those.groupBy("class").agg((F.floor(F.count("*") / THOSE) + 1).cast("int").alias("n_those"))
        .join(around.groupBy("class").agg((F.floor(F.count("*") / THESE) + 1).cast("int").alias("n_these")).hint("merge"), "class")
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = those.join(parts.hint("merge"), "class").select("class", "node", own("n_those").alias("i"), every("n_these").alias("j"))
    right = around.join(parts.hint("merge"), "class").select("class", "node", own("n_these").alias("j"), every("n_those").alias("i"))
    keys = ["class", "i", "j"]
    full = lambda d: d.join(facts.hint("merge"), "node").groupBy(*keys)
    return full(left).cogroup(full(right)).applyInArrow(lambda k, x, y: _compare(k, x, y, weighted), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weighted: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """(rid, doc, class_id, class_size, kept): a row per document; class_id is the id of the document that stays.

    `rows`, if given, are `docs` as `numbered`.
    """
    steps = Steps(docs.sparkSession, "darts")
    rows = numbered(docs, steps, text) if rows is None else rows
    rows = rows.select("rid", F.col("row")[doc_id].cast("long").alias("doc"), "body")
    sketch = steps.save(
        rows.select("rid", "doc", "body").mapInArrow(
            lambda it: _sketch(it, weighted), "rid long, doc long, n long, set1 long, set2 long, bands array<long>"
        ),
        "sketch",
    )
    nodes = steps.save(
        sketch.where("n > 0").groupBy("set1", "set2").agg(F.min("rid").alias("node"), F.any_value("bands").alias("bands"), F.any_value("n").alias("n")),
        "nodes",
    )
    places = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    order = F.xxhash64("node", "band")
    buckets = steps.save(
        places.groupBy("band", "key").agg(F.count("*").alias("size"), F.min_by("node", order).alias("pivot")).where("size > 1"),
        "buckets",
    )
    members = steps.save(places.join(buckets.hint("merge"), ["band", "key"]).select("band", "key", "node", "pivot"), "members")
    tests = steps.save(
        members.where("node <> pivot")
        .groupBy(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        .agg(F.count("*").alias("bands")),
        "tests",
    )
    wanted = members.select(F.col("node").alias("rid")).distinct()
    elements = steps.save(
        rows.select("rid", "body").join(wanted.hint("merge"), "rid", "left_semi").mapInArrow(_elements, "node long, el array<long>, w array<int>"),
        "elements",
    )

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda s: elements.select(F.col("node").alias(s), F.col("el").alias(f"{s}_el"), F.col("w").alias(f"{s}_w"))
        return pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(_similarity(weighted) >= SIMILARITY).select("a", "b")

    # First the pair of each node that shares most bands, then other pairs, only across classes.
    best = tests.unionAll(tests.select(F.col("b").alias("a"), F.col("a").alias("b"), "bands")).groupBy("a").agg(
        F.max_by("b", F.struct("bands", "b")).alias("b")
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = steps.save(linked(best), "links0")
    labels = components(links, steps, "classes0")

    def label_of(pairs: DataFrame, column: str) -> DataFrame:
        named = labels.select(F.col("node").alias(column), F.col("label").alias(f"{column}_label"))
        return pairs.join(named, column, "left").withColumn(f"{column}_label", F.coalesce(f"{column}_label", column))

    apart = label_of(label_of(tests.select("a", "b").join(best, ["a", "b"], "left_anti"), "a"), "b").where("a_label <> b_label")
    links = links.unionAll(steps.save(linked(apart.select("a", "b")), "links1"))
    labels = components(links, steps, "classes1")

    # What pivots did not join: nodes outside the largest class of some bucket, against all of that class and each other.
    def split_buckets() -> DataFrame:
        held = steps.save(label_of(members, "node").select("band", "key", "node", F.col("node_label").alias("label"), "pivot"), f"held{len(rounds)}")
        sizes = held.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
        split = sizes.groupBy("band", "key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"))
        return steps.save(held.join(split.where("labels > 1").select("band", "key", "main").hint("merge"), ["band", "key"]), f"mixed{len(rounds)}")

    rounds: list[DataFrame] = []
    for turn in (2, 3):
        # First another pivot from the largest class, which settles most of them at one test per node and bucket.
        mixed = split_buckets()
        other = mixed.where("label = main").groupBy("band", "key").agg(F.min_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("p"))
        again = mixed.where("label <> main").join(other.hint("merge"), ["band", "key"])
        rounds.append(linked(again.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()))
        links = links.unionAll(steps.save(rounds[-1], f"links{turn}"))
        labels = components(links, steps, f"classes{turn}")
    mixed = split_buckets()
    around = steps.save(mixed.where("label <> main").select(F.col("main").alias("class"), "node").distinct(), "around")
    named = label_of(members.select("node").distinct(), "node").select("node", F.col("node_label").alias("label"))
    facts = steps.save(
        named.join(nodes.select("node", "bands").hint("merge"), "node").join(elements.hint("merge"), "node"), "facts"
    )
    links = links.unionAll(steps.save(_against_classes(around, facts, weighted), "links4"))
    labels = components(links, steps, "classes4")

    named = label_of(nodes.select("set1", "set2", "node"), "node").select("set1", "set2", F.col("node_label").alias("label"))
    placed = sketch.select("rid", "doc", "n", "set1", "set2").join(named.hint("merge"), ["set1", "set2"], "left").select(
        "rid", "doc", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("rid")).alias("label")
    )
    placed = steps.save(placed, "placed")
    kept = steps.save(placed.groupBy("label").agg(F.max(F.struct("doc", "rid")).alias("keep"), F.count("*").alias("class_size")), "kept")
    return placed.join(kept.hint("merge"), "label").select(
        "rid", "doc", F.col("keep.doc").alias("class_id"), "class_size", (F.col("keep.rid") == F.col("rid")).alias("kept")
    )
