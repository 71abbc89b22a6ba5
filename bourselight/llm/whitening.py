"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers x = floor(64 c) + 1000000. The rows to fit are the distinct x vectors, centred. Their triangular
factor R is found without ever forming an inverse or a covariance of raw figures:

1. A pass sums the Gram matrix of the rows, solved through the triangular factors found so far: rows times R1^-1, R2^-1, ...
2. The Cholesky factor of that Gram matrix is the next factor. The first one is shifted (11 (n d + d (d + 1)) u |A|^2 is added
   to the diagonal), so it exists however ill-conditioned the rows are; later ones are where rounding demands it.
3. Passes repeat until the solved rows are orthonormal, then R = Rk ... R2 R1. The error of R is that of a QR of the rows
   themselves, where a decomposition of the Gram matrix alone would lose half of the digits of small components.
4. The singular values s and right vectors of R are those of the rows: e = s^2 / n, and whitened = row times vector / sqrt(e).

Means are never subtracted from large figures: a row is x - p, exact for whole p, less the remainder (S - n p) / n below 1.

A Gram pass yields one partial row per task and dimension, so d rows of d figures reach the driver: 8 d^2 bytes, whatever the
number of rows. Distinct vectors are found by grouping, combined before the shuffle, so a vector with a million copies is one
row a task. Every row of the table is whitened in a plain scan.

Rows whose vector is null or holds a null, NaN or infinite entry are dropped. Vectors of another length lie in another space:
each length is fitted by itself, with its own n. Empty vectors have no component. Components whose singular value is rounding
(below 64 d u of the greatest) do not exist: constant dimensions, or fewer distinct rows than dimensions, give fewer than 16
rows per vector; with one distinct vector, or none, there are no rows. Repeated rows and repeated or null vec_id are kept as
they are. Equal eigenvalues share a plane, in which any two perpendicular components are as good. Entries beyond 2^30, or a
deviation beyond 2^63, raise an error instead of a wrong figure. Columns of the input other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselight.llm.common import Steps, ship_package

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
UNIT = float(np.finfo(np.float64).eps)
# Greatest entry: sums of a task's rows then stay whole numbers of 64 bits.
LIMIT = 2.0**30
# Rows that a task holds as figures at once.
SLICE = 8192
MAX_PASSES = 8
ENOUGH = 1e-13
_GRAM = "i int, part binary"
_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x) of all rows whose vector holds finite entries only."""
    c = F.col(column).cast("array<double>")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    too_large = F.raise_error(F.lit(f"an entry of {column} is beyond {LIMIT}")).cast("long")
    x = F.transform(c, lambda v: F.when(F.abs(v) <= LIMIT, F.floor(v * SCALE).cast("long") + OFFSET).otherwise(too_large))
    return vectors.where(c.isNotNull() & sound).select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Fit:
    """The fit of one length of vectors: exact sums, then triangular factors, then components."""

    n: int
    pivot: np.ndarray
    remainder: np.ndarray
    factors: list[np.ndarray] = field(default_factory=list)
    vectors: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.pivot).astype(np.float64) - self.remainder / self.n

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        rows = self.centred(x).T
        for factor in self.factors:
            rows = _solve_lower(factor.T, rows)
        return rows.T

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of squares of n x - S, by whole numbers of 64 bits where they hold it and of any size where not."""
        away = x - self.pivot
        most = max(int(np.abs(away).max(initial=0)), 1) * self.n + int(np.abs(self.remainder).max(initial=0))
        if most * most * x.shape[1] >= 2**63:
            away, rest = away.astype(object), self.remainder.astype(object)
            return [sum(v * v for v in row) for row in away * self.n - rest]
        return np.square(away * self.n - self.remainder).sum(axis=1).tolist()


def _solve_lower(lower: np.ndarray, right: np.ndarray, block: int = 32) -> np.ndarray:
    """lower^-1 right by forward substitution, a block of rows at a time."""
    out = right.copy()
    for first in range(0, len(lower), block):
        last = min(first + block, len(lower))
        for i in range(first, last):
            out[i] = (out[i] - lower[i, first:i] @ out[first:i]) / lower[i, i]
        out[last:] -= lower[last:, first:last] @ out[first:last]
    return out


def _summed(rows: DataFrame, d: int, figures: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of f^T f, for f = `figures` of a matrix of rows: one pass, partial sums added by row of the sum."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            for at in range(0, len(x), SLICE):
                f = figures(x[at : at + SLICE])
                total = f.T @ f + (0 if total is None else total)
        if total is not None:
            yield _row_batch(total)

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.float64) for b in table.column("part").to_pylist()]
        return pa.table({"i": table.column("i")[:1], "part": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

    sums = rows.select("x").mapInArrow(partial, _GRAM).groupBy("i").applyInArrow(add, _GRAM)
    found = {r["i"]: np.frombuffer(r["part"], np.float64) for r in sums.collect()}  # d rows of d figures
    return np.array([found[i] for i in sorted(found)])


def _row_batch(total: np.ndarray) -> pa.RecordBatch:
    rows = [np.ascontiguousarray(r).tobytes() for r in total]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["i", "part"]
    )


def _exact_sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """How many rows there are, and the exact sum of each dimension."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 1), pa.int32()), pa.array([*total.tolist(), n], pa.int64())], names=["i", "s"]
        )

    sums = rows.select("x").mapInArrow(partial, "i int, s long").groupBy("i").agg(F.sum("s").alias("s"))
    found = {r["i"]: r["s"] for r in sums.collect()}  # d + 1 rows
    return found[d], np.array([found[i] for i in range(d)], np.int64)


def _upper_factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The Cholesky factor, its diagonal shifted by as much as rounding makes necessary."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 4, 4 * UNIT * max(1.0, float(np.trace(gram))))


def fit(distinct: DataFrame, d: int) -> Fit | None:
    """Means, components and eigenvalues of distinct vectors of length d; None where they span nothing."""
    n, sums = _exact_sums(distinct, d)
    pivot = sums // n
    found = Fit(n, pivot, sums - n * pivot)
    for turn in range(MAX_PASSES):
        gram, shift, done = _summed(distinct, d, found.orthogonal), 0.0, False
        if turn == 0:
            found.trace = float(np.trace(gram)) / n
            if found.trace == 0.0:
                return None
            norm = float(np.linalg.norm(gram, 2))
            shift = min(11 * (n * d + d * (d + 1)) * UNIT, 1.0) * norm
        else:
            # Directions that the rows do not have stay near 0 and fall below the cut by rank.
            live = np.linalg.eigvalsh(gram)
            done = bool(np.all(np.minimum(np.abs(live - 1), np.abs(live)) < ENOUGH * max(d, 64)))
        found.factors.append(_upper_factor(gram, shift))
        if done:
            break
    product = np.eye(d)
    for factor in found.factors:
        product = factor @ product
    singular, right = np.linalg.svd(product)[1:]
    solid = singular > 64 * d * UNIT * singular[0]
    kept = int(solid[:COMPONENTS].sum())
    vectors = right[:kept].T
    # Either sign will do: the entry of greatest size is positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    found.vectors, found.values = vectors, singular[:kept] ** 2 / n
    return found


def identity_error(distinct: DataFrame, d: int, found: Fit) -> float:
    """The largest entry of the covariance of the whitened rows less the identity, by one more pass."""

    def figures(x: np.ndarray) -> np.ndarray:
        white = found.whitened(x)
        return np.hstack([white, np.ones((len(white), 1))])

    gram = _summed(distinct, d, figures) / found.n
    mean = gram[-1, :-1]
    covariance = gram[:-1, :-1] - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(vectors: DataFrame, steps: Steps | None = None) -> DataFrame:
    """One row per sound row and component up to 16; see the module for vectors left out and odd cases."""
    spark = vectors.sparkSession
    ship_package(spark)
    steps = steps or Steps(spark, "whitening")
    sound = whole_vectors(vectors)
    distinct = steps.save(sound.groupBy("x").agg(F.size("x").alias("d")), "distinct")
    lengths = sorted(r["d"] for r in distinct.select("d").distinct().collect() if r["d"])
    out = None
    for d in lengths:
        own = distinct.where(F.col("d") == d)
        found = fit(own, d)
        if found is not None:
            white = _projected(sound.where(F.size("x") == d), d, found, identity_error(own, d, found))
            out = white if out is None else out.unionByName(white)
    return spark.createDataFrame([], _WHITE) if out is None else out


def _projected(sound: DataFrame, d: int, found: Fit, error: float) -> DataFrame:
    explained = found.values / found.trace
    kept = len(explained)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x, m = _matrix(part.column("x"), d), part.num_rows
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept)))
                deviation = pa.array(found.deviations(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * kept, found.n, np.int64)),
                        deviation.take(pa.array(np.repeat(np.arange(m), kept))), pa.array(found.whitened(x).ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return sound.mapInArrow(project, _WHITE)
