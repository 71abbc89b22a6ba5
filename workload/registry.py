"""Registration of queries with their SQL, and small helpers that both sides share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselight.sources.testbed import Testbed
from workload.ctes import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of a Testbed under a name, with the SQL of its result where SQL can state it."""

    def register(fn: Callable[[Testbed], DataFrame]) -> Callable[[Testbed], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Testbed(spark, folder))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


def snapshot_table(t: Testbed) -> DataFrame:
    """The snapshot as a written table, as screens and pages read it."""
    return t.snapshot


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All DOUBLE columns to a number of places, for comparison."""
    return df.select(
        *[F.round(F.col(n), places).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )


def r6(*columns: str) -> str:
    """Select list that rounds columns to six places under their own names."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def names(columns: Iterable[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c}" for c in columns)
