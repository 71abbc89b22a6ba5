"""Table maintenance: upserts, coalescing merges, group replacement, content-addressed appends.

Each function takes stored rows and a batch and returns the rows to store instead. The stored rows are only anti-joined on
the keys that the batch touches, so the work on them is one filter and no sort. `buckets.Tables` passes the stored rows of the
touched buckets alone; the functions do as well on whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselight.functions.parse import content_hash
from bourselight.operators.buckets import Append, Layout, Tables, Write
from bourselight.operators.spread import top_n


def newest_per_key(batch: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    return top_n(batch, keys, newest_first, 1).drop("position")


def upsert(
    current: DataFrame, batch: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]
) -> DataFrame:
    """Insert or overwrite by key; within the batch the newest row of a key wins."""
    incoming = newest_per_key(batch, keys, newest_first).select(*current.columns)
    kept = current.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming)


def keep_newest(current: DataFrame, batch: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, whether stored or new: a batch that comes late changes nothing newer."""
    return newest_per_key(current.unionByName(batch.select(*current.columns)), keys, newest_first)


def merge_profiles(current: DataFrame, profiles: DataFrame) -> DataFrame:
    """Overwrite company fields with the non-null fields of a profile.

    An unknown symbol is inserted, named by its symbol where the profile has no name. A profile with no field
    at all changes nothing.
    """
    fields = [c for c in profiles.columns if c != "symbol"]
    useful = profiles.where(F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull())
    new = useful.withColumnsRenamed({c: f"_new_{c}" for c in fields})
    joined = current.join(new, "symbol", "full_outer")
    merged = [
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
        for c in current.columns
    ]
    return joined.select(*merged).withColumn("name", F.coalesce("name", "symbol"))


def replace_groups(
    current: DataFrame, batch: DataFrame, group: Sequence[str], touched: DataFrame | None = None
) -> DataFrame:
    """Drop every stored row of a touched group, then add the batch.

    `touched` names the groups where the batch itself may hold no row for some of them.
    """
    groups = (batch if touched is None else touched).select(*group).distinct()
    kept = current.join(groups, list(group), "left_anti")
    return kept.unionByName(batch.select(*current.columns))


PERIOD_KEY = ("symbol", "statement_type", "statement_code", "period_kind", "header")


def restatement(new_periods: DataFrame, new_lines: DataFrame) -> dict[str, Write]:
    """The writes of restated periods and their lines, for one commit: a reader sees both or neither."""
    restated = new_periods.select(*PERIOD_KEY)

    def periods(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(restated, list(PERIOD_KEY), "left_anti").unionByName(new.select(*old.columns))

    def lines(old: DataFrame, new: DataFrame) -> DataFrame:
        return replace_groups(old, new, PERIOD_KEY, touched=restated)

    return {
        "statement_period": Write(new_periods, periods),
        "statement_line": Write(new_lines, lines, keys=new_periods),
    }


ARCHIVE_KEY = ("endpoint", "symbol", "content_hash")


def latest_payload(archive: DataFrame) -> DataFrame:
    """The most recent payload per endpoint and symbol; ids are unique.

    The newest id is picked from rows without payloads. The payloads then pass a hash join by id that is built on these, so
    none is sorted.
    """
    newest = [F.col("fetched_at").desc(), F.col("id").desc()]
    picked = top_n(archive.select("endpoint", "symbol", "fetched_at", "id"), ["endpoint", "symbol"], newest, 1)
    return archive.join(picked.select("id").hint("shuffle_hash"), "id", "left_semi")


class Archive:
    """Raw payloads stored once per (endpoint, symbol, content): an index of narrow rows, and the payloads apart from it.

    Both lie in buckets of the content hash. A batch meets the index rows of its own buckets, never a stored payload, and
    appends to both tables in one commit.
    """

    INDEX = (*ARCHIVE_KEY, "fetched_at", "id")
    LAYOUT = Layout(("content_hash",))

    def __init__(self, spark: SparkSession, path: str):
        self.tables = Tables(spark, path, {"index": self.LAYOUT, "payloads": self.LAYOUT})

    def append(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> bool:
        """Add the content of a batch that is new; of equal contents the first fetched stays. False if taken before."""
        hashed = batch.withColumn("content_hash", content_hash("payload"))
        first = [F.col("fetched_at"), F.col("id")]
        new = top_n(hashed.select(*self.INDEX), ARCHIVE_KEY, first, 1).drop("position")
        if "index" in self.tables.version().tables:
            held = self.tables.holding("index", new).select(*ARCHIVE_KEY)
            new = new.join(held, list(ARCHIVE_KEY), "left_anti")
        payloads = hashed.select("content_hash", "id", "payload")
        fetched = payloads.join(new.select("content_hash", "id").hint("shuffle_hash"), ["content_hash", "id"], "left_semi")
        return self.tables.commit(stream, index=Append(new), payloads=Append(fetched))

    def index(self) -> DataFrame:
        return self.tables.read("index")

    def latest(self) -> DataFrame:
        """The most recently added content per endpoint and symbol, with its payload."""
        version = self.tables.version()
        newest = [F.col("fetched_at").desc(), F.col("id").desc()]
        picked = top_n(self.tables.read("index", version=version), ["endpoint", "symbol"], newest, 1).drop("position")
        payloads = self.tables.read("payloads", version=version)
        return payloads.join(picked.hint("shuffle_hash"), ["content_hash", "id"])


def newest_schema_kind(periods: DataFrame) -> DataFrame:
    """The statement family per company, from its newest classified P&L period."""
    classified = periods.where(
        (F.col("statement_code") == "pl")
        & F.col("schema_kind").isNotNull()
        & (F.col("schema_kind") != "unknown")
    )
    newest = [F.col("period_end").desc_nulls_last(), F.col("year").desc_nulls_last(), F.col("schema_kind")]
    return top_n(classified, ["symbol"], newest, 1).select("symbol", "schema_kind")


def changed_schema_kinds(company: DataFrame, periods: DataFrame) -> DataFrame:
    """(symbol, schema_kind) of the companies whose stored family differs from that of their periods."""
    stored = company.select("symbol", F.col("schema_kind").alias("_stored"))
    found = newest_schema_kind(periods).join(stored, "symbol")
    return found.where(~F.col("schema_kind").eqNullSafe(F.col("_stored"))).drop("_stored")


def set_schema_kinds(company: DataFrame, found: DataFrame) -> DataFrame:
    joined = company.join(found.select("symbol", F.col("schema_kind").alias("_found")), "symbol", "left")
    return joined.withColumn("schema_kind", F.coalesce("_found", "schema_kind")).drop("_found").select(*company.columns)


def write_back_schema_kind(company: DataFrame, periods: DataFrame) -> DataFrame:
    return set_schema_kinds(company, newest_schema_kind(periods))
