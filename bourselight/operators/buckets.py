"""Stored tables that are maintained by the buckets a batch touches, several tables under one version.

A table lies in folders by bucket: a hash of its key, and the year for tables that grow by date. A commit reads the buckets
that its batch touches, merges, and writes these anew; files of all other buckets stay as they are. A version file names the
live folder of each bucket of each table. It is written last and appears by one rename, so

* readers see all tables of a commit or none of it, and a job that fails halfway leaves the old tables;
* a stream records the batch it has taken in the same file: a batch that runs again finds itself taken and changes nothing;
* two commits that began from the same version cannot both succeed: the second raises `Conflict`, and may run again.

Reading costs what the table holds, however many batches made it: merged buckets have one folder, and a bucket of an
appended table is written together once `COMPACT` batches lie in it. Folders that the last `KEEP` versions do not name are
removed with the commit that retires them; a reader that takes longer than `KEEP` commits has to read again.

The driver handles names of buckets only, of which there are as many as the layout says (times the years).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, COMPACT, KEEP = 32, 8, 2
_PART = "_part"

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another commit was made since this one began."""


@dataclass(frozen=True)
class Layout:
    """The columns whose hash gives a row's bucket, how many buckets there are, and the date column cut by year, if any."""

    keys: tuple[str, ...]
    buckets: int = BUCKETS
    year_of: str | None = None

    def part(self) -> Column:
        """The bucket of a row, by its key alone, so that a key's rows are always found in the same buckets."""
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("string")
        if self.year_of is None:
            return bucket
        return F.concat_ws("-", bucket, F.coalesce(F.year(self.year_of).cast("string"), F.lit("none")))


@dataclass
class Version:
    number: int = 0
    # Table -> schema as JSON; table -> bucket -> folders; stream -> last batch taken.
    schemas: dict[str, str] = field(default_factory=dict)
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)


class _Files:
    """The few file operations needed, on whatever file system the session's paths are of."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        system, path = self.system(folder), self.path(folder)
        return [e.getPath().getName() for e in system.listStatus(path)] if system.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.system(name).open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, text: str, name: str) -> bool:
        """Write a file that appears complete, or not at all where one of its name exists."""
        hidden = f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        stream = self.system(hidden).create(self.path(hidden), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system(name).getUri(), self.conf)
        no_overwrite = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.path(hidden), self.path(name), no_overwrite)
        except Py4JJavaError as error:
            self.remove(hidden)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)


class Tables:
    """Tables under one path. `layouts` names each table's layout; schemas are those of the first commit of a table."""

    def __init__(self, spark: SparkSession, path: str, layouts: dict[str, Layout]):
        self.spark, self.path, self.layouts, self.files = spark, path.rstrip("/"), layouts, _Files(spark)

    # Reading

    def version(self) -> Version:
        numbers = [int(n.split(".")[0]) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json")]
        return self._load(max(numbers)) if numbers else Version()

    def read(self, table: str, parts: Iterable[str] | None = None, version: Version | None = None) -> DataFrame:
        """A table as of a version (the newest if none is given), or some buckets of it."""
        version = version or self.version()
        live = version.tables[table]
        folders = [f for p in (live if parts is None else parts) for f in live.get(p, ())]
        schema = StructType.fromJson(json.loads(version.schemas[table]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def touched(self, table: str, rows: DataFrame) -> list[str]:
        """The buckets that rows fall into, by their key columns."""
        found = rows.select(self.layouts[table].part().alias(_PART)).distinct().collect()  # one row a bucket
        return sorted(r[_PART] for r in found)

    def holding(self, table: str, rows: DataFrame) -> DataFrame:
        """The stored buckets in which rows of these keys can lie."""
        return self.read(table, self.touched(table, rows))

    # Writing

    def commit(self, batch: tuple[str, int] | None = None, **writes: Write) -> bool:
        """Apply writes to all named tables at once. False if the stream's batch was taken before."""
        old = self.version()
        if batch is not None and old.taken.get(batch[0], -1) >= batch[1]:
            return False
        new = Version(old.number + 1, dict(old.schemas), {t: dict(p) for t, p in old.tables.items()}, dict(old.taken))
        commit = uuid.uuid4().hex
        for table, write in writes.items():
            write.apply(self, table, commit, old, new)
        if batch is not None:
            new.taken[batch[0]] = batch[1]
        text = json.dumps({"schemas": new.schemas, "tables": new.tables, "taken": new.taken})
        if not self.files.publish(text, self._file(new.number)):
            for table in writes:
                self.files.remove(f"{self.path}/{table}/{commit}")
            raise Conflict(f"version {new.number} of {self.path} exists")
        self._retire(new)
        return True

    def write(self, table: str, rows: DataFrame, commit: str) -> dict[str, str]:
        """Write rows by bucket under a commit's folder; bucket -> folder."""
        folder = f"{table}/{commit}"
        placed = rows.withColumn(_PART, self.layouts[table].part())
        # Few files a bucket; Spark splits a bucket that is much larger than the others.
        placed.hint("rebalance", F.col(_PART)).write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in self.files.names(f"{self.path}/{folder}") if n.startswith(_PART)}

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/{number:012}.json"

    def _load(self, number: int) -> Version:
        return Version(number, **json.loads(self.files.read(self._file(number))))

    def _retire(self, new: Version) -> None:
        """Remove the oldest version and the folders that only it names."""
        numbers = sorted(int(n.split(".")[0]) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json"))
        kept = [new, *[self._load(n) for n in numbers[-KEEP:] if n != new.number]]
        live = {f for v in kept for parts in v.tables.values() for folders in parts.values() for f in folders}
        for number in numbers[:-KEEP]:
            old = self._load(number)
            for folder in {f for parts in old.tables.values() for folders in parts.values() for f in folders} - live:
                self.files.remove(f"{self.path}/{folder}")
            self.files.remove(self._file(number))


@dataclass
class Write:
    """Rows for a table: its whole new content, or a batch to merge into the buckets that it touches.

    `merge` gets the stored rows of these buckets (none for a new table) and the batch. `keys` are rows whose keys tell the
    touched buckets where the batch alone does not.
    """

    rows: DataFrame
    merge: Merge | None = None
    keys: DataFrame | None = None

    def apply(self, tables: Tables, table: str, commit: str, old: Version, new: Version) -> None:
        live = new.tables.setdefault(table, {})
        if self.merge is None:
            result, touched = self.rows, list(live)
        else:
            touched = tables.touched(table, self.rows if self.keys is None else self.keys)
            current = tables.read(table, touched, old) if table in old.tables else self.rows.limit(0)
            result = self.merge(current, self.rows)
            new.schemas.setdefault(table, result.schema.json())
        written = tables.write(table, result, commit)
        if self.merge is None:
            new.schemas[table] = result.schema.json()
        elif set(written) - set(touched):
            raise ValueError(f"a merge into {table} made rows of buckets that its batch does not touch")
        for part in touched:
            live.pop(part, None)
        live.update({p: [f] for p, f in written.items()})


@dataclass
class Append(Write):
    """Rows that are new to a table: their buckets get one more folder, and are written together after some."""

    def apply(self, tables: Tables, table: str, commit: str, old: Version, new: Version) -> None:
        live = new.tables.setdefault(table, {})
        new.schemas.setdefault(table, self.rows.schema.json())
        written = tables.write(table, self.rows, commit)
        full = [p for p in written if len(live.get(p, ())) + 1 >= COMPACT]
        for part, folder in written.items():
            live[part] = [*live.get(part, ()), folder]
        if full:
            together = tables.write(table, tables.read(table, full, new), f"{commit}-compact")
            live.update({p: [f] for p, f in together.items()})
            for part in full:
                tables.files.remove(f"{tables.path}/{written[part]}")
