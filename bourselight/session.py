"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Recommended cluster settings. Nothing in the package depends on them for its results.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in CLUSTER_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A local session without one takes a folder below its warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-{uuid.uuid4().hex[:8]}"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, so no run overwrites what another one reads."""
    return f"{work_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


# Tables are derived by aggregates that hardly shrink in their first step, so a task holds about its whole share of a file.
DERIVE_BYTES = 8 << 20


@contextmanager
def small_reads(spark: SparkSession) -> Iterator[None]:
    """Files are read in shares of `DERIVE_BYTES` at most by the actions inside; what the session had holds again after."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > DERIVE_BYTES:
        spark.conf.set(key, f"{DERIVE_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_STORED: dict[tuple[str, str, str, str], tuple[str, StructType]] = {}


def _file_state(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the files in a data folder and one level below, as the session's file system sees them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in system.listStatus(path):
        below = system.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        found += [f"{e.getPath().toString()} {e.getLen()} {e.getModificationTime()}" for e in below]
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def stored_once(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is derived from a data folder once per application and state of its files, then read as stored."""
    key = (spark.sparkContext.applicationId, folder, _file_state(spark, folder), name)
    if key in _STORED:
        path, schema = _STORED[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            # The shared folder was cleaned in between: derive the table again.
            del _STORED[key]
    made, path = make(), new_table_path(spark, name)
    with small_reads(spark):
        made.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _STORED[key] = (path, made.schema)
    return spark.read.schema(made.schema).parquet(path)


def write_and_read(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame as Parquet under the shared folder and return the table as read back."""
    path = new_table_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
