"""What the operators of this subpackage share: tables, stored steps, and a document's row as a value."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Bytes U+0009..U+000D and U+0020 separate words, everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]"


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package from any folder; clusters get it at submission."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.master.startswith("local[") and not any(f.endswith(f"/{package.name}") for f in context.listFiles):
        context.addFile(str(package), recursive=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session without one takes a folder below its warehouse from then on."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-{uuid.uuid4().hex[:8]}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Steps:
    """Tables that one run of an operator writes to the shared folder, so that a lost executor costs no recomputation.

    `drop` removes a step that no later one reads. Steps that the result reads stay; whoever started the run may clear
    the folder afterwards.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write a frame, split into folders by one column if named, and return it as stored."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row(docs: DataFrame, text: str = "text", **more: Column) -> DataFrame:
    """(row, rid, body, ...): the whole row as one value, a number for it, and its text with null read as empty.

    Operators add their columns beside `row`, so a document's own columns never clash with them. `rid` follows the splits of
    the scan, which move with the cores at hand: it holds inside one job. Decisions of one job that another joins back need
    `numbered`.
    """
    ship_package(docs.sparkSession)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.monotonically_increasing_id().alias("rid"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"),
        *[c.alias(n) for n, c in more.items()],
    )


def numbered(docs: DataFrame, steps: Steps, text: str = "text") -> DataFrame:
    """(row, rid, body) as `with_row`, numbered once and stored, so that every job reads the same numbers."""
    rows = steps.save(with_row(docs, text).select("row", "rid"), "rows")
    return rows.withColumn("body", F.coalesce(F.col("row")[text].cast("string"), F.lit("")))


def let(value: Column, use) -> Column:
    """Bind an expression to a lambda variable, so that higher-order functions evaluate it once, not per element."""
    return F.element_at(F.transform(F.array(value), use), 1)
