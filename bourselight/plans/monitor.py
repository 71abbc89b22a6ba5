"""Reports on the archive, ingestion runs and logs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight.operators.spread import top_n

# Fixed values.
STATUSES = ("done", "skipped", "failed")
MAX_LOG_ROWS = 500
LOG_RETENTION = 2000
FAILURES_SHOWN = 20


def archive_summary(archive: DataFrame) -> DataFrame:
    """Number of responses and symbols, newest fetch, and bytes held."""
    return archive.agg(
        F.count("*").alias("raw_responses"),
        F.count_distinct("symbol").alias("distinct_symbols"),
        F.max("fetched_at").alias("last_fetched_at"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("uncompressed_bytes"),
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def newest_logs(
    logs: DataFrame, level: str | None = None, logger: str | None = None, limit: int = 100
) -> DataFrame:
    """Newest log rows of a level and of loggers with a prefix; at most MAX_LOG_ROWS may be asked for."""
    if limit > MAX_LOG_ROWS:
        raise ValueError(f"at most {MAX_LOG_ROWS} log rows")
    out = filter_logs(logs, level, logger)
    return out.orderBy(F.desc("id")).limit(limit)


def filter_logs(logs: DataFrame, level: str | None = None, logger: str | None = None) -> DataFrame:
    out = logs if level is None else logs.where(F.col("level") == level.upper())
    return out if logger is None else out.where(F.col("logger").startswith(logger))


def counts_by_level(logs: DataFrame, now: Column) -> DataFrame:
    """Rows per level, of all time and of the last 24 hours."""
    recent = F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")
    return logs.groupBy("level").agg(F.count("*").alias("total"), F.count_if(recent).alias("last_24h"))


def trim_logs(logs: DataFrame, keep: int = LOG_RETENTION) -> DataFrame:
    """The newest `keep` rows. Only the ids are ranked; the rows are then filtered by the cut-off id."""
    newest = logs.select("id").orderBy(F.desc("id")).limit(keep)
    return logs.where(F.col("id") >= newest.agg(F.min("id")).scalar())


def log_health(logs: DataFrame, now: Column) -> DataFrame:
    """Errors and warnings of the last 24 hours and the newest error, as one row."""
    recent = F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")
    is_error = F.col("level").isin("ERROR", "CRITICAL")
    return logs.agg(
        F.count_if(recent & is_error).alias("errors_last_24h"),
        F.count_if(recent & (F.col("level") == "WARNING")).alias("warnings_last_24h"),
        F.max(F.when(is_error, F.col("id"))).alias("last_error_id"),
        F.max_by("message", F.when(is_error, F.col("id"))).alias("last_error"),
    )


def task_counts(tasks: DataFrame) -> DataFrame:
    """Tasks per run, one column per known status and one for all others."""
    status = F.col("status")
    return tasks.groupBy("run_id").agg(
        *[F.count_if(status == s).alias(s) for s in STATUSES],
        F.count_if(~F.coalesce(status.isin(*STATUSES), F.lit(False))).alias("other"),
    )


def planned_symbols(scope: Column) -> Column:
    """Number of companies a run set out to fetch; NULL unless the scope holds a whole number."""
    value = F.get_json_object(scope, "$.symbols")
    return F.when(value.rlike(r"^-?\d+$"), value.try_cast("bigint"))


def symbols_done(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("run_id").agg(F.count_distinct("symbol").alias("symbols_done"))


def run_progress(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every run with task counts per status, symbols reached and symbols planned."""
    out = runs.join(task_counts(tasks), "run_id", "left").join(symbols_done(tasks), "run_id", "left")
    return out.fillna(0, [*STATUSES, "other", "symbols_done"]).withColumn(
        "symbols_total", planned_symbols(F.col("scope"))
    )


def newest_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def first_failures(tasks: DataFrame, limit: int = FAILURES_SHOWN) -> DataFrame:
    """The first failed tasks of every run."""
    failed = tasks.where(F.col("status") == "failed")
    order = [F.col("symbol"), F.col("endpoint"), F.col("task_id")]
    return top_n(failed, ["run_id"], order, limit)


def freshness(archive: DataFrame, runs: DataFrame, limit: int = 5) -> DataFrame:
    """Archive summary repeated beside the most recent runs."""
    held = archive_summary(archive)
    once = held.select(F.struct(*held.columns)).scalar()
    shown = newest_runs(runs, limit).select("run_id", "started_at", once.alias("held"))
    return shown.select("run_id", "started_at", "held.*")
