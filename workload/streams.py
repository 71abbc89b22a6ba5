"""Streams, run to the end of the available input and read back from their tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselight.operators import merge, normalise
from bourselight.session import new_table_path
from bourselight.sources.landing import write_landing
from bourselight.streaming import jobs
from workload import landed
from workload.pipelines import P08_SQL
from workload.registry import query

LIMIT, WINDOW_SECONDS = 1, 3600


def timed_prices(landing):
    return normalise.prices(landing, ("fetched_at",))


# The later fetch first; the figures themselves break ties, so the winner does not depend on the order of rows.
PRICES = jobs.Target(
    "price_daily", timed_prices, ("symbol", "quote_date"), ("fetched_at", "close", "open", "high", "low", "volume"), "quote_date"
)


def _events(t):
    """The events as a stream of several micro-batches, whose files are not in order of time."""
    folder, events = new_table_path(t.spark, "events_stream"), t.table("events")
    events.repartition(8, "event_id").write.parquet(folder)
    return jobs.read_folder(t.spark, folder, events.schema, files_per_batch=3)


@query("t01_incremental_ingest", P08_SQL)
def t01(t):
    """Landed price files, taken in several micro-batches and once more in a second, resumed run."""
    folder, targets = new_table_path(t.spark, "landing_stream"), {"price_daily": PRICES}
    files = max(8, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    write_landing(landed.prices(t, files), folder)
    tables = jobs.tables_of(t.spark, new_table_path(t.spark, "layer2"), targets)
    for _ in range(2):
        jobs.ingest(jobs.read_landing_stream(t.spark, folder, files_per_batch=files // 2), tables, targets)
    return tables.read("price_daily").drop("fetched_at")


FANNED = {
    "ratio": jobs.Target("ratio", normalise.ratios, ("symbol", "statement_type", "family", "header", "field_name")),
    "metric": jobs.Target("metric", normalise.metrics, ("symbol", "statement_type", "family", "field_name")),
    "index_return": jobs.Target("index_return", normalise.index_returns, ("index_symbol", "horizon")),
    "shareholding": jobs.Target("shareholding", normalise.shareholding, ("symbol", "period_label", "group_name")),
}
_FIGURES = {"ratio": "value", "metric": "value", "index_return": "return_pct", "shareholding": "shareholding_pct"}
_WHERE = {"index_return": "WHERE return_pct <> 0"}


@query(
    "t05_ingest_fans_out",
    "\nUNION ALL ".join(
        f"SELECT '{table}' AS target, '{key}' AS key_column, CAST({key} AS VARCHAR) AS key, count(*) AS rows, "
        f"round(sum({figure}), 4) AS total FROM {'index_returns' if table == 'index_return' else table + 's' * (table != 'shareholding')} "
        f"{_WHERE.get(table, '')} GROUP BY {key}"
        for table, figure in _FIGURES.items()
        for key in [FANNED[table].keys[0]]
    ),
)
def t05(t):
    """One stream of mixed payloads into four tables, sent twice in other micro-batches: each row is stored once."""
    folder = new_table_path(t.spark, "landing_mixed")
    calls = (landed.ratios, landed.metrics, landed.index_returns, landed.shareholding)
    sent = reduce(DataFrame.unionByName, [call(t) for call in calls])
    sent.repartition(4, "endpoint").write.json(folder)
    tables = jobs.tables_of(t.spark, new_table_path(t.spark, "layer2"), FANNED)
    jobs.ingest(jobs.read_landing_stream(t.spark, folder, files_per_batch=2), tables, FANNED)
    jobs.ingest(jobs.read_landing_stream(t.spark, folder), tables, FANNED, name="again")
    parts = []
    for table, target in FANNED.items():
        key = target.keys[0]
        counted = tables.read(table).groupBy(F.col(key).cast("string").alias("key")).agg(
            F.count("*").alias("rows"), F.round(F.sum(_FIGURES[table]), 4).alias("total")
        )
        parts.append(counted.select(F.lit(table).alias("target"), F.lit(key).alias("key_column"), "key", "rows", "total"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "t02_stream_dedupe",
    "SELECT DISTINCT endpoint, symbol, sha256(payload) AS content_hash FROM archive",
)
def t02(t):
    """Fetches in several micro-batches, then all of them once more: the archive takes each content once and no more."""
    store = merge.Archive(t.spark, new_table_path(t.spark, "raw_response"))
    for name in ("first", "again"):
        fetched = _events(t).select(
            F.col("event_type").alias("endpoint"), F.col("user_id").cast("string").alias("symbol"),
            F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("fetched_at"), F.col("event_id").alias("id"),
        )
        jobs.archive(fetched, store, name)
    return store.index().select("endpoint", "symbol", "content_hash")


@query(
    "t03_request_rates",
    """SELECT client_key, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests,
  count(*) > 1 AS over_limit FROM (
  SELECT CAST(user_id AS VARCHAR) AS client_key,
    time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 10 SECOND * unnest(range(6)) AS window_start FROM events)
GROUP BY 1, 2""",
)
def t03(t):
    log = _events(t).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("client_key"))
    schema = "client_key string, window_start timestamp, requests bigint"
    rates = jobs.summed(log, "rates", schema, ["client_key", "window_start"], ["requests"], jobs.request_rates)
    return rates.select(
        "client_key", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests",
        (F.col("requests") > 1).alias("over_limit"),
    )


@query(
    "t03_contested_stretches",
    f"""WITH counts AS (SELECT CAST(user_id AS VARCHAR) AS client_key,
    CAST(floor(epoch_us(ts) / ({WINDOW_SECONDS} * 1000000.0)) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2),
  pairs AS (SELECT *, n + CASE WHEN lag(bucket) OVER w = bucket - 1 THEN lag(n) OVER w ELSE 0 END AS pair
    FROM counts WINDOW w AS (PARTITION BY client_key ORDER BY bucket)),
  numbered AS (SELECT *, bucket - row_number() OVER (PARTITION BY client_key ORDER BY bucket) AS stretch
    FROM pairs WHERE pair > {LIMIT})
SELECT client_key, min(bucket) AS first_bucket, max(bucket) AS last_bucket, CAST(sum(n) AS BIGINT) AS requests
FROM numbered GROUP BY client_key, stretch""",
)
def t03_contested(t):
    return jobs.contested_stretches(t.access_log, LIMIT, WINDOW_SECONDS)


@query(
    "t04_rolling_levels",
    """SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
  count(*) FILTER (WHERE level = 'ERROR') AS errors, count(*) FILTER (WHERE level = 'WARNING') AS warnings FROM (
  SELECT level, time_bucket(INTERVAL 1 HOUR, created_at) - INTERVAL 1 HOUR * unnest(range(24)) AS window_start FROM logs)
GROUP BY 1""",
)
def t04(t):
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").otherwise("INFO")
    logs = _events(t).select(F.col("ts").cast("timestamp").alias("created_at"), level.alias("level"))
    schema = "window_start timestamp, errors bigint, warnings bigint"
    counts = jobs.summed(logs, "levels", schema, ["window_start"], ["errors", "warnings"], jobs.level_counts)
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
