"""Landed API responses: one JSON payload per row, kept as text and parsed per endpoint.

A landing frame has (endpoint STRING, symbol STRING, params MAP<STRING,STRING>, payload STRING).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANDING_SCHEMA = (
    "endpoint string, symbol string, params map<string,string>, payload string, fetched_at timestamp"
)

# Path part of an endpoint -> the table its payload is normalised into.
ROUTES = {
    "/stock-symbols": "company",
    "/company-profile/": "company_profile",
    "/quote": "quote",
    "/financials/": "statement",
    "/basic-financials/": "basic_financial",
    "/financial-metrics/": "metric",
    "/ratios/": "ratio",
    "/daily-price-ratios/": "price_ratio_daily",
    "/annual-price-ratios/": "price_ratio_annual",
    "/daily-quotes/": "price_daily",
    "/dividend/": "dividend",
    "/corporate-actions/": "corporate_action",
    "/shareholdings/distribution/": "shareholding",
    "/index/master": "index_master",
    "/index/quote": "index_quote_daily",
    "/index/price-returns": "index_return",
}


ARCHIVE_ONLY = "archive_only"


def route():
    """The target table of an endpoint, `archive_only` for one without a normaliser."""
    out = F.lit(ARCHIVE_ONLY)
    for part, table in sorted(ROUTES.items(), key=lambda kv: len(kv[0])):
        out = F.when(F.col("endpoint").contains(part), table).otherwise(out)
    return out


# The field of a payload that holds its entries, by target table.
CONTAINERS = {
    "statement": "financials",
    "basic_financial": "ratios",
    "ratio": "ratios",
    "metric": "financial_metrics",
    "price_ratio_daily": "price_ratios",
    "price_ratio_annual": "price_ratios",
    "price_daily": "price",
    "dividend": "dividend",
    "shareholding": "distributions",
}


def listed_entries(target: Column, parsed: Column) -> Column:
    """How many entries lie in the list that a parsed payload's container is, NULL where it is none.

    Elements are taken as booleans, so that none of them is built: what is no boolean counts as well.
    """
    listed = F.lit(None).cast("int")
    for table, name in CONTAINERS.items():
        listed = F.when(target == table, F.array_size(F.try_variant_get(parsed, f"$.{name}", "array<boolean>"))).otherwise(listed)
    return listed


def held_entries(target: Column) -> Column:
    """The part of a payload that holds its entries, NULL where it lacks its container."""
    container = F.lit(None).cast("string")
    for table, name in CONTAINERS.items():
        container = F.when(target == table, f"$.{name}").otherwise(container)
    return F.when(container.isNull(), F.col("payload")).otherwise(F.call_function("get_json_object", F.col("payload"), container))


def entry_count(target: Column, held: Column) -> Column:
    """How many entries a payload holds for its normaliser; 0 where it is no JSON of the right shape.

    Elements of an array, keys with a value of an object, symbols with figures of a quote map, elements of all lists of a map
    of corporate actions; a profile is one entry. `held` is a column of its own, or its text would be cut out at every use.
    """
    values = F.filter(F.map_values(F.from_json(held, "map<string,string>")), lambda v: v.isNotNull())
    by_shape = (
        F.when(F.ltrim(held).startswith("["), F.json_array_length(held))
        .when(target == "quote", F.size(F.filter(values, lambda v: v.startswith("{"))))
        .when(target == "company_profile", F.least(F.size(values), F.lit(1)))
        .when(
            target == "corporate_action",
            F.aggregate(values, F.lit(0), lambda n, v: n + F.coalesce(F.json_array_length(v), F.lit(0))),
        )
        .otherwise(F.size(values))
    )
    return F.greatest(F.coalesce(by_shape, F.lit(0)), F.lit(0)).cast("bigint")


REASONS = ("empty", "not JSON", "no entries")


def _judged(landing: DataFrame) -> DataFrame:
    """Landed rows with their target, the number of entries `n`, and why a normaliser can take nothing from them, if so.

    A payload is empty, no JSON, or without entries. Payloads without a normaliser have no fault: they are kept as they came.
    """
    target, payload, parsed = F.col("target"), F.col("payload"), F.col("_parsed")
    blank = F.coalesce(F.trim(payload), F.lit("")) == ""
    once = landing.withColumn("target", route()).withColumn(
        "_parsed", F.when((target != ARCHIVE_ONLY) & ~blank, F.try_parse_json(payload))
    ).withColumn("_listed", listed_entries(target, parsed))
    # Texts are cut out and read again only where entries are no list.
    other = parsed.isNotNull() & F.col("_listed").isNull()
    counted = once.withColumn("_held", F.when(other, held_entries(target))).withColumn(
        "n", F.coalesce(F.col("_listed").cast("bigint"), entry_count(target, F.col("_held")))
    )
    empty, not_json, no_entries = REASONS
    fault = (
        F.when(target == ARCHIVE_ONLY, F.lit(None).cast("string"))
        .when(blank, empty)
        .when(parsed.isNull(), not_json)
        .when(F.col("n") == 0, no_entries)
    )
    return counted.withColumn("reason", fault).drop("_parsed", "_listed", "_held")


def rejects(landing: DataFrame) -> DataFrame:
    """The landed rows that normalisation yields nothing for, with their target and the reason."""
    return _judged(landing).where(F.col("reason").isNotNull()).drop("payload", "n")


def payload_account(landing: DataFrame) -> DataFrame:
    """Payloads per target: all, taken, rejected by reason, and their entries. Nothing lands without being counted."""
    taken = F.col("reason").isNull()
    return _judged(landing).groupBy("target").agg(
        F.count("*").alias("payloads"),
        F.count_if(taken).alias("taken"),
        *[F.count_if(F.col("reason") == r).alias(r.lower().replace(" ", "_")) for r in REASONS],
        F.sum(F.when(taken & (F.col("target") != ARCHIVE_ONLY), F.col("n")).otherwise(0)).alias("entries"),
    )


def write_landing(landing: DataFrame, folder: str) -> None:
    """Landed rows as compressed JSON lines. A file is read by one task, so there should be as many as tasks.

    Compressed as fast as gzip can: its usual level takes longer than making the payloads and saves a fifth of the bytes.
    """
    landing.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(folder)


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines under a landing folder, with an explicit schema."""
    return spark.read.schema(LANDING_SCHEMA).json(folder)


def routed(landing: DataFrame, table: str) -> DataFrame:
    """The landed rows of one target table."""
    return landing.where(route() == table)
