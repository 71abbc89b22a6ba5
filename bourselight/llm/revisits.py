"""Resolution of not-modified revisits in web archives.

A revisit record of a server's "304 Not Modified" answer has no body. It is joined, as of its time, to the latest earlier
full response of the same canonical URL. If both carry a validator (entity tag, compared weakly, else the last-modified
date) they have to agree; the result then takes the response's status, digest and headers, updated by those headers of
the revisit that a 304 may change (RFC 9111, section 3.2). Nothing is dropped: each revisit comes out with an outcome.

Scale: the as-of join is no range join. Times are cut into minutes and days. Inside (URL, minute) a running last value
finds the response; one row per (URL, minute) and per (URL, day) carries it on, so a hot URL is spread over its minutes and
no task sorts all of its captures. Windows hold numbers and validators only; headers are fetched by row number or record id
in a join whose hot side Spark splits.

Defined results: a null URL or time has no earlier response; records at the same time are ordered by record id; revisits of a
URL without an earlier response are `unresolved`, with differing validators `mismatch`, without common validators
`unvalidated` (merged), else `matched`; null headers count as none; repeated rows and null record ids are resolved each, with
their own headers; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselight.llm.common import Steps

SLICES = (60, 86_400)  # seconds
# Header fields that a 304 answer must not change in a stored response.
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
TRACKING = r"(?:utm_[^=&]*|ref|gclid|fbclid)"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without the scheme's default port, `www.`, fragment and tracking parameters; query sorted.

    A port that is another scheme's default stays, and so does what stands before an @.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    named = F.regexp_replace(F.lower(F.regexp_replace(authority, "^.*@", "")), r"^www\.", "")
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$")
    host = F.concat(user, F.when(port.isNotNull(), F.regexp_replace(named, port, F.lit(""))).otherwise(named))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(?:=|$)")))
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(scheme == "", bare).otherwise(whole)


def lower_keys(headers: Column) -> Column:
    """Header fields by lower-cased name; of repeated names the last in order of the entries counts."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(kept)


def latest_before(events: DataFrame, key: str, at: str, order: Sequence[str], wanted: Column, name: str) -> DataFrame:
    """Adds `name`: the last non-null `wanted` of earlier rows of the same key, by (at, order). `at` is in seconds."""
    minute, day = (F.floor(F.col(at) / s).cast("long") for s in SLICES)
    rows = events.withColumns({"_v": wanted, "_minute": minute, "_day": day})
    past = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.last("_v", True).over(past(key, "_minute").orderBy(at, *order)))
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(at, *order)))
    minutes = rows.where(F.col(key).isNotNull()).groupBy(key, "_day", "_minute").agg(last.alias("_v"))
    minutes = minutes.withColumn("_from_minute", F.last("_v", True).over(past(key, "_day").orderBy("_minute")))
    days = minutes.groupBy(key, "_day").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_minute"))).alias("_v"))
    days = days.withColumn("_from_day", F.last("_v", True).over(past(key).orderBy("_day"))).drop("_v")
    carried = minutes.drop("_v").join(days, [key, "_day"]).select(key, "_minute", F.coalesce("_from_minute", "_from_day").alias("_carried"))
    out = rows.join(carried.hint("merge"), [key, "_minute"], "left")
    return out.withColumn(name, F.when(F.col(key).isNotNull(), F.coalesce("_here", "_carried"))).drop("_v", "_minute", "_day", "_here", "_carried")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url, refers_to, outcome, status, digest, headers) for every revisit record.

    `records` has record_id long, url string, fetched timestamp, kind ('response' or 'revisit'), status int, digest string and
    headers map<string,string>.
    """
    events = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url"),
        F.unix_micros("fetched").alias("micros"), (F.col("kind") == "response").alias("full"), (F.col("kind") == "revisit").alias("again"),
        "status", "digest", lower_keys(F.col("headers")).alias("headers"),
        F.monotonically_increasing_id().alias("_n"),
    )
    # Numbered once and stored: record ids may be null or repeated.
    steps = Steps(records.sparkSession, "revisits")
    events = steps.save(events.where("full or again"), "events")
    tag = F.regexp_replace(F.col("headers")["etag"], "^W/", "")
    narrow = events.select("_n", "record_id", "url", (F.col("micros") / 1e6).alias("at"), "again", "full", tag.alias("tag"), F.col("headers")["last-modified"].alias("modified"))
    stored = F.when(F.col("full"), F.struct("record_id", "tag", "modified"))
    # Rows without a time come after all others in no slice, and so see no earlier response.
    placed = latest_before(narrow.where("again or (at is not null and url is not null)"), "url", "at", ["record_id"], stored, "earlier").where("again")
    old = F.when(F.col("at").isNotNull(), F.col("earlier"))
    outcome = (
        F.when(old.isNull(), "unresolved")
        .when(old["tag"].isNotNull() & F.col("tag").isNotNull(), F.when(old["tag"] == F.col("tag"), "matched").otherwise("mismatch"))
        .when(old["modified"].isNotNull() & F.col("modified").isNotNull(), F.when(old["modified"] == F.col("modified"), "matched").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    found = steps.save(placed.select("record_id", "url", old["record_id"].alias("refers_to"), outcome.alias("outcome"), "_n"), "found")
    own = events.where("again").select("_n", F.col("headers").alias("_new"))
    full = events.where("full").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.any_value("headers").alias("_old"), F.any_value("status").alias("status"), F.any_value("digest").alias("digest")
    )
    told = found.join(own.hint("merge"), "_n")
    # Revisits without an earlier response have no id to join by, and are set apart lest one task gets them all.
    names = ("_old", "status", "digest")
    alone = told.where(F.col("refers_to").isNull()).withColumns({n: F.lit(None).cast(full.schema[n].dataType) for n in names})
    joined = told.where(F.col("refers_to").isNotNull()).join(full.hint("merge"), "refers_to", "left").unionByName(alone)
    ok = F.col("outcome").isin("matched", "unvalidated")
    kept = F.filter(F.map_entries("_old"), lambda e: e["key"].isin(*KEPT_FIELDS) | ~F.map_contains_key("_new", e["key"]))
    new = F.filter(F.map_entries("_new"), lambda e: ~e["key"].isin(*KEPT_FIELDS))
    return joined.select(
        "record_id", "url", F.when(ok, F.col("refers_to")).alias("refers_to"), "outcome",
        F.when(ok, F.col("status")).alias("status"), F.when(ok, F.col("digest")).alias("digest"),
        F.when(ok, F.map_from_entries(F.array_sort(F.concat(kept, new)))).alias("headers"),
    )


def with_body(resolved: DataFrame, records: DataFrame, body: str = "body") -> DataFrame:
    """Adds the stored response's body to resolved revisits."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), body)
    return resolved.join(bodies.hint("merge"), "refers_to", "left")
