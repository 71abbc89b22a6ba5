"""Information-theoretic sanitisation of personal data, in built-in functions only.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers. Each distinct value is a protected
entity, and so are the parts that values share: local part and domain of an e-mail address, a telephone number without its
last four digits. A word that co-occurs with an entity reveals it by their pointwise mutual information, measured against the entity's
own information content: PMI(word; entity) / IC(entity), which is 1 where the word never occurs without the entity. In
documents that hold the entity, words at or above REMOVE are deleted and words at or above GENERALISE become a general
label; both are spans of kind `term`. Everything else stays.

Counts cover all documents. Copies of a text are no evidence: documents with the same set of words count once in every
count, and an entity whose documents share more than OVERLAP of their words on average is left out. A pair
needs SUPPORT mentions whose texts differ in the least hash of their words, which copies with small changes mostly share;
that decides on support alone and enters no score. Word frequencies are counted only if some pair has that support; no other word can be
revealing.

Matches are located by splitting a text at them: the lengths of parts and matches add up to positions. The patterns are
rewritten so that Java's engine runs them in linear time without recursion: a run is entered at its start only, and
quantifiers that never need to give back are possessive.

Scale: base spans are found once and stored beside the numbered rows; only documents with an entity are joined with what
reveals it. Counts are partial aggregates, and a hot entity is one key of a join whose large side Spark may split. Terms of an entity stay rows and are joined as (entity, term), so no list grows
with an entity's documents.

Defined results: null text is empty and has no spans; long texts are scanned whole; repeated rows get the same spans; an
empty table gives an empty table; a document's own columns stay in `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight.llm.common import Steps, let, with_row

KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
GENERAL, GENERALISE, REMOVE, SUPPORT, OVERLAP = "[TERM]", 0.85, 0.95, 3, 0.5

# \G continues right after the match before, where a run may begin that no lookbehind would accept.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}"
CARD = r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
WORD = r"\p{L}+"
_SPAN = "array<struct<start:int,end:int,value:string>>"


def located(body: Column, pattern: str) -> Column:
    """All matches of a pattern, left to right, as (start, end, value) in code points."""

    def places(parts: Column, values: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(F.slice(parts, 1, F.size(values)).alias("part"), values.alias("value")),
            F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("spans")),
            lambda s, p: let(
                s["at"] + F.length(p["part"]),
                lambda start: F.struct(
                    (start + F.length(p["value"])).alias("at"),
                    F.concat(
                        F.coalesce(s["spans"], F.array().cast(_SPAN)),
                        F.array(F.struct(start.alias("start"), (start + F.length(p["value"])).alias("end"), p["value"].alias("value"))),
                    ).alias("spans"),
                ),
            ),
            lambda s: s["spans"],
        )

    none = F.array().cast(_SPAN)
    values = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(F.coalesce(places(F.split(body, pattern, -1), v), none)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.filter(F.split(_digits(value), ""), lambda d: d != ""))

    def worth(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(body: Column) -> Column:
    """A struct of four arrays of (start, end, value), by kind."""
    none = F.array().cast(_SPAN)
    many = lambda v: F.length(_digits(v))
    found = {
        "email": F.when(body.contains("@"), located(body, EMAIL)).otherwise(none),
        "ip": F.filter(located(body, IP), lambda s: s["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": F.filter(located(body, CARD), lambda s: _luhn(s["value"])),
        "phone": F.when(body.contains("+"), F.filter(located(body, PHONE), lambda s: many(s["value"]).between(8, 15))).otherwise(none),
    }
    return F.struct(*[found[k].alias(k) for k in KINDS])


def _tagged(spans: Column, kind: str, label: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), label.alias("label")))


def _all_base(base: Column) -> Column:
    return F.concat(*[_tagged(base[k], k, F.lit(LABELS[k])) for k in KINDS])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(body: Column, spans: Column) -> Column:
    """The text with every span replaced by its label; of overlapping spans the first label stands for all."""
    pieces = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(body, a["at"] + 1, s["start"] - a["at"]), s["label"])).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(body, a["at"] + 1, F.length(body)))), ""),
    )
    return F.when(F.size(spans) == 0, body).otherwise(pieces)


def _entities(base: Column) -> Column:
    """Distinct values of a text, and the parts of them that other values may share."""
    low, digits = lambda s: F.lower(s["value"]), lambda s: _digits(s["value"])
    named = {
        "email": ("email", low), "ip": ("ip", low), "card": ("card", digits), "phone": ("phone", digits),
        "local": ("email", lambda s: F.substring_index(low(s), "@", 1)),
        "domain": ("email", lambda s: F.substring_index(low(s), "@", -1)),
        "prefix": ("phone", lambda s: F.regexp_replace(digits(s), "[0-9]{4}$", "")),
    }
    part = lambda n, f: lambda s: F.concat(F.lit(f"{n}:"), f(s))
    return F.array_distinct(F.concat(*[F.transform(base[k], part(n, f)) for n, (k, f) in named.items()]))


def _words(body: Column) -> Column:
    """Distinct lower-cased words of three letters or more, without those of e-mail addresses (no other base span has letters)."""
    blank = F.when(body.contains("@"), F.regexp_replace(body, EMAIL, " ")).otherwise(body)
    return F.array_distinct(F.filter(F.split(F.lower(blank), r"\P{L}+"), lambda w: F.length(w) >= 3))


def _word_set(terms: Column) -> Column:
    """Equal for texts with the same words, in any order; words have letters only, so the joined list names the set."""
    return F.md5(F.array_join(F.array_sort(terms), " ").cast("binary"))


def based(docs: DataFrame, steps: Steps, text: str = "text") -> DataFrame:
    """(row, rid, base, holds, body): rows numbered and stored once with their base spans, and whether they have any."""
    rows = with_row(docs, text).select("row", "rid", base_spans(F.col("body")).alias("base"))
    any_span = F.greatest(*[F.size(F.col("base")[k]) for k in KINDS]) > 0
    stored = steps.save(rows.withColumn("holds", any_span), "rows")
    return stored.withColumn("body", F.coalesce(F.col("row")[text].cast("string"), F.lit("")))


# Row numbers or terms up to this number are sent to all tasks; more are joined by shuffle.
SENT_ROWS = 1 << 20
# Words of an entity's documents that one task pairs with entities.
PAIRED_WORDS = 1 << 20


def revealing_terms(rows: DataFrame, steps: Steps) -> DataFrame | None:
    """(rid, removed, generalised) for documents that hold an entity and words that reveal it; None if there are none."""
    holders = steps.save(
        rows.where("holds").select("rid", _entities(F.col("base")).alias("entities"), _words(F.col("body")).alias("terms")),
        "holders",
    )
    paired = holders.agg(F.sum(F.size("entities").cast("long") * F.size("terms")).alias("n")).first()["n"] or 0
    sketch = F.array_min(F.transform("terms", lambda w: F.xxhash64(w)))
    mentions = holders.select("rid", _word_set(F.col("terms")).alias("words"), F.explode("entities").alias("entity"))
    first = mentions.groupBy("entity", "words").agg(F.min("rid").alias("rid"))
    held = first.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= SUPPORT)
    pairs = first.join(held, "entity").select("entity", "n_entity", "rid").distinct()
    # Few bytes become many rows here, so the number of tasks follows the rows.
    spread = pairs.join(holders.select("rid", "terms"), "rid").repartition(1 + paired // PAIRED_WORDS, "rid", "entity")
    together = steps.save(
        spread.select("entity", "n_entity", sketch.alias("sketch"), F.explode("terms").alias("term"))
        .groupBy("entity", "n_entity", "term", "sketch").agg(F.count("*").alias("n"))
        .groupBy("entity", "n_entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_apart")),
        "together",
    )
    # The mean share of words that two of the entity's documents have in common.
    n = F.col("n_both")
    shared = F.sum(n * (n - 1)) / ((F.max("n_entity") - 1) * F.sum(n))
    apart = together.groupBy("entity").agg(shared.alias("shared")).where(F.col("shared") <= OVERLAP).select("entity")
    joint = steps.save(together.where(F.col("n_apart") >= SUPPORT).join(apart, "entity"), "joint")
    if joint.isEmpty():
        return None
    worded = rows.select("rid", _words(F.col("body")).alias("terms"))
    sets = steps.save(worded.select("rid", _word_set(F.col("terms")).alias("words")), "sets")
    texts = steps.save(sets.groupBy("words").agg(F.min("rid").alias("rid")).select("rid"), "texts")
    copies = steps.save(sets.select("rid").join(texts.hint("merge"), "rid", "left_anti"), "copies")
    # Copies go and unwanted words go before any shuffle, unless there are too many of either to send to all tasks.
    wanted = steps.save(joint.select("term").distinct(), "wanted")
    sent = lambda df: F.broadcast(df) if df.count() <= SENT_ROWS else df.hint("merge")
    once = worded.join(sent(copies), "rid", "left_anti").select(F.explode("terms").alias("term"))
    terms = once.join(sent(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    total = texts.agg(F.count("*").alias("n")).scalar()
    scored = joint.join(terms, "term").withColumn("n", total).select(
        "entity", "term",
        (F.log2(F.col("n_both") * F.col("n") / F.col("n_entity") / F.col("n_term")) / F.log2(F.col("n") / F.col("n_entity"))).alias("d"),
    )
    strong = steps.save(scored.where(F.col("d") >= GENERALISE), "strong")
    held = holders.select("rid", "terms", F.explode("entities").alias("entity")).join(strong.select("entity").distinct(), "entity", "left_semi")
    own = lambda c, which: F.collect_set(F.when(which, F.col("term"))).alias(c)
    return steps.save(
        held.select("rid", "entity", F.explode("terms").alias("term")).join(strong, ["entity", "term"])
        .groupBy("rid").agg(own("removed", F.col("d") >= REMOVE), own("generalised", F.col("d") < REMOVE)),
        "revealing",
    )


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, base, spans, clean): base spans by kind, all spans (kind, start, end, label), and the sanitised text."""
    steps = Steps(docs.sparkSession, "sanitise")
    rows = based(docs, steps, text)
    revealing = revealing_terms(rows, steps)
    nothing = F.array().cast("array<string>")
    found = rows.withColumns({"removed": nothing, "generalised": nothing})
    if revealing is not None:
        # Only documents with an entity can hold a word that reveals one; the others pass no shuffle.
        told = rows.where("holds").join(revealing, "rid", "left")
        found = found.where(~F.col("holds")).unionByName(told.withColumns({c: F.coalesce(c, nothing) for c in ("removed", "generalised")}))
    base = F.col("base")
    inside = lambda s: F.exists(_all_base(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    is_term = lambda s, c: F.array_contains(F.col(c), F.lower(s["value"]))
    terms = F.when(
        F.size("removed") + F.size("generalised") > 0,
        F.transform(
            F.filter(located(F.col("body"), WORD), lambda s: (is_term(s, "removed") | is_term(s, "generalised")) & ~inside(s)),
            lambda s: F.struct(
                F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                F.when(is_term(s, "removed"), "").otherwise(GENERAL).alias("label"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,label:string>>"))
    return (
        found.withColumn("spans", F.concat(_all_base(base), terms))
        .select("row", "base", F.slice("spans", 1, F.size(_all_base(base))).alias("base_list"), "spans", redacted(F.col("body"), F.col("spans")).alias("clean"))
    )
