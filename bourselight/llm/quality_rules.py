"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

`features` measures a text, `compile_rules` turns rows of the threshold table into one verdict column. No user function,
no shuffle: the plan is a scan and a projection, so it grows with the input alone and a lost task costs one split.

Defined results: a null or blank text has no words and fails; very long texts are measured whole; repeated rows are
judged alike; an empty table gives an empty table; columns of `docs` that carry a feature's name are left alone, as
features live in one struct of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselight.llm.common import SPACE, let

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to a in is that for it was on with be as by this are at from or an not have",
    "de": "der die und in den von zu das sich mit auf des für ist nicht im dem ein eine als auch es an",
    "fr": "de la le et les des en un du une que pour est qui dans par pas au sur plus se ne ce",
    "es": "de la que el en y los se del las por un no con su una es para al como más o lo",
}


class Rule(NamedTuple):
    """A measure has to lie within [low, high]; None leaves a side open. `per` divides it by another measure first."""

    measure: str
    per: str | None
    low: float | None
    high: float | None


# Length, symbols, stop words and lines. Lenient by design: prose in any of the four languages passes each by a margin.
RULES = (
    Rule("n_words", None, 50, 1_000_000),
    Rule("word_chars", "n_words", 2.5, 12.0),
    Rule("n_symbols", "n_words", None, 0.2),
    Rule("n_stop_words", "n_words", 0.03, None),
    Rule("n_dup_lines", "n_lines", None, 0.5),
    Rule("n_bullet_lines", "n_lines", None, 0.9),
    Rule("n_ellipsis_lines", "n_lines", None, 0.5),
    Rule("n_letter_words", "n_words", 0.6, None),
)


def _repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that occur twice or more in the text, the first occurrence included.

    Windows are first compared by hash: a text without equal hashes has no equal windows. The others sort the windows
    themselves with their positions, so the count is exact. A sorted list of starting positions then gives the union of
    the windows: each adds its width, or the distance from the start before it if that is less.
    """
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - F.lit(width))

    def hashes(w: Column) -> Column:
        """Hashes of all windows, from one hash a word."""
        each = F.transform(w, lambda x: F.xxhash64(x))
        heads = lambda h: F.slice(h, 1, F.size(h) - F.lit(width - 1))
        return let(each, lambda h: F.transform(heads(h), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)])))

    def exact(w: Column) -> Column:
        windows = F.array_sort(F.transform(starts(w), lambda i: F.struct(F.slice(w, i + 1, width).alias("w"), i.alias("i"))))

        def covered(s: Column) -> Column:
            again = F.filter(
                s,
                lambda e, k: (F.get(s, k - 1)["w"].eqNullSafe(e["w"])) | (F.get(s, k + 1)["w"].eqNullSafe(e["w"])),
            )
            places = F.sort_array(F.transform(again, lambda e: e["i"]))
            return let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.when(k == 0, F.lit(width)).otherwise(F.least(F.lit(width), x - F.get(p, k - 1)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            )

        return let(windows, covered)

    def count(w: Column) -> Column:
        many = F.size(w) > width
        return F.when(
            many & let(hashes(w), lambda h: F.size(F.array_distinct(h)) < F.size(h)), exact(w)
        ).otherwise(F.lit(0))

    return let(words, count)


def features(text: Column) -> Column:
    """All measures of a text as one struct of whole numbers."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    stop_words = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    # One mark at the end of a word is no part of it.
    bare = F.split(F.regexp_replace(F.lower(body), rf"[.,;:!?](?={SPACE}|\z)", ""), f"{SPACE}+")

    def of(words: Column, lines: Column) -> Column:
        size = lambda c: F.size(c).cast("long")
        return F.struct(
            size(words).alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (size(lines) - size(F.array_distinct(lines))).alias("n_dup_lines"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
            size(lines).alias("n_lines"),
            size(F.filter(bare, lambda w: w.isin(stop_words))).alias("n_stop_words"),
            size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).alias("n_letter_words"),
            size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-•*·]"))).alias("n_bullet_lines"),
            size(F.filter(lines, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
        )

    words = F.filter(F.split(body, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.struct(words.alias("w"), lines.alias("l")), lambda p: of(p["w"], p["l"]))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def compile_rules(f: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The threshold table as one boolean column: every rule holds. A ratio over nothing counts as 0."""
    verdict = F.lit(True)
    for rule in rules:
        value = f[rule.measure].cast("double")
        if rule.per:
            value = F.when(f[rule.per] > 0, value / f[rule.per]).otherwise(F.lit(0.0))
        if rule.low is not None:
            verdict = verdict & (value >= F.lit(float(rule.low)))
        if rule.high is not None:
            verdict = verdict & (value <= F.lit(float(rule.high)))
    return verdict


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(row, f, base_failed, kept): each document as one value, its measures and the verdict."""
    measured = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), features(F.col(f"`{text}`")).alias("f")
    )
    return measured.select(
        "row", "f", base_failed(F.col("f")).alias("base_failed"),
        (~base_failed(F.col("f")) & compile_rules(F.col("f"), rules)).alias("kept"),
    )
