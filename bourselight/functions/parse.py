"""Cleaning rules for landed text: dates, numbers, blanks, labels, hashes.

Every function maps columns to a column of built-in expressions, so the rules stay inside code generation.
The central rule is that a missing figure is NULL and never zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal number with thousands commas and perhaps a percent sign. A cast alone would also take "5d", "NaN" and "inf".
NUMBER_SHAPE = r"^\s*([+-]?[\d,]*\.?[\d,]*(?:[eE][+-]?\d+)?)\s*%?\s*$"

# Last path parts of calls that cover the whole universe.
UNIVERSE_TAILS = (
    "all", "master", "historical", "daily-feed", "price-returns", "quote", "stock-symbols",
    "stock-search", "results-calendar", "ipo-calendar", "holidays-calendar", "corp-announcements",
    "credit-ratings", "investor-call-transcripts", "investor-presentations", "refreshed-stocks",
    "commodity-list", "name-changes", "symbol-changes",
)

MESSAGE_LENGTH = 4000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: Column | str) -> Column:
    """ISO date, ISO date-time, `yyyymmdd` or `d-Mon-yyyy` to DATE; anything else, or a day that
    does not exist, to NULL."""
    text = F.trim(_col(c).cast("string"))
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
        .when(
            text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"),
            F.substring(text, 1, 10).try_cast("date"),
        )
        .when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
        .when(text.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), F.try_to_date(text, "d-MMM-yyyy"))
    )


def parse_number(c: Column | str) -> Column:
    """Text to DOUBLE. Thousands commas and one trailing percent sign are dropped.

    Blanks, "-", "NA", "N/A", "null" and all else that is no decimal number become NULL. The input occurs once in
    the expression, so each landed figure is matched once.
    """
    matched = F.regexp_extract(_col(c).cast("string"), NUMBER_SHAPE, 1)
    return F.translate(matched, ",", "").try_cast("double")


def parse_percent(c: Column | str) -> Column:
    """"0.28%" to 0.28."""
    return parse_number(F.translate(_col(c).cast("string"), "%", ""))


def clean_text(c: Column | str) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(_col(c).cast("string")), F.lit(""))


def positive_or_null(c: Column | str) -> Column:
    """A price or a size at or below zero is an absent figure."""
    return F.when(_col(c) > 0, _col(c))


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(0.0))


def to_int(c: Column | str) -> Column:
    """Whole part of a number in text; NULL where it is beyond an INT, so that one bad year costs its own row only."""
    return parse_number(c).try_cast("int")


def header_or_period_end(header: Column | str, period_end: Column | str) -> Column:
    """The period header, or "Mar 2026" made from the period end where it is absent."""
    given = F.nullif(_col(header), F.lit(""))
    return F.coalesce(given, F.date_format(_col(period_end), "MMM yyyy"))


def label_month(c: Column | str) -> Column:
    """"Jun 2026" to the first day of that month; a label of another shape sorts before all."""
    text = _col(c)
    parsed = F.when(text.rlike(r"^[A-Z][a-z]{2} \d{4}$"), F.try_to_date(text, "MMM yyyy"))
    return F.coalesce(parsed, F.lit("0001-01-01").cast("date"))


def fold(c: Column | str) -> Column:
    return F.upper(_col(c))


def text_normal_form(c: Column | str) -> Column:
    """Lower case with single spaces, as a stable cache key."""
    return F.lower(F.regexp_replace(F.trim(_col(c)), r"\s+", " "))


def text_hash(c: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the normal form."""
    return F.substring(F.sha2(text_normal_form(c), 256), 1, 16)


def redact(c: Column | str, length: int | None = None) -> Column:
    """Hide the value after `token=`. A log sink that stores at most so many characters passes MESSAGE_LENGTH."""
    hidden = F.regexp_replace(_col(c), r"(token=)[^&\s]+", "$1REDACTED")
    return hidden if length is None else F.substring(hidden, 1, length)


def canonical_params(params: Column | str) -> Column:
    """Compact JSON of a string map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(params)))))


def params_hash(params: Column | str) -> Column:
    return F.sha2(canonical_params(params), 256)


def content_hash(payload: Column | str) -> Column:
    return F.sha2(_col(payload), 256)


def symbol_of_endpoint(endpoint: Column | str) -> Column:
    """Last part of an `/api/v1/<call>/<symbol>` path, blank for a call on the whole universe."""
    path = _col(endpoint)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    tail = F.try_element_at(parts, F.lit(-1))
    named = (
        (F.size(parts) >= 4)
        & (F.try_element_at(parts, F.lit(1)) == "api")
        & (F.try_element_at(parts, F.lit(2)) == "v1")
        & ~tail.isin(*UNIVERSE_TAILS)
    )
    return F.when(named, tail).otherwise(F.lit(""))
