"""Company search over stored postings: which companies hold a string of up to three characters in symbol or name.

A term of more characters is looked up by all of its trigrams; companies that have every one of them in one text are
candidates, of which `pages.search` keeps and ranks the real matches. Postings lie in buckets of the gram and companies in
buckets of the symbol, so a search reads the buckets of its grams and of its candidates and nothing else. The index is
maintained like any other table: a changed company touches the buckets of its own grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselight.operators.buckets import Layout, Tables, Write
from bourselight.plans import pages

GRAM = 3
TEXTS = ("symbol", "name")


def grams_of(text: Column) -> Column:
    """Distinct strings of up to three characters within a text, in upper case."""
    upper = F.upper(text)

    def of_size(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(upper) - n + 1), lambda i: F.substring(upper, i, F.lit(n)))
        return F.when(F.length(upper) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_size(n) for n in range(1, GRAM + 1)]))


def postings(company: DataFrame) -> DataFrame:
    """(gram, symbol, text) of every company."""
    held = [company.select(F.explode(grams_of(F.col(t))).alias("gram"), "symbol", F.lit(t).alias("text")) for t in TEXTS]
    return held[0].unionByName(held[1])


def build(spark: SparkSession, path: str, company: DataFrame, buckets: int = 32) -> Tables:
    index = Tables(spark, path, {"posting": Layout(("gram",), buckets), "company": Layout(("symbol",), buckets)})
    index.commit(posting=Write(postings(company)), company=Write(company))
    return index


def candidates(index: Tables, term: str) -> DataFrame:
    """Symbols of the companies that hold all grams of a term in one text."""
    wanted = index.spark.range(1).select(F.upper(F.lit(term.strip())).alias("t"))
    size = F.least(F.length("t"), F.lit(GRAM))
    grams = wanted.select(F.explode(F.filter(grams_of(F.col("t")), lambda g: F.length(g) == size)).alias("gram"))
    found = [r.gram for r in grams.collect()]  # as many as the term has characters
    held = index.holding("posting", grams).where(F.col("gram").isin(found))
    full = held.groupBy("symbol", "text").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(found))
    return full.select("symbol").distinct()


def search(index: Tables, quote: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """The same rows as `pages.search` over all companies."""
    if not term.strip():
        return pages.search(index.read("company").limit(0), quote, term, limit)
    hits = candidates(index, term)
    few = index.holding("company", hits).join(hits, "symbol", "left_semi")
    return pages.search(few, quote, term, limit)
