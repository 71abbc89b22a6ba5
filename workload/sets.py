"""Set operations on keys and field names."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselight.operators import classify
from bourselight.plans import quality
from workload.aggregates import FIELD_SETS, reported_lines
from workload.damage import FEED, feed
from workload.registry import query


@query(
    "o01_key_differences",
    f"""WITH feed AS ({FEED})
SELECT 'quote only' AS side, symbol FROM (SELECT symbol FROM feed EXCEPT SELECT symbol FROM company)
UNION ALL SELECT 'not quoted', symbol FROM (SELECT symbol FROM company EXCEPT SELECT symbol FROM feed)
UNION ALL SELECT 'orphan member', symbol FROM (SELECT symbol FROM constituents EXCEPT SELECT symbol FROM company)""",
)
def o01(t):
    keys, known = feed(t), t.company
    sides = {
        "quote only": quality.outside(keys, known),
        "not quoted": quality.outside(known, keys),
        "orphan member": quality.outside(t.constituents, known),
    }
    frames = [df.select(F.lit(side).alias("side"), "symbol") for side, df in sides.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "o02_codes_quoted_twice",
    f"""WITH feed AS ({FEED}) SELECT symbol FROM feed WHERE regexp_full_match(symbol, '[0-9]+')
  AND symbol NOT IN (SELECT symbol FROM company) INTERSECT SELECT bse_code FROM company""",
)
def o02(t):
    return quality.quoted_twice(feed(t), t.company)


@query(
    "o03_key_unions",
    """SELECT symbol FROM constituents WHERE index_symbol IN ('NIF50', 'BSE500')
UNION SELECT symbol FROM constituents WHERE index_symbol IN ('NIF100')""",
)
def o03(t):
    broad = t.constituents.where(F.col("index_symbol").isin("NIF50", "BSE500")).select("symbol")
    large = t.constituents.where(F.col("index_symbol") == "NIF100").select("symbol")
    return broad.union(large).distinct()


# Field names of the two largest families that the test figures use.
_KNOWN = ", ".join(f"'{f}'" for f in classify.KNOWN_FIELDS["general"])


@query(
    "o04_unknown_fields",
    f"""SELECT symbol, string_agg(field_name, ',' ORDER BY field_name) AS unmapped FROM (
  SELECT symbol, unnest(string_split(fields, ',')) AS field_name FROM ({FIELD_SETS}))
WHERE field_name NOT IN ({_KNOWN}) GROUP BY symbol""",
)
def o04(t):
    found = classify.families(reported_lines(t))
    unmapped = F.array_sort(classify.unknown_fields(F.col("fields"), F.col("kind")))
    return found.select("symbol", F.array_join(unmapped, ",").alias("unmapped")).where(F.col("unmapped") != "")


@query(
    "o05_discriminating_fields",
    """SELECT symbol, string_agg(field_name, ',' ORDER BY field_name) AS fields FROM (
  SELECT DISTINCT symbol, CASE field_name WHEN 'assets' THEN 'eps' WHEN 'reserves' THEN 'income' ELSE field_name END
    AS field_name FROM lines)
WHERE field_name NOT IN ('eps', 'income', 'period_start', 'period_end', 'result_date', 'year') GROUP BY symbol""",
)
def o05(t):
    name = F.col("field_name")
    renamed = F.when(name == "assets", "eps").when(name == "reserves", "income").otherwise(name)
    sets = classify.field_sets(t.lines.withColumn("field_name", renamed))
    kept = F.array_sort(classify.signature(F.col("fields")))
    return sets.select("symbol", F.array_join(kept, ",").alias("fields"))


# What companies of two further families report in place of the fields of the tables, by the remainder of their number.
_RENAMED = {
    1: {"expenses": "interestExpended", "profitBeforeTax": "cET1Ratio", "taxExpense": "eps"},
    2: {"assets": "premiumEarned", "reserves": "combinedRatio", "equityCapital": "netPremiumIncome"},
}
_RENAMED_SQL = " ".join(
    f"WHEN CAST(symbol AS BIGINT) % 3 = {rest} AND field_name = '{old}' THEN '{new}'"
    for rest, fields in _RENAMED.items() for old, new in fields.items()
)
_MARKER_SQL = {
    "general": "'revenueFromOperations', 'financeCosts'", "bank": "'interestExpended', 'cET1Ratio'",
    "life_insurance": "'netPremiumIncome'", "general_insurance": "'premiumEarned', 'combinedRatio'",
}


@query(
    "o06_marker_overlap",
    "SELECT symbol, "
    + ", ".join(f"count(DISTINCT field_name) FILTER (WHERE field_name IN ({m})) AS {f}_hits" for f, m in _MARKER_SQL.items())
    + f" FROM (SELECT symbol, CASE {_RENAMED_SQL} ELSE field_name END AS field_name FROM lines WHERE value IS NOT NULL) GROUP BY symbol",
)
def o06(t):
    name, rest = F.col("field_name"), F.col("symbol").cast("bigint") % 3
    renamed = name
    for remainder, fields in _RENAMED.items():
        for old, new in fields.items():
            renamed = F.when((rest == remainder) & (name == old), new).otherwise(renamed)
    sets = classify.field_sets(reported_lines(t).withColumn("field_name", renamed))
    hits = [classify.marker_hits(F.col("fields"), f).cast("bigint").alias(f"{f}_hits") for f in _MARKER_SQL]
    return sets.select("symbol", *hits)
