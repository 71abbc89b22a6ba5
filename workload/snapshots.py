"""The whole snapshot: every catalog column filled and compared.

The given tables fill about half of the columns. Here each raw field that they lack comes as a copy of one they have, of the
same source, so that every column is built by its own catalog entry from its own field.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselight import catalog
from bourselight.plans import snapshot
from bourselight.sources.testbed import AS_OF, BASIC_FIELDS, METRIC_FIELDS, RATIO_FIELDS, STATEMENT_FIELDS
from workload.pipelines import SNAPSHOT_COLUMNS, SNAPSHOT_TEXTS
from workload.registry import names, query, r6, rounded

# Source of catalog columns -> input of the snapshot, its column of groups, and the fields that the tables fill.
_SOURCES = {
    "statement": ("lines", "statement_code", STATEMENT_FIELDS),
    "basic": ("basics", "statement_code", BASIC_FIELDS),
    "ratio": ("ratios", "family", RATIO_FIELDS),
    "metric": ("metrics", "family", METRIC_FIELDS),
}
_UNIT_SQL = {"crore": "* 1e-7", "percent": "* 100", "price": "* 1e-7", "ratio": "", "days": ""}
# Rupees are copied as crores where a column takes figures per share.
_PER_SHARE = 1e-7


def _copies(source: str) -> list[tuple[catalog.CatalogColumn, str, str]]:
    """(column, group to copy from, field to copy from) of the columns whose fields the tables lack."""
    fields = _SOURCES[source][2]
    lacking = [e for e in catalog.of_source(source) if not set(e.fields) & set(fields.get(e.group, ()))]
    out = []
    for i, entry in enumerate(lacking):
        group = entry.group if entry.group in fields else sorted(fields)[0]
        out.append((entry, group, sorted(fields[group])[i % len(fields[group])]))
    return out


def _filled(t, source: str):
    """A long source with copies of its rows under the fields it lacks."""
    table, group, _ = _SOURCES[source]
    rows = getattr(t, table)
    copies = F.array(
        *[
            F.struct(
                F.lit(g).alias("g"), F.lit(f).alias("f"), F.lit(e.group).alias("to_g"), F.lit(e.fields[0]).alias("to_f"),
                F.lit(_PER_SHARE if e.unit == "price" else 1.0).alias("factor"),
            )
            for e, g, f in _copies(source)
        ]
    )
    own = F.filter(copies, lambda c: (c["g"] == F.col(group)) & (c["f"] == F.col("field_name")))
    copied = rows.withColumn("_to", F.explode(own)).withColumns(
        {group: F.col("_to.to_g"), "field_name": F.col("_to.to_f"), "value": F.col("value") * F.col("_to.factor")}
    )
    return rows.unionByName(copied.drop("_to"))


_LATEST = {"statement": "latest_lines", "basic": "latest_basics", "ratio": "latest_ratios", "metric": "latest_metrics"}
_COPIED = {s: [e.key for e, _, _ in _copies(s)] for s in _SOURCES}


def _copied_sql(source: str) -> str:
    group = _SOURCES[source][1]
    columns = ", ".join(
        f"max(value) FILTER (WHERE {group} = '{g}' AND field_name = '{f}') {_UNIT_SQL[e.unit]} AS {e.key}"
        for e, g, f in _copies(source)
    )
    return f"(SELECT symbol, {columns} FROM {_LATEST[source]} GROUP BY symbol) AS x_{source}"


_EXTRA = [f"round(x_{s}.{k}, 6) AS {k}" for s, keys in _COPIED.items() for k in keys]


@query(
    "p30_snapshot_every_column",
    f"SELECT s.symbol, {names(SNAPSHOT_TEXTS)}, CASE WHEN CAST(s.symbol AS BIGINT) % 3 = 0 THEN 'bank' END AS schema_kind, "
    f"{r6(*SNAPSHOT_COLUMNS)}, {', '.join(_EXTRA)} FROM snapshot s "
    + " ".join(f"LEFT JOIN {_copied_sql(s)} ON x_{s}.symbol = s.symbol" for s in _SOURCES),
)
def p30(t):
    inputs = t.snapshot_inputs(F.lit(AS_OF).cast("date"))
    inputs.update({_SOURCES[s][0]: _filled(t, s) for s in _SOURCES})
    bank = F.when(F.col("symbol").cast("bigint") % 3 == 0, "bank")
    inputs["company"] = inputs["company"].withColumn("schema_kind", bank)
    built = snapshot.build(**inputs)
    assert set(built.columns) == {"symbol", "schema_kind", *SNAPSHOT_TEXTS, *SNAPSHOT_COLUMNS, *(k for ks in _COPIED.values() for k in ks)}
    return rounded(built)
