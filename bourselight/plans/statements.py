"""Statement tables for all companies at once: type fallback, last periods, derived rows, empty rows dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselight import templates
from bourselight.functions.figures import statement_scale
from bourselight.functions.formulas import FORMULAS
from bourselight.functions.parse import label_month
from bourselight.operators.normalise import PERIOD_KEY
from bourselight.operators.spread import top_n

PERIOD_LIMIT = 16
TABLE_KEY = ("symbol", "statement_code", "period_kind")

# Fixed values.
GROUP_LABELS = {
    "promoterAndPromoterGroup": "Promoters",
    "publicShareholding": "Public",
    "nonPromoterNonPublic": "Non-promoter non-public",
}
RATIO_FAMILIES = {"pr": "profitability", "le": "leverage", "li": "liquidity", "ef": "efficiency"}


def last_periods(periods: DataFrame, limit: int = PERIOD_LIMIT) -> DataFrame:
    """The last periods per symbol, statement, kind and type; `position` 1 is the newest.

    A period without an end date counts as the newest, as it sorts last in ascending order.
    """
    newest = [F.col("period_end").desc_nulls_first(), F.col("header").desc()]
    return top_n(periods, [*TABLE_KEY, "statement_type"], newest, limit)


def with_type_fallback(recent: DataFrame, requested: str = "c") -> DataFrame:
    """Keep the requested statement type where a table has it, otherwise the other type.

    Applied after `last_periods`, so that each group holds at most twice the period limit.
    """
    table = W.partitionBy(*TABLE_KEY)
    has = F.max((F.col("statement_type") == requested).cast("int")).over(table) == 1
    return (
        recent.withColumn("_has", has)
        .where((F.col("statement_type") == requested) == F.col("_has"))
        .drop("_has")
    )


def merged_figures(recent: DataFrame, lines: DataFrame, basics: DataFrame) -> DataFrame:
    """Figures of the shown periods, with derived aggregates filling fields the statement lacks.

    Aggregates exist by year only while their headers also name quarters, so they join annual and trailing
    periods alone. A field that the statement holds wins, also when its value is NULL.
    """
    shown = recent.select(*PERIOD_KEY)
    own = shown.join(lines, list(PERIOD_KEY)).select(*PERIOD_KEY, "field_name", "value", F.lit(0).alias("source"))
    yearly = shown.where(F.col("period_kind").isin("annual", "ttm"))
    derived = yearly.join(
        basics.select("symbol", "statement_type", "statement_code", "header", "field_name", "value"),
        ["symbol", "statement_type", "statement_code", "header"],
    ).select(*PERIOD_KEY, "field_name", "value", F.lit(1).alias("source"))
    both = own.unionByName(derived)
    return both.groupBy(*PERIOD_KEY, "field_name").agg(F.min_by("value", "source").alias("value"))


def field_maps(figures: DataFrame) -> DataFrame:
    """All figures of a period as one map; its size is bounded by the field vocabulary."""
    return figures.groupBy(*PERIOD_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("figures")
    )


def layout_of(family: Column, code: Column) -> Column:
    """The layout name; unknown families and all balance sheets and cash flows take the general one."""
    pl = F.lit(templates.PL_LAYOUTS["general"])
    for name, layout in templates.PL_LAYOUTS.items():
        pl = F.when(family == name, layout).otherwise(pl)
    out = F.when(code == "pl", pl)
    for shared_code, layout in templates.SHARED_LAYOUTS.items():
        out = out.when(code == shared_code, layout)
    return out


def _figure(name: str) -> Column:
    return F.try_element_at("figures", F.lit(name))


def with_derived_rows(maps: DataFrame) -> DataFrame:
    """Add the result of every formula to a period's figures, under the name that the layouts give it.

    A period computes each formula once, and rows of all kinds are then looked up alike.
    """
    derived = F.create_map(
        *[part for name, formula in FORMULAS.items() for part in (F.lit(templates.derived(name)), formula(_figure))]
    )
    return maps.withColumn("figures", F.map_concat("figures", derived))


def figure_maps(lines: DataFrame, basics: DataFrame) -> DataFrame:
    """All figures of every period as one map, derived aggregates filling the fields that the statement lacks.

    As `merged_figures`, in one shuffle: an aggregate counts for the annual and the trailing period of its header, whether
    there is one or not, and the join with the shown periods leaves those that exist.
    """
    own = lines.select(*PERIOD_KEY, "field_name", "value", F.lit(0).alias("source"))
    yearly = basics.withColumn("period_kind", F.explode(F.array(F.lit("annual"), F.lit("ttm"))))
    both = own.unionByName(yearly.select(*PERIOD_KEY, "field_name", "value", F.lit(1).alias("source")))
    entries = both.groupBy(*PERIOD_KEY).agg(F.sort_array(F.collect_list(F.struct("field_name", "source", "value"))).alias("e"))
    # In order of field and source, the first entry of a field counts.
    first = F.filter("e", lambda x, i: (i == 0) | (F.get(F.col("e"), i - 1)["field_name"] != x["field_name"]))
    pairs = F.transform(first, lambda x: F.struct(x["field_name"], x["value"]))
    return entries.select(*PERIOD_KEY, F.map_from_entries(pairs).alias("figures"))


def with_family(placed: DataFrame, company: DataFrame) -> DataFrame:
    """The family of each table in `schema_kind`: that of the oldest shown period, or the company's where that is unknown.

    A table has at most PERIOD_LIMIT periods per type, so the window is small.
    """
    joined = placed.join(company.select("symbol", F.col("schema_kind").alias("_of_company")), "symbol", "left")
    of_period = F.max_by("schema_kind", "position").over(W.partitionBy(*TABLE_KEY, "statement_type"))
    known = joined.withColumn("_of_period", of_period)
    unknown = F.coalesce(F.col("_of_period").isin("", "unknown"), F.lit(True))
    family = F.when(unknown, F.col("_of_company")).otherwise(F.col("_of_period"))
    return known.withColumn("schema_kind", family).drop("_of_period", "_of_company")


def has_data(value: str) -> Column:
    """Whether any figure of a row is present and not zero, as an aggregate over its periods."""
    return F.max(F.coalesce(F.abs(value), F.lit(0.0))) > 0


def _layout(name: str) -> Column:
    """The rows of a layout as a constant array; `up` is the place of the parent row, or of the row itself."""
    rows = templates.layout_rows(name)
    at = {r.ord: i for i, r in enumerate(rows)}
    return F.array(
        *[
            F.struct(
                F.lit(r.ord).alias("ord"), F.lit(r.parent).cast("int").alias("parent"), F.lit(r.label).alias("label"),
                F.lit(r.unit).alias("unit"), F.lit(r.emphasis).alias("emphasis"),
                F.array(*[F.lit(f) for f in r.fields]).alias("fields"), F.lit(at.get(r.parent, i)).alias("up"),
            )
            for i, r in enumerate(rows)
        ]
    )


def _bit(mask: Column, place: Column) -> Column:
    return F.call_function("shiftright", mask, place).bitwiseAND(F.lit(1).cast("bigint")) == 1


def render(maps: DataFrame) -> DataFrame:
    """One row per template row and period, for tables with a `layout` and a `figures` map per period.

    A template row without a non-zero figure in any period of its table is dropped, and so are the children of a dropped
    row. A period computes the rows of its layout as one array, with a bit for each row that has data; the bits of a table's
    periods, of which there are few, are joined by OR before anything is multiplied by rows. A layout has at most 63 rows.
    """
    layout = F.lit(None)
    for name in dict.fromkeys(r.layout for r in templates.ROWS):
        layout = F.when(F.col("layout") == name, _layout(name)).otherwise(layout)

    def value(row: Column) -> Column:
        """Figure of a template row in a period: that of its first present field."""
        fields = [F.try_element_at("figures", F.try_element_at(row["fields"], F.lit(i + 1))) for i in range(templates.MAX_FIELDS)]
        return statement_scale(F.coalesce(*fields), row["unit"])

    def own_bit(v: Column, place: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
        return F.when(F.coalesce(F.abs(v), F.lit(0.0)) > 0, one).otherwise(F.lit(0).cast("bigint"))

    named = [c for c in maps.columns if c not in ("figures", "layout")]
    computed = with_derived_rows(maps).withColumn("_rows", layout).withColumn("_values", F.transform("_rows", value))
    bits = F.aggregate(F.transform("_values", own_bit), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    masked = computed.select(*named, "layout", "_rows", "_values", bits.alias("_bits")).withColumn(
        "_bits", F.bit_or("_bits").over(W.partitionBy(*TABLE_KEY, "statement_type"))
    )
    shown = F.filter(
        F.transform(
            "_rows",
            lambda r, i: F.struct(
                *[r[c].alias(c) for c in ("ord", "parent", "label", "unit", "emphasis")], F.get("_values", i).alias("value"),
                (_bit(F.col("_bits"), i) & _bit(F.col("_bits"), r["up"])).alias("_shown"),
            ),
        ),
        lambda r: r["_shown"],
    )
    return masked.select(*named, "layout", F.inline(shown)).drop("_shown")


def statement_tables(
    periods: DataFrame,
    lines: DataFrame,
    basics: DataFrame,
    company: DataFrame,
    requested: str = "c",
    limit: int = PERIOD_LIMIT,
) -> DataFrame:
    """The full statement query for every symbol, code and period kind."""
    recent = with_type_fallback(last_periods(periods, limit), requested)
    shown = recent.select(*PERIOD_KEY, "position", "result_date", "schema_kind")
    known = with_family(shown.join(figure_maps(lines, basics), list(PERIOD_KEY)), company)
    return render(known.withColumn("layout", layout_of(F.col("schema_kind"), F.col("statement_code"))))


def header_order(header: Column, year: Column) -> Column:
    """Years ascending, the trailing twelve months last."""
    return F.when(header == "TTM", F.lit(1_000_000)).otherwise(F.coalesce(year, F.lit(0)))


def ratio_table(ratios: DataFrame, statement_type: str = "c") -> DataFrame:
    """Ratio families as cells (symbol, family, field, header, order, value), profitability in percent."""
    scale = F.when(F.col("family") == "pr", 100.0).otherwise(1.0)
    return ratios.where(F.col("statement_type") == statement_type).select(
        "symbol",
        "family",
        F.col("field_name").alias("label"),
        F.when(F.col("family") == "pr", "percent").otherwise("ratio").alias("unit"),
        "header",
        header_order(F.col("header"), F.col("year")).alias("header_order"),
        F.round(F.col("value") * scale, 2).alias("value"),
    )


def named_families(cells: DataFrame) -> DataFrame:
    """Ratio cells with the family's name in place of its code; a code without a name keeps it."""
    name = F.col("family")
    for code, family in RATIO_FAMILIES.items():
        name = F.when(F.col("family") == code, family).otherwise(name)
    return cells.withColumn("family", name)


def ratio_family(cells: DataFrame, family: str) -> DataFrame:
    """The cells of one family, by name or code; solvency is another name for leverage."""
    known = {**{n: c for c, n in RATIO_FAMILIES.items()}, **{c: c for c in RATIO_FAMILIES}, "solvency": "le"}
    if family not in known:
        raise ValueError(f"unknown ratio family {family!r}; known are {sorted(known)}")
    return cells.where(F.col("family") == known[family])


def last_quarters(shareholding: DataFrame, limit: int = PERIOD_LIMIT) -> DataFrame:
    """Rows of the last distinct quarters per symbol, with the quarter's month; 1 is the newest."""
    dated = shareholding.withColumn("month", label_month("period_label"))
    quarters = dated.select("symbol", "period_label", "month").distinct()
    recent = top_n(quarters, ["symbol"], [F.col("month").desc(), F.col("period_label").desc()], limit)
    return dated.join(recent, ["symbol", "period_label", "month"])


def holder_totals(recent: DataFrame) -> DataFrame:
    """Shareholders per quarter over all groups; a quarter where no group reports holders has no row."""
    counted = recent.where(F.col("total_shareholders") != 0)
    return counted.groupBy("symbol", "period_label", "position").agg(
        F.sum(F.col("total_shareholders").cast("decimal(28,0)")).cast("double").alias("value")
    )


def shareholding_pattern(shareholding: DataFrame, limit: int = PERIOD_LIMIT) -> DataFrame:
    """Holding per group and quarter with display labels, groups without any figure dropped, holders last."""
    recent = last_quarters(shareholding, limit)
    label = F.col("group_name")
    for group, shown in GROUP_LABELS.items():
        label = F.when(F.col("group_name") == group, shown).otherwise(label)
    groups = recent.select(
        "symbol", label.alias("label"), F.lit("percent").alias("unit"), "period_label", "position",
        F.col("shareholding_pct").alias("value"),
    )
    # A symbol has few groups and at most `limit` quarters: the window is small.
    any_figure = F.max(F.col("value").isNotNull().cast("int")).over(W.partitionBy("symbol", "label"))
    groups = groups.withColumn("_any", any_figure).where(F.col("_any") == 1).drop("_any")
    holders = holder_totals(recent).select(
        "symbol", F.lit("No. of Shareholders").alias("label"), F.lit("count").alias("unit"), "period_label",
        "position", "value",
    )
    return groups.unionByName(holders)
