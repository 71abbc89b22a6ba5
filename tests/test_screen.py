"""Screens: logic with missing figures, names, order, pages, caps, presets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bourselight import catalog
from bourselight.catalog import col
from bourselight.plans import screen
from bourselight.plans.snapshot import with_indices


@pytest.fixture(scope="module")
def universe(spark):
    """Sixty companies; half have a P/E and ten a return on equity."""
    rows = [(f"CO{i:03}", f"Company {i}", "Banks" if i % 2 else None, 1000.0 + 10 * i, 100.0 + i,
             10.0 if i < 30 else None, 20.0 if i < 10 else None) for i in range(60)]
    rows.append(("DEAD", "Delisted", "Banks", None, 1.0, 10.0, 20.0))
    df = spark.createDataFrame(
        rows, "symbol string, name string, sector string, market_cap double, current_price double, pe double, "
        "returnonequity double")
    return df.to(catalog.snapshot_schema()).cache()


def count(universe, predicate):
    return screen.matches(universe, predicate).count()


def test_missing_stays_unknown_under_not(universe):
    assert count(universe, col("PE") < 20) == 30
    assert count(universe, ~(col("PE") < 20)) == 0
    assert count(universe, ~(col("PE") > 20) & (col("ROE") > 12)) == 10
    assert count(universe, (col("PE") < 20) | (col("ROE") > 12) & (col("CMP") < 0)) == 30


def test_division_by_zero_is_null(universe):
    assert count(universe, screen.divide(col("CMP"), col("PE") - 10) > 0) == 0
    assert count(universe, screen.divide(col("CMP"), col("PE")) > 10) == 29


def test_text_membership(universe):
    assert count(universe, screen.one_of("Sector", ["bAnKs"])) == 30
    assert count(universe, screen.one_of("Sector", ["banks"], negated=True)) == 0


def test_no_market_cap_is_not_screenable(universe):
    assert universe.count() == 61
    assert count(universe, F.lit(True)) == 60


def test_names_are_tolerant():
    assert catalog.resolve("price_to  EARNING") is catalog.resolve("P/E") is catalog.resolve("pe")
    with pytest.raises(catalog.UnknownColumn):
        catalog.resolve("no such column")
    assert [c.key for c in catalog.resolve_all(["PE", "Mcap", "pe"])] == ["pe", "market_cap"]
    assert len(catalog.COLUMNS) == 119 and len(catalog.stored()) == 118
    assert len({n.lower() for c in catalog.COLUMNS for n in c.names()}) >= 119


def test_scales():
    assert catalog.resolve("sales").scale == 1e-7
    assert catalog.resolve("eps").scale == 1.0
    assert catalog.resolve("ROE").scale == catalog.resolve("dividend_payout").scale == 100.0
    assert catalog.resolve("market_cap").scale == catalog.resolve("debtordays").scale == 1.0


def test_label_and_unit_are_metadata(universe):
    assert universe.schema["pe"].metadata == {"label": "Price to Earning", "unit": "ratio"}


def test_order_keeps_missing_last_in_both_directions(universe):
    for descending in (True, False):
        rows = screen.ordered(screen.screenable(universe), "pe", descending).collect()
        assert [r["pe"] is None for r in rows] == [False] * 30 + [True] * 30
    first = screen.ordered(universe, "not a column").first()
    assert first["symbol"] == "CO059"


@pytest.mark.parametrize(
    ("page", "size", "cap", "want"),
    [(1, 10, None, (0, 10)), (0, 500, None, (0, 100)), (3, 10, 25, (20, 5)), (4, 10, 25, (30, 0)), (1, 0, None, (0, 1))],
)
def test_page_bounds(page, size, cap, want):
    assert screen.page_bounds(page, size, cap) == want


def test_cap_discloses_the_true_total(universe):
    rows = screen.run(universe, F.lit(True), page_size=100, row_cap=25).collect()
    assert len(rows) == 25 and rows[0]["total"] == 60 and rows[0]["capped"]
    assert rows[0]["symbol"] == "CO059"
    assert screen.run(universe, F.lit(True), page=2, page_size=100, row_cap=25).count() == 0
    assert not screen.run(universe, col("ROE") > 12, row_cap=25).collect()[0]["capped"]


def test_index_membership(universe, spark):
    links = spark.createDataFrame([("CO001", "NIF50"), ("CO002", "NIF50"), ("CO002", "SENSEX")], "symbol string, index_symbol string")
    base = screen.screenable(universe)
    assert screen.in_index(base, links, ["NIF50", "SENSEX"]).count() == 2
    assert screen.in_index(base, links, ["nif50"]).count() == 0
    assert screen.not_in_index(base, links, ["NIF50"]).count() == 58


def test_index_membership_anywhere_in_a_predicate(universe, spark):
    links = spark.createDataFrame([("CO001", "NIF50"), ("CO002", "NIF50"), ("CO002", "SENSEX"), ("CO002", "SENSEX")], "symbol string, index_symbol string")
    listed = with_indices(universe, links)
    rows = {r["symbol"]: r for r in screen.screenable(listed).collect()}
    assert rows["CO002"]["index"] == ["NIF50", "SENSEX"] and rows["CO003"]["index"] == []
    inside = {"NIF50": {"CO001", "CO002"}, "SENSEX": {"CO002"}}

    def found(predicate):
        return {r["symbol"] for r in screen.matches(listed, predicate).collect()}

    def pe(test):
        return {s for s, r in rows.items() if r["pe"] is not None and test(r["pe"])}

    nifty, sensex = screen.member_of(["NIF50"]), screen.one_of("Index membership", ["SENSEX"])
    low, everyone = col("PE") < 10, set(rows)
    assert found(nifty | low) == inside["NIF50"] | pe(lambda v: v < 10)
    assert found(~nifty) == found(screen.one_of("index", ["NIF50"], negated=True)) == everyone - inside["NIF50"]
    assert found(~(nifty & ~sensex)) == everyone - {"CO001"}
    # A missing figure stays unknown, a membership never does.
    assert found(~(sensex | low)) == pe(lambda v: v >= 10) - inside["SENSEX"]
    assert found(screen.member_of(["nif50"])) == found(screen.member_of([])) == set()
    plan = screen.matches(listed.drop("index").withColumn("index", F.array(F.lit("NIF50"))), nifty | ~sensex & nifty)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString().replace("JoinType", "")


def test_presets_all_run_and_agree_with_the_combined_pass(universe, spark):
    links = spark.createDataFrame([("CO001", "NIF50"), ("CO040", "NIF50")], "symbol string, index_symbol string")
    hits = {(r["slug"], r["symbol"]) for r in screen.preset_hits(universe, links).collect()}
    alone = {(s, r["symbol"]) for s in screen.BY_SLUG for r in screen.preset_matches(universe, links, s).collect()}
    assert hits == alone
    assert {s for s, _ in hits} == {"nifty-value"}
    assert len(screen.PRESETS) == 12
    assert screen.run_preset(universe, links, "nifty-value").collect()[0]["symbol"] == "CO001"


def test_export_counts(universe):
    rows, counts = screen.export(screen.screenable(universe), 10, ["name", "pe"])
    assert rows.columns == ["Symbol", "Name", "Price to Earning"] and rows.count() == 10
    assert counts.collect()[0].asDict() == {"total": 60, "exported": 10, "truncated": True}
