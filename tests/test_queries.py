"""Every registered query against its SQL on the smallest tables, and the shape of plans that have to scale."""

from __future__ import annotations

import pytest

import __spark_entry__  # noqa: F401
from tests.oracle import compare, connect
from workload.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SQLS = ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    if name not in SQLS:
        assert QUERIES[name](spark, FOLDER).count() > 0
        return
    state, why = compare(QUERIES[name], SQLS[name], spark, con, FOLDER)
    assert state == "ok", why


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQLS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


PARTIAL_CUT = ("w03_last_sessions", "w05_top_of_group", "w11_last_periods", "l08_first_failures", "s03_latest_payload")


@pytest.mark.parametrize("name", PARTIAL_CUT)
def test_groups_are_cut_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "WindowGroupLimit" in plan and ", Partial" in plan


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_join_and_no_row_udf(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["w01_ranked_latest", "w06_latest_valuation", "j11_close_years_ago", "w07_latest_shareholding"])
def test_latest_picks_stay_hash_aggregates(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "SortAggregate" not in plan and "partial_max_by" in plan
