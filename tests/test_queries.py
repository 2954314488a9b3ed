"""Registered queries against their SQL.  PITRANK_ALL_QUERIES=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
CORE = ("labels_topk", "bars_t1", "t1_features", "t2_features", "map_at_k", "wilcoxon_pratt", "self_exclusion_corr",
        "venue_merge", "json_capture", "stream_premarket")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PITRANK_ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[:2] == ["trade_date", "ticker"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_and_no_cross_product_in_hot_plans(spark):
    for name in ("labels_topk", "bars_t1", "t1_features"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
