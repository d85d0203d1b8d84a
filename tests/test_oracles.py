"""Every registered query against its SQL twin (row count, schema, values) on the smallest tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from gatelens.plans.catalog import QUERIES as CATALOG
from oracle_check import compare, duck

QUERIES = CATALOG      # the optional training-data queries have tests of their own
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in CATALOG}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_registered_has_a_twin_or_is_documented():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only == {"train_tier2"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql_twin(spark, con, name):
    problems, _, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert not problems, problems


def test_entry_returns_rows(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_") and n != "train_tier2"))
def test_plan_has_no_cross_join_or_row_udf(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"
