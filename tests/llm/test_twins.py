"""Registered queries of the training-data operators: SQL twins and plans."""

import pytest

import __spark_entry__ as E
from gatelens.llm.oracles import ORACLES
from gatelens.llm.queries import QUERIES
from oracle_check import compare, duck

from paths import SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql_twin(spark, name):
    problems, _, _ = compare(spark, duck(SF_SMALL), name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert not problems, problems


def test_every_query_is_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", ["op11_toxicity", "op12_tokenizer_alignment", "op13_periodic_runs"])
def test_plan_has_no_cross_join_or_row_udf(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
