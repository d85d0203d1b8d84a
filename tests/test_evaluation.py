"""Exact percentiles in bounded memory and curves over all distinct scores."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatelens.operators import evaluation as ev

POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}


def both(df):
    got = {r["g"]: r for r in ev.exact_percentiles(df, "g", "v", POINTS).collect()}
    want = {r["g"]: r for r in df.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in POINTS.items()]).collect()}
    return got, want


def test_percentiles_of_many_distinct_values_and_a_hot_group(spark):
    i = F.col("id")
    v = F.exp(F.pmod(F.xxhash64(i), F.lit(100_000)) / 4000.0) * F.when(i % 5 == 0, -1.0).otherwise(1.0)
    df = spark.range(60_000).select(F.when(i % 3 == 0, "hot").when(i % 3 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("g"), (i % 40).cast("string"))).alias("g"), F.when(i % 11 == 0, F.round(v)).otherwise(v).alias("v"))
    got, want = both(df)
    assert set(got) == set(want) and None in got and len(got) > 30
    for g in want:
        for n in POINTS:
            assert math.isclose(got[g][n], want[g][n], rel_tol=1e-12), (g, n)


odd = st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.0, 1e308, -1e308, 5e-324, 1.0000000000000002]),
                st.floats(allow_nan=False, allow_infinity=False, width=32))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), odd), min_size=1, max_size=25))
def test_percentiles_of_odd_values(spark, rows):
    got, want = both(spark.createDataFrame(rows, "g string, v double"))
    for g in want:
        for n in POINTS:
            assert (got[g][n] is None) == (want[g][n] is None)
            assert want[g][n] is None or got[g][n] == pytest.approx(want[g][n], rel=1e-9)


def test_percentiles_of_an_empty_table_infinite_and_nan_values(spark):
    assert ev.exact_percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", POINTS).count() == 0
    rows = [("a", float("inf"))] * 3 + [("a", 1.0), ("a", 2.0), ("a", float("-inf")), ("n", float("nan"))]
    got = {r["g"]: r for r in ev.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v",
                                                   {"p20": 0.2, "p40": 0.4, "p100": 1.0}).collect()}
    assert (got["a"]["p20"], got["a"]["p40"], got["a"]["p100"]) == (1.0, 2.0, float("inf"))
    assert got["n"]["p20"] is None


def test_percentile_plan_holds_no_list_of_values(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    plan = ev.exact_percentiles(df, "g", "v", POINTS)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan


def test_curve_over_all_scores_against_direct_counts(spark):
    i = F.col("id")
    df = spark.range(3000).select(F.when(i % 3 == 0, "b").otherwise("a").alias("model"), i.alias("doc_id"),
                                  (F.pmod(F.xxhash64(i), F.lit(5)) == 0).cast("int").alias("label"),
                                  F.when(i % 50 == 7, F.lit(None)).otherwise(F.pmod(F.xxhash64(i, F.lit(1)), F.lit(700)) / 700.0).alias("prob"))
    rows = df.collect()
    curve = ev.pr_curve_all(df)
    got = {(r["model"], r["threshold"]): r for r in curve.collect()}
    want_ap = {}
    for m in "ab":
        mine = [r for r in rows if r["model"] == m]
        npos, last, ap = sum(r["label"] for r in mine), 0, 0.0
        scores = sorted({r["prob"] for r in mine if r["prob"] is not None}, reverse=True)
        for t in scores:
            tp = sum(1 for r in mine if r["prob"] is not None and r["prob"] >= t and r["label"] == 1)
            fp = sum(1 for r in mine if r["prob"] is not None and r["prob"] >= t and r["label"] == 0)
            assert (got[m, t]["tp"], got[m, t]["fp"]) == (tp, fp)
            ap += (tp - last) / npos * tp / (tp + fp)
            last = tp
        want_ap[m] = (len(scores), round(ap, 6))
    assert len(got) == sum(n for n, _ in want_ap.values())
    assert {r["model"]: (r["n_thresholds"], r["average_precision"]) for r in ev.average_precision(curve).collect()} == want_ap
    assert ev.pr_curve_all(df.limit(0)).count() == 0


def test_curve_plan_does_not_grow_with_thresholds(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 0, 0.25), ("m", None, 0.7), ("m", 1, None)], "model string, label int, prob double")
    nodes = [ev.pr_curve(df, [i / n for i in range(n)])._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (5, 500)]
    assert nodes[0] == nodes[1]
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in ev.pr_curve(df, [0.25, 0.5, 0.6]).collect()}
    assert got == {0.25: (1, 1), 0.5: (1, 0), 0.6: (0, 0)}
