from pyspark.sql import functions as F

from conftest import SF_SMALL
from gatelens.operators import metrics as mt
from gatelens.plans import fixtures as fx


def test_funnel_only_shrinks_until_delivery(spark):
    rows = sorted((r["stage_order"], r["n"]) for r in mt.request_funnel(fx.request_log(spark, SF_SMALL)).collect())
    ns = [n for _, n in rows[:-1]]
    assert ns == sorted(ns, reverse=True)


def test_error_rate_is_errors_over_successes(spark):
    log = spark.createDataFrame([("p", 502, 1.0, 1), ("p", 502, 1.0, 2), ("p", 200, 1.0, 3), ("q", 502, 1.0, 4)],
                                "provider string, status int, latency_ms double, request_id long").withColumn("cache", F.lit("MISS")).withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    st = {r["provider"]: r for r in mt.provider_stats(log).collect()}
    assert st["p"]["error_rate"] == 2.0 and st["p"]["error_rate_attempts"] == 0.6667
    assert st["q"]["requests"] == 0 and st["q"]["error_rate"] == 0.0


def test_all_history_sketch_close_to_exact(spark):
    log = fx.request_log(spark, SF_SMALL)
    approx = {r["provider"]: r["p50_ms"] for r in mt.latency_percentiles_all_history(log).collect()}
    exact = {r["provider"]: r["p"] for r in mt.generated(log).groupBy("provider")
             .agg(F.percentile("latency_ms", 0.5).alias("p")).collect()}
    assert all(abs(approx[k] - exact[k]) <= 0.05 * max(exact[k], 1.0) for k in exact)


def test_cache_hits_are_no_requests_and_late_failures_are_misses(spark):
    rows = [(1, "p", 200, "HIT", 5.0), (2, "p", 200, "MISS", 7.0), (3, "p", 422, "MISS", 9.0), (4, "p", 502, "MISS", 11.0),
            (5, "p", 400, "HIT", 1.0), (6, "p", 429, "MISS", 1.0), (7, "p", 401, "MISS", 1.0)]
    log = spark.createDataFrame(rows, "request_id long, provider string, status int, cache string, latency_ms double").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    m = mt.metrics_snapshot(log).first()
    assert (m["requests_total"], m["cache_hits"], m["cache_misses"], m["cache_hit_rate"]) == (1, 1, 3, 0.25)
    assert {r["scope"]: (r["samples"], r["p50_ms"]) for r in mt.latency_percentiles(log).collect()} == {"global": (1, 7.0), "p": (1, 7.0)}


def test_blocked_responses_count_once(spark):
    v = spark.createDataFrame([(1, 0, False, "block", "deterministic"), (1, 0, False, "block", "classifier"), (1, 0, False, "flag", "classifier"),
                               (2, 0, True, "block", "llm_judge")], "conv_id long, turn long, passed boolean, action string, tier string")
    c = mt.contract_counts(v, spark.range(2), ["conv_id", "turn"]).first().asDict()
    assert c == {"blocks": 1, "flags": 1, "total_violations": 1, "eval_deterministic": 1, "eval_classifier": 2, "eval_llm_judge": 1, "drift_alerts": 2}
