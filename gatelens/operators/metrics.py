"""Traffic metrics over the request log: counters, percentiles, provider stats, funnels, traces.

Counters are a single aggregation of conditional counts (partial aggregation
map-side, one row out). Recent-sample percentiles take the newest N rows with a
distributed top-k (per-partition limits before the exchange), never a global
sort; per-provider buffers use a window group limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Latency buffer sizes (global, per provider) and the retry policy (3 tries, 1 s base, doubling).
GLOBAL_SAMPLES, PROVIDER_SAMPLES = 2000, 1000
MAX_RETRIES, RETRY_BASE_S = 3, 1
STATUS_CLASS = {200: "ok", 400: "injection_blocked", 401: "unauthorized", 422: "contract_blocked",
                429: "rate_limited", 502: "upstream_error"}


def _ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a.cast("double") / b.cast("double"), digits))


def metrics_snapshot(log: DataFrame) -> DataFrame:
    """One row of counters. A hit returns before the request is recorded, so it is no request of the total; a miss is
    counted when the cache is asked, so rows that fail later (422, 502) are misses too."""
    st = F.col("status")
    hit = served_from_cache()
    hits = F.count_if(hit)
    misses = F.count_if(st.isin(200, 422, 502) & ~hit)
    return log.agg(
        F.count_if((st == 200) & ~hit).alias("requests_total"), F.count_if(st == 429).alias("rate_limited"),
        F.count_if(st == 422).alias("contract_violations"), hits.alias("cache_hits"), misses.alias("cache_misses"),
        _ratio(hits, hits + misses).alias("cache_hit_rate"), F.count_if(st == 400).alias("injection_blocks"),
        F.count_if(st == 502).alias("provider_errors"), F.count_if(st == 401).alias("unauthorized"))


def served_from_cache() -> Column:
    return F.coalesce((F.col("cache") == "HIT") & (F.col("status") == 200), F.lit(False))


def generated(log: DataFrame) -> DataFrame:
    """Requests that a provider answered and that passed the contracts: the only ones with a latency sample, with
    recorded usage and with cost."""
    return log.filter((F.col("status") == 200) & ~served_from_cache())


def usage_totals(log: DataFrame) -> DataFrame:
    """Recorded tokens per provider and alias."""
    return generated(log).groupBy("provider", "alias").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


def spend_by_model(log: DataFrame, costs: DataFrame) -> DataFrame:
    """Tokens and cost per app, provider, alias and day; ``costs(alias, provider, cost)`` per 1000 tokens, 0 if unknown."""
    j = generated(log).join(costs, ["alias", "provider"], "left")
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    cost = F.coalesce("cost", F.lit(0.0)).cast("decimal(18,6)")   # exact sums, independent of partitioning
    return (j.groupBy("app_id", "provider", "alias", F.to_date("ts").cast("string").alias("day"))
            .agg(F.sum(tokens).alias("tokens"),
                 F.round(F.sum(tokens * cost).cast("double") / 1000.0, 6).alias("spend_usd")))


def _pcts(col: str, exact: bool = True, accuracy: int = 10000) -> list[Column]:
    """Exact (linear interpolation) over bounded sample buffers; a mergeable sketch for all-history scopes."""
    if exact:
        return [F.round(F.percentile(col, p), 4).alias(n) for p, n in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))]
    return [F.percentile_approx(col, p, accuracy).alias(n) for p, n in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))]


def latency_percentiles_all_history(log: DataFrame, by: str = "provider", accuracy: int = 10000) -> DataFrame:
    """p50/p95/p99 over all history per group with an approximate quantile sketch (bounded memory per group)."""
    ok = generated(log)
    return ok.groupBy(by).agg(F.count("*").alias("samples"), *_pcts("latency_ms", exact=False, accuracy=accuracy))


def latency_percentiles(log: DataFrame, n_global: int = GLOBAL_SAMPLES, n_provider: int = PROVIDER_SAMPLES) -> DataFrame:
    """p50/p95/p99 (linear interpolation) over the newest n samples, globally and per provider."""
    ok = generated(log).select("provider", "ts", "request_id", "latency_ms")
    newest = ok.orderBy(F.col("ts").desc(), F.col("request_id").desc()).limit(n_global)
    g = newest.agg(F.lit("global").alias("scope"), F.count("*").alias("samples"), *_pcts("latency_ms"))
    w = Window.partitionBy("provider").orderBy(F.col("ts").desc(), F.col("request_id").desc())
    per = (ok.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_provider)
           .groupBy(F.col("provider").alias("scope")).agg(F.count("*").alias("samples"), *_pcts("latency_ms")))
    return g.unionByName(per)


def provider_stats(log: DataFrame, n_provider: int = PROVIDER_SAMPLES) -> DataFrame:
    """requests (successes), errors, error_rate = errors / successes (0 when none), attempts-based rate, p50/p95."""
    st = F.col("status")
    counts = log.groupBy("provider").agg(F.count_if((st == 200) & ~served_from_cache()).alias("requests"),
                                         F.count_if(st == 502).alias("errors"))
    ok = generated(log)
    w = Window.partitionBy("provider").orderBy(F.col("ts").desc(), F.col("request_id").desc())
    lat = (ok.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_provider)
           .groupBy("provider").agg(F.round(F.percentile("latency_ms", 0.5), 4).alias("p50_ms"),
                                    F.round(F.percentile("latency_ms", 0.95), 4).alias("p95_ms")))
    return counts.join(lat, "provider", "left").select(
        "provider", "requests", "errors", _ratio(F.col("errors"), F.col("requests")).alias("error_rate"),
        _ratio(F.col("errors"), F.col("requests") + F.col("errors")).alias("error_rate_attempts"), "p50_ms", "p95_ms")


def security_counts(decisions: DataFrame) -> DataFrame:
    t = F.col("tier_triggered")
    return decisions.agg(F.count_if(t == 1).alias("tier1_blocks"), F.count_if(t == 2).alias("tier2_blocks"),
                         F.count_if(t.isNotNull()).alias("total_blocks"))


def contract_counts(verdicts: DataFrame, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """``blocks`` and ``total_violations`` count blocked responses (identified by ``keys``) once each, however many of
    their rules failed; flags and evaluations count rules."""
    failed_block = F.when(~F.col("passed") & (F.col("action") == "block"), F.lit(1)).otherwise(0)
    per_response = verdicts.groupBy(*keys).agg(
        F.max(failed_block).alias("blocked"), F.count_if(~F.col("passed") & (F.col("action") == "flag")).alias("flags"),
        *(F.count_if(F.col("tier") == t).alias(t) for t in ("deterministic", "classifier", "llm_judge")))
    v = per_response.agg(
        F.sum("blocked").alias("blocks"), F.sum("flags").alias("flags"), F.sum("blocked").alias("total_violations"),
        F.sum("deterministic").alias("eval_deterministic"), F.sum("classifier").alias("eval_classifier"),
        F.sum("llm_judge").alias("eval_llm_judge"))
    # two one-row aggregates combined by union + sum (no join between them)
    zero = F.lit(0).cast("long")
    a = alerts.agg(F.count("*").alias("drift_alerts"))
    rows = v.select("*", zero.alias("drift_alerts")).unionByName(
        a.select(*[zero.alias(c) for c in v.columns], "drift_alerts"))
    return rows.agg(*[F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in v.columns + ["drift_alerts"]])


def status_rollup(log: DataFrame) -> DataFrame:
    cls = F.lit("other")
    for code, name in STATUS_CLASS.items():
        cls = F.when(F.col("status") == code, name).otherwise(cls)
    return (log.groupBy("uri", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:00:00").alias("hour"), "status")
            .agg(F.count("*").alias("n")).withColumn("outcome", cls))


def attempt_log(log: DataFrame) -> DataFrame:
    """Upstream attempts per request derived from the log (one row per try): status 0 marks a timeout."""
    eid, st = F.col("request_id"), F.col("status")
    seq = (F.when(st == 502, F.array(F.lit(500), F.lit(0), F.lit(502)))
           .when((st.isin(200, 422)) & (eid % 10 == 7), F.array(F.lit(503), F.lit(200)))
           .when((st.isin(200, 422)) & (eid % 10 == 8), F.array(F.lit(0), F.lit(500), F.lit(200)))
           .when((st.isin(200, 422)) & (eid % 17 == 5), F.array(F.lit(429)))
           .when((st.isin(200, 422)) & (eid % 23 == 4), F.array(F.lit(404)))
           .when(st.isin(200, 422), F.array(F.lit(200))))
    return log.select("request_id", "provider", F.posexplode(seq).alias("attempt", "http_status"))


def upstream_error_classes(attempts: DataFrame) -> DataFrame:
    """Per provider and final class: requests, attempts and total backoff (1 s, then 2 s between tries)."""
    s = F.col("http_status")
    retryable = (s >= 500) | (s == 0)
    per_req = attempts.groupBy("provider", "request_id").agg(
        F.count("*").alias("attempts"),
        F.max_by("http_status", "attempt").alias("last_status"),
        F.sum(F.when(retryable & (F.col("attempt") < MAX_RETRIES - 1),
                     F.pow(F.lit(2), F.col("attempt")) * RETRY_BASE_S).otherwise(0)).alias("backoff_s"))
    ls = F.col("last_status")
    cls = (F.when(ls == 200, "ok").when(ls == 429, "rate_limited").when((ls >= 500) | (ls == 0), "retryable_exhausted")
           .otherwise("final"))
    return per_req.groupBy("provider", cls.alias("final_class")).agg(
        F.count("*").alias("requests"), F.sum("attempts").alias("attempts"), F.sum("backoff_s").alias("backoff_s"))


# Funnel stages in the gateway's order of execution.
FUNNEL = ["received", "rate_limit", "guard", "cache_lookup", "provider", "contracts", "delivered"]


def request_funnel(log: DataFrame) -> DataFrame:
    """Requests surviving each stage: rate limit (429) → guard (400) → cache hit served → provider (502) → contracts (422)."""
    st = F.col("status")
    hit = (F.col("cache") == "HIT") & (st == 200)
    a = log.agg(
        F.count("*").alias("received"),
        F.count_if(~st.isin(429, 401)).alias("rate_limit"),
        F.count_if(~st.isin(429, 401, 400)).alias("guard"),
        F.count_if(~st.isin(429, 401, 400) & ~hit).alias("cache_lookup"),
        F.count_if(~st.isin(429, 401, 400, 502) & ~hit).alias("provider"),
        F.count_if(~st.isin(429, 401, 400, 502, 422) & ~hit).alias("contracts"),
        F.count_if(st == 200).alias("delivered"))
    rows = F.array(*[F.struct(F.lit(i).alias("stage_order"), F.lit(n).alias("stage"), F.col(n).alias("n"))
                     for i, n in enumerate(FUNNEL)])
    return a.select(F.inline(rows))


# Share (percent) of request latency spent in each traced stage.
SPAN_SHARES = [("guard", 5), ("cache", 2), ("provider", 85), ("contracts", 8)]


def spans(log: DataFrame) -> DataFrame:
    """Span rows (trace = request) derived from the log; the provider span carries token usage."""
    cents = F.round(F.col("latency_ms") * 100).cast("long")   # latencies carry 2 decimals
    arr = F.array(*[F.struct(F.lit(n).alias("name"), (F.floor((cents * sh + 50) / 100) / 100.0).alias("ms"),
                             ((F.col("status") == 502) & F.lit(n == "provider")).alias("error"),
                             F.when(F.lit(n == "provider"), F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
                    for n, sh in SPAN_SHARES])
    return log.select(F.col("request_id").alias("trace_id"), F.inline(arr))


def trace_rollup(span_df: DataFrame) -> DataFrame:
    g = span_df.groupBy("trace_id").agg(
        F.count("*").alias("n_spans"), F.map_from_entries(F.collect_list(F.struct("name", "ms"))).alias("m"),
        F.max(F.col("error").cast("int")).alias("err"), F.sum("tokens").alias("total_tokens"))
    return g.select("trace_id", "n_spans", *[F.col("m")[n].alias(f"{n}_ms") for n, _ in SPAN_SHARES],
                    (F.col("err") == 1).alias("error"), F.col("total_tokens").cast("long").alias("total_tokens"))
