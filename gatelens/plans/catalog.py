"""Registered queries: key → (spark, sf_dir) -> DataFrame.

Every query reads the supplied tables (or fixtures Spark derives from them),
so its work grows with the data. Output columns are flat and aliased to match
the SQL twins in ``gatelens.plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens.functions.lexicon import lexical_injection_prob
from gatelens.functions.patterns import DEFAULT_RULES, first_match
from gatelens.operators import contracts as ct
from gatelens.operators import datasets as ds
from gatelens.operators import detection as det
from gatelens.operators import drift as dr
from gatelens.operators import evaluation as ev
from gatelens.operators import metrics as mt
from gatelens.operators import prompts as pr
from gatelens.operators import providers as pv
from gatelens.operators import ratelimit as rl
from gatelens.operators import routing as rt
from gatelens.operators import vectors as vx
from gatelens.plans import fixtures as fx
from gatelens.sources import io as sio
from gatelens.sources.tables import table
from gatelens.streaming import streams as stx

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ 2.2 reshaping
@register("flatten_prompts")
def q_flatten_prompts(spark, sf):
    return pr.flatten_prompts(fx.conversations(spark, sf))


@register("last_user_text")
def q_last_user_text(spark, sf):
    return pr.last_user_text(fx.conversations(spark, sf))


@register("turn_pairs")
def q_turn_pairs(spark, sf):
    return pr.turn_pairs(fx.conversations(spark, sf))


@register("split_system")
def q_split_system(spark, sf):
    return pr.split_system(fx.conversations(spark, sf))


@register("filter_clean_prompts")
def q_filter_clean_prompts(spark, sf):
    return pr.clean_prompt_counts(table(spark, sf, "documents"), by="source")


@register("to_injection_prob")
def q_to_injection_prob(spark, sf):
    r = fx.raw_model_outputs(spark, sf)
    return r.select("model", "doc_id", "top_label", det.to_injection_prob(F.col("top_label"), F.col("top_score")).alias("prob"))


# ------------------------------------------------------------------ 2.3 detection
@register("pattern_scan")
def q_pattern_scan(spark, sf):
    return det.pattern_scan(fx.attack_corpus(spark, sf)).drop("prompt")


@register("pattern_rollup")
def q_pattern_rollup(spark, sf):
    return det.pattern_rollup(det.pattern_scan(fx.attack_corpus(spark, sf)))


@register("scan_documents")
def q_scan_documents(spark, sf):
    return det.scan_documents(table(spark, sf, "documents"), "text", ["lang"])


@register("scan_pages")
def q_scan_pages(spark, sf):
    pages = table(spark, sf, "pages").withColumn("site", F.regexp_extract("url", r"^https?://([^/]+)", 1))
    return det.scan_documents(pages.withColumn("tld", F.regexp_extract("site", r"\.([a-z]+)$", 1)), "html", ["tld"])


@register("tier2_scores")
def q_tier2_scores(spark, sf):
    return det.tier2_scores(fx.attack_corpus(spark, sf)).select("conv_id", "label", "ml_prob", "ml_label")


def _decisions(spark, sf, **kw):
    return det.guard_decisions(fx.attack_corpus(spark, sf), **kw)


@register("guard_decisions")
def q_guard_decisions(spark, sf):
    return _decisions(spark, sf).select("conv_id", "label", "pattern_id", "severity", "ml_prob", "blocked",
                                        "tier_triggered", "reason")


@register("guard_dry_run")
def q_guard_dry_run(spark, sf):
    d = _decisions(spark, sf, dry_run=True)
    return d.groupBy("label").agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"),
                                  F.count_if("would_block").alias("would_block"),
                                  F.count_if(F.col("reason").startswith("[DRY RUN")).alias("dry_run_marked"))


@register("judge_queue")
def q_judge_queue(spark, sf):
    return det.judge_queue(_decisions(spark, sf)).select("conv_id", "label", "ml_prob")


@register("judge_verdicts")
def q_judge_verdicts(spark, sf):
    return det.judge_verdicts(fx.verdict_texts(spark, sf)).drop("raw")


@register("tier_disagreements")
def q_tier_disagreements(spark, sf):
    s = fx.scored(spark, sf)
    v = det.judge_verdicts(fx.verdict_texts(spark, sf))
    return det.tier_disagreements(s, v, "doc_id").select("model", "doc_id", "prob", "outcome")


@register("attack_category")
def q_attack_category(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang", det.attack_category(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


@register("attack_category_corpus")
def q_attack_category_corpus(spark, sf):
    a = fx.attack_corpus(spark, sf)
    return a.select("conv_id", "label", det.attack_category(F.col("prompt")).alias("category"))


# ------------------------------------------------------------------ 2.10 evaluation
@register("confusion")
def q_confusion(spark, sf):
    return ev.confusion(fx.scored(spark, sf), 0.5)


@register("precision_recall_f1")
def q_prf(spark, sf):
    return ev.precision_recall_f1(fx.scored(spark, sf), 0.5)


@register("pr_curve")
def q_pr_curve(spark, sf):
    return ev.pr_curve(fx.scored(spark, sf))


@register("pr_curve_all")
def q_pr_curve_all(spark, sf):
    return ev.pr_curve_all(fx.scored(spark, sf)).select("model", "threshold", "tp", "fp", "precision", "recall", "f1")


@register("average_precision")
def q_average_precision(spark, sf):
    return ev.average_precision(ev.pr_curve_all(fx.scored(spark, sf)))


@register("latency_summary")
def q_latency_summary(spark, sf):
    return ev.latency_summary(fx.scored(spark, sf))


@register("missed_attacks")
def q_missed_attacks(spark, sf):
    return ev.missed_attacks(fx.scored(spark, sf), 0.5, 10)


@register("miss_categories")
def q_miss_categories(spark, sf):
    return ev.miss_categories(fx.scored(spark, sf), 0.5)


@register("combined_recall")
def q_combined_recall(spark, sf):
    v = det.judge_verdicts(fx.verdict_texts(spark, sf))
    return ev.combined_recall(fx.scored(spark, sf), v, 0.5)


@register("model_comparison")
def q_model_comparison(spark, sf):
    return ev.model_comparison(fx.scored(spark, sf), 0.5)


# ------------------------------------------------------------------ 2.4 contracts

PAIR_KEYS = ["conv_id", "turn"]


def contract_defs(kinds=None):
    defs, _ = ct.load_definitions(ct.CONTRACT_DIR)
    if kinds is None:
        return defs
    return {a: [r for r in rs if r.type in kinds] for a, rs in defs.items()}


def _verdicts_of(spark, sf, kinds=None):
    p = fx.judged_pairs(spark, sf)
    return ct.contract_verdicts(p, contract_defs(kinds), PAIR_KEYS, judge_raw="judge_raw")


for _kind, _key in [("keyword", "contract_keyword"), ("regex", "contract_regex"), ("length_limit", "contract_length"),
                    ("language_match", "contract_language"), ("sentiment", "contract_sentiment"),
                    ("topic_boundary", "contract_topic"), ("llm_judge", "contract_judge"),
                    ("composite", "contract_composite")]:
    QUERIES[_key] = (lambda k: (lambda spark, sf: _verdicts_of(spark, sf, [k])))(_kind)


@register("contract_schema")
def q_contract_schema(spark, sf):
    defs = {a: [ct.parse_contract(r) for r in rs] for a, rs in fx.EVENT_SCHEMA_RULES.items()}
    v = ct.contract_verdicts(fx.event_payloads(spark, sf), defs, ["event_id"], response="event_type", request=None,
                             payload="payload")
    return v.select("event_id", "app_id", "contract_id", "action", "passed", "compliance", "message", "location")


@register("contract_verdicts")
def q_contract_verdicts(spark, sf):
    return _verdicts_of(spark, sf)


@register("contract_tiered")
def q_contract_tiered(spark, sf):
    return ct.contract_tiered(fx.judged_pairs(spark, sf), contract_defs(), PAIR_KEYS, judge_raw="judge_raw")


@register("contract_report")
def q_contract_report(spark, sf):
    return ct.contract_report(fx.judged_pairs(spark, sf), contract_defs(), PAIR_KEYS, judge_raw="judge_raw")


@register("contract_rollup")
def q_contract_rollup(spark, sf):
    return ct.contract_rollup(_verdicts_of(spark, sf))


@register("judge_score_parse")
def q_judge_score_parse(spark, sf):
    p = fx.judged_pairs(spark, sf)
    j = ct.judge_score_parse(F.col("judge_raw"))
    return p.select("conv_id", "turn", j["score"].alias("score"), j["reasoning"].alias("reasoning"), j["path"].alias("path"))


@register("judge_requests")
def q_judge_requests(spark, sf):
    return ct.judge_requests(fx.judged_pairs(spark, sf), contract_defs(), PAIR_KEYS)


@register("resolve_path")
def q_resolve_path(spark, sf):
    e = fx.event_payloads(spark, sf)
    k = ct.resolve_path(F.col("payload"), "k")
    bad = ct.resolve_path(F.col("payload"), "k.0")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.sum(F.try_variant_get(k, "$", "bigint")).alias("k_sum"),
        F.count_if(k.isNull()).alias("k_unresolved"),
        F.round(F.avg(bad.isNull().cast("double")), 6).alias("bad_path_unresolved_rate"))


@register("contract_catalog")
def q_contract_catalog(spark, sf):
    """Enabled rule ids per app with the traffic each app's rules will see."""
    defs = contract_defs()
    cat = spark.createDataFrame(
        [(a, ",".join(sorted(r.id for r in rs if r.enabled)), sum(1 for r in rs if r.enabled)) for a, rs in sorted(defs.items())],
        "app_id string, enabled_rules string, n_enabled int")
    traffic = fx.judged_pairs(spark, sf).groupBy("app_id").agg(F.count("*").alias("responses"))
    # cat is built on the driver from the contract files: one row per app, bounded by configuration
    return cat.join(traffic, "app_id", "left").select(
        "app_id", "enabled_rules", "n_enabled", F.coalesce("responses", F.lit(0)).cast("long").alias("responses"))


@register("contract_lint")
def q_contract_lint(spark, sf):
    """Lint findings for every rule file (valid and quarantined) with the responses each app receives."""
    import glob as _g
    import json as _j
    import os as _o
    rows = []
    for d in (ct.CONTRACT_DIR, ct.INVALID_CONTRACT_DIR):
        for path in sorted(_g.glob(_o.path.join(d, "*.json"))):
            name = _o.path.basename(path)
            try:
                doc = _j.load(open(path, encoding="utf-8"))
            except ValueError:
                rows.append((name, None, None, "malformed JSON"))
                continue
            for c in doc.get("contracts", []):
                for reason in ct.lint_contract(c):
                    rows.append((name, doc.get("app_id"), c.get("id"), reason))
    lint = spark.createDataFrame(rows, "file_name string, app_id string, contract_id string, reason string")
    traffic = fx.judged_pairs(spark, sf).groupBy("app_id").agg(F.count("*").alias("affected_responses"))
    # lint rows come from the rule files on the driver: bounded by configuration
    return lint.join(traffic, "app_id", "left").select(
        "file_name", "app_id", "contract_id", "reason",
        F.coalesce("affected_responses", F.lit(0)).cast("long").alias("affected_responses"))


# ------------------------------------------------------------------ 2.5 drift

DRIFT_CFG = dr.DriftConfig()
FIRST_TICK, LAST_TICK = "2024-01-08", "2024-01-31"


def _series(spark, sf):
    return dr.compliance_series(fx.compliance_scores(spark, sf))


@register("compliance_series")
def q_compliance_series(spark, sf):
    return _series(spark, sf).drop("ts")


@register("scores_in_window")
def q_scores_in_window(spark, sf):
    return dr.scores_in_window(_series(spark, sf), fx.AS_OF, 24).drop("ts")


@register("compliance_snapshot")
def q_compliance_snapshot(spark, sf):
    return dr.compliance_snapshot(_series(spark, sf), fx.AS_OF, 24)


@register("drift_check")
def q_drift_check(spark, sf):
    return dr.drift_check(_series(spark, sf), fx.AS_OF, DRIFT_CFG, apps=["app_0"])


@register("drift_all")
def q_drift_all(spark, sf):
    return dr.drift_check(_series(spark, sf), fx.AS_OF, DRIFT_CFG)


@register("drift_severity")
def q_drift_severity(spark, sf):
    return dr.drift_severity_counts(dr.drift_check(_series(spark, sf), fx.AS_OF, DRIFT_CFG))


@register("drift_summary")
def q_drift_summary(spark, sf):
    return dr.drift_summary(_series(spark, sf), fx.AS_OF, DRIFT_CFG)


@register("drift_timeline")
def q_drift_timeline(spark, sf):
    return dr.drift_timeline(_series(spark, sf), FIRST_TICK, LAST_TICK, DRIFT_CFG)


@register("drift_ticks")
def q_drift_ticks(spark, sf):
    """The check every 300 s, the gateway's setting, over the two days that end with the series."""
    return dr.drift_timeline(_series(spark, sf), "2024-01-29 00:00:00", fx.AS_OF, DRIFT_CFG, every_s=300)


@register("daily_compliance")
def q_daily_compliance(spark, sf):
    return dr.daily_compliance(_series(spark, sf))


@register("prune_retention")
def q_prune_retention(spark, sf):
    path = sio.scratch_path(spark, "retention")
    dr.write_compliance(_series(spark, sf), path, mode="overwrite")
    dr.prune_store(spark, path, fx.AS_OF, 20)
    kept = spark.read.parquet(path)
    return kept.groupBy(*dr.KEY).agg(F.count("*").alias("retained"), F.min("ts_us").alias("oldest_ts_us"))


# ------------------------------------------------------------------ 2.6 rate limits


def _admission(spark, sf):
    return rl.rate_admission(fx.rate_log(spark, sf), "user_id", "ts_ms", "event_id", fx.RATE_MAX, fx.RATE_WINDOW_S)


def _as_of_ms():
    import datetime as _dt
    t = _dt.datetime.strptime(fx.AS_OF, "%Y-%m-%d %H:%M:%S").replace(tzinfo=_dt.timezone.utc)
    return int(t.timestamp() * 1000)


@register("rate_admission")
def q_rate_admission(spark, sf):
    return _admission(spark, sf).select("key", "ts_ms", "request_id", "admitted", "count_after")


@register("rate_retry_after")
def q_rate_retry_after(spark, sf):
    return _admission(spark, sf).filter(~F.col("admitted")).select("key", "request_id", "retry_after", "retry_after_header")


@register("rate_peek")
def q_rate_peek(spark, sf):
    return rl.rate_peek(_admission(spark, sf), _as_of_ms(), fx.RATE_WINDOW_S, fx.RATE_MAX)


@register("rate_reset")
def q_rate_reset(spark, sf):
    log = rl.with_reset_epochs(fx.rate_log(spark, sf, exclude_signups=True), fx.rate_resets(spark, sf), "user_id", "ts_ms")
    keyed = log.withColumn("fold_key", F.concat_ws(":", F.col("user_id").cast("string"), F.col("reset_epoch").cast("string")))
    d = rl.rate_admission(keyed, "fold_key", "ts_ms", "event_id", fx.RATE_MAX, fx.RATE_WINDOW_S)
    return d.select("key", "request_id", "admitted", "count_after")


@register("rate_rollup")
def q_rate_rollup(spark, sf):
    return rl.rate_rollup(_admission(spark, sf))


@register("rate_fixed_vs_sliding")
def q_rate_fixed_vs_sliding(spark, sf):
    return rl.rate_fixed_vs_sliding(fx.rate_log(spark, sf), "user_id", "ts_ms", 3600)


@register("rate_leaky_bucket")
def q_rate_leaky_bucket(spark, sf):
    return rl.rate_leaky_bucket(fx.rate_log(spark, sf), "user_id", "ts_ms", "event_id", fx.LEAKY_RATE_PER_HOUR, fx.LEAKY_BURST)


# ------------------------------------------------------------------ 2.8 routing


def _resolved(spark, sf, policy):
    return rt.route_resolve(fx.request_log(spark, sf), fx.routes(spark), policy)


@register("route_resolve")
def q_route_resolve(spark, sf):
    return _resolved(spark, sf, "cost").select("request_id", "alias", "routed_provider", "canonical_model", "unknown_alias")


for _pol in ("cost", "latency", "priority"):
    QUERIES[f"route_{_pol}"] = (lambda p: (lambda spark, sf: _resolved(spark, sf, p).select(
        "request_id", "routed_provider", "canonical_model")))(_pol)


@register("route_fallback")
def q_route_fallback(spark, sf):
    failed = fx.request_log(spark, sf).filter(F.col("status") == 502).select("request_id", "alias", "provider")
    return rt.route_fallback(failed, fx.routes(spark), "cost")


@register("alias_upsert")
def q_alias_upsert(spark, sf):
    return rt.alias_upsert(fx.routes(spark), fx.alias_updates(spark, sf))


@register("model_catalog")
def q_model_catalog(spark, sf):
    return rt.model_catalog(rt.alias_upsert(fx.routes(spark), fx.alias_updates(spark, sf)))


@register("latency_ema")
def q_latency_ema(spark, sf):
    return rt.latency_ema(fx.latency_samples(spark, sf), fx.routes(spark))


@register("route_latency_asof")
def q_route_latency_asof(spark, sf):
    from gatelens.operators.ratelimit import epoch_ms
    log = fx.request_log(spark, sf).select("request_id", "alias", epoch_ms("ts").alias("ts_ms"))
    upd = rt.running_latency_ema(fx.latency_samples(spark, sf), fx.routes(spark))
    return rt.route_latency_asof(log, fx.routes(spark), upd)


@register("spend_by_model")
def q_spend_by_model(spark, sf):
    return mt.spend_by_model(fx.request_log(spark, sf), fx.routes(spark).select("alias", "provider", "cost"))


# ------------------------------------------------------------------ 2.9 metrics
@register("metrics_snapshot")
def q_metrics_snapshot(spark, sf):
    return mt.metrics_snapshot(fx.request_log(spark, sf))


@register("latency_percentiles")
def q_latency_percentiles(spark, sf):
    return mt.latency_percentiles(fx.request_log(spark, sf))


@register("provider_stats")
def q_provider_stats(spark, sf):
    return mt.provider_stats(fx.request_log(spark, sf))


@register("security_counts")
def q_security_counts(spark, sf):
    return mt.security_counts(det.guard_decisions(fx.attack_corpus(spark, sf)))


@register("contract_counts")
def q_contract_counts(spark, sf):
    v = ct.contract_tiered(fx.judged_pairs(spark, sf), contract_defs(), PAIR_KEYS, judge_raw="judge_raw")
    return mt.contract_counts(v, dr.drift_check(_series(spark, sf), fx.AS_OF, DRIFT_CFG), PAIR_KEYS)


@register("status_rollup")
def q_status_rollup(spark, sf):
    return mt.status_rollup(fx.request_log(spark, sf))


@register("upstream_error_classes")
def q_upstream_error_classes(spark, sf):
    return mt.upstream_error_classes(mt.attempt_log(fx.request_log(spark, sf)))


@register("request_funnel")
def q_request_funnel(spark, sf):
    return mt.request_funnel(fx.request_log(spark, sf))


@register("trace_rollup")
def q_trace_rollup(spark, sf):
    return mt.trace_rollup(mt.spans(fx.request_log(spark, sf)))


@register("usage_totals")
def q_usage_totals(spark, sf):
    return mt.usage_totals(fx.request_log(spark, sf))


# ------------------------------------------------------------------ 2.7 vectors

CACHE_CFG = vx.SearchConfig()


@register("cache_lookup")
def q_cache_lookup(spark, sf):
    return vx.cache_lookup(fx.query_vectors(spark, sf), fx.store_vectors(spark, sf), CACHE_CFG, payload="payload")


@register("cache_topk")
def q_cache_topk(spark, sf):
    cfg = vx.SearchConfig(threshold=0.6, k=3)
    m = vx.threshold_search(fx.query_vectors(spark, sf), fx.store_vectors(spark, sf), "query_id", "v", "entry_id", "v", cfg)
    return vx.top_k(m, 3).select("query_id", F.col("rank").cast("int").alias("rank"), "entry_id",
                                 vx.half_up("similarity", 6).alias("similarity"))


@register("cache_ttl")
def q_cache_ttl(spark, sf):
    cfg = vx.SearchConfig(ttl_s=fx.TTL_S)
    return vx.cache_lookup(fx.query_vectors(spark, sf), fx.store_vectors(spark, sf), cfg, q_time="asked_at", s_time="stored_at")


@register("cache_invalidate")
def q_cache_invalidate(spark, sf):
    store = fx.store_vectors(spark, sf)
    removed = store.filter(F.col("payload") == 1).select("entry_id")
    kept = store.join(removed, "entry_id", "left_anti")
    return vx.cache_lookup(fx.query_vectors(spark, sf), kept, CACHE_CFG)


@register("cache_stats")
def q_cache_stats(spark, sf):
    out = vx.cache_lookup(fx.query_vectors(spark, sf), fx.store_vectors(spark, sf), CACHE_CFG)
    return vx.cache_stats(out.withColumn("mix_group", (F.col("query_id") % 3).cast("int")), "mix_group")


@register("cache_capacity")
def q_cache_capacity(spark, sf):
    return vx.cache_capacity(fx.store_vectors(spark, sf), 300, "stored_at", "entry_id").select("entry_id", "stored_at")


def replay_stream(spark, sf):
    s = fx.store_vectors(spark, sf).select(F.col("entry_id").alias("item_id"), "v", F.col("stored_at").alias("t"))
    n = s.agg(F.max("item_id")).first()[0] + 1
    q = fx.query_vectors(spark, sf).select((F.col("query_id") + n).alias("item_id"), "v", F.col("asked_at").alias("t"))
    return s.unionByName(q)


@register("cache_replay")
def q_cache_replay(spark, sf):
    return vx.cache_replay(replay_stream(spark, sf), vx.SearchConfig(ttl_s=fx.TTL_S))


# ------------------------------------------------------------------ 2.1 / 2.2 sources, sinks, provider shapes


@register("shape_requests")
def q_shape_requests(spark, sf):
    return pv.shape_requests(fx.chat_requests(spark, sf))


@register("normalise_responses")
def q_normalise_responses(spark, sf):
    return pv.normalise_responses(*fx.raw_responses(spark, sf))


@register("assemble_chunks")
def q_assemble_chunks(spark, sf):
    return pv.assemble_chunks(fx.stream_lines(spark, sf))


@register("read_labelled_jsonl")
def q_read_labelled_jsonl(spark, sf):
    ld = fx.labelled_docs(spark, sf)
    lines = ld.select(F.to_json(F.struct("text", "label")).alias("value")).unionByName(
        ld.filter(F.col("doc_id") % 50 == 7).select(F.to_json(F.struct("text")).alias("value"))).unionByName(
        ld.filter(F.col("doc_id") % 50 == 7).select(F.lit("{not json").alias("value"))).unionByName(
        ld.filter(F.col("doc_id") % 50 == 8).select(F.lit("   ").alias("value")))
    path = sio.scratch_path(spark, "labelled")
    lines.write.mode("overwrite").text(path)
    good, bad = sio.read_labelled_jsonl(spark, path)
    g = sio.class_counts(good).select("label", F.lit(None).cast("string").alias("reason"), "n")
    b = bad.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(None).cast("int").alias("label"), "reason", "n")
    return g.unionByName(b)


@register("write_jsonl")
def q_write_jsonl(spark, sf):
    path = sio.scratch_path(spark, "jsonl")
    sio.write_jsonl(fx.labelled_docs(spark, sf).select("doc_id", "text", "label"), path)
    back = spark.read.schema("doc_id long, text string, label int").json(path)
    return back.select("doc_id", "label", F.length("text").alias("n_chars"))


@register("read_access_log")
def q_read_access_log(spark, sf):
    log = fx.request_log(spark, sf)
    upstream = F.col("status").isin(200, 422, 502)
    lines = log.select(
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1")).alias("remote_addr"),
        F.lit("POST").alias("method"), "uri", "status", (F.col("latency_ms") / 1000.0).alias("request_time"),
        (F.col("completion_tokens") * 4).alias("bytes_sent"),
        F.when(upstream, F.col("latency_ms") * 0.9 / 1000.0).alias("upstream_response_time"),
        F.lit("client/1.0").alias("http_user_agent"), F.concat(F.lit("req-"), F.col("request_id").cast("string")).alias("x_request_id"))
    path = sio.scratch_path(spark, "access")
    lines.write.mode("overwrite").json(path)
    a = sio.read_access_log(spark, path)
    return a.groupBy("status").agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"),
                                   F.max("request_time").alias("max_request_time"),
                                   F.count("upstream_response_time").alias("upstream_timed"))


@register("read_patterns")
def q_read_patterns(spark, sf):
    path = sio.scratch_path(spark, "rules")
    sio.write_patterns(spark, DEFAULT_RULES, path)
    rules = [r.asDict() for r in sio.read_patterns(spark, path).collect()]   # a rule file
    return det.pattern_rollup(det.pattern_scan(fx.attack_corpus(spark, sf), rules), rules)


@register("write_compliance")
def q_write_compliance(spark, sf):
    path = sio.scratch_path(spark, "compliance")
    sio.write_compliance(_series(spark, sf), path, mode="overwrite")
    back = spark.read.parquet(path)     # the whole store, one partition folder per day
    return back.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@register("write_eval_report")
def q_write_eval_report(spark, sf):
    s = fx.scored(spark, sf)
    path = sio.scratch_path(spark, "report")
    v = det.judge_verdicts(fx.verdict_texts(spark, sf))
    sio.write_eval_report(ev.precision_recall_f1(s), ev.pr_curve(s), ev.combined_recall(s, v), path)
    # read the document back and flatten its metrics block (round trip of the sink)
    doc = spark.read.json(path)
    return doc.select(F.inline("metrics")).select("model", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "accuracy")


# ------------------------------------------------------------------ 2.11 datasets


@register("attack_corpus")
def q_attack_corpus(spark, sf):
    return fx.attack_corpus(spark, sf)


@register("balance_classes")
def q_balance_classes(spark, sf):
    return ds.balance_classes(fx.labelled_docs(spark, sf), "label", "doc_id", 40, 42).select("doc_id", "label")


@register("seeded_shuffle")
def q_seeded_shuffle(spark, sf):
    return ds.seeded_shuffle(fx.labelled_docs(spark, sf), "doc_id", 42).select("doc_id", "label", "shuffle_key")


@register("stratified_split")
def q_stratified_split(spark, sf):
    return ds.stratified_split(fx.labelled_docs(spark, sf).select("doc_id", "label"), "label", "doc_id", 0.1, 0.1, 42)


@register("dedup_samples")
def q_dedup_samples(spark, sf):
    return ds.dedup_samples(fx.labelled_docs(spark, sf), "text", "doc_id").select("doc_id", "label", "copies")


@register("train_tier2")
def q_train_tier2(spark, sf):
    d = ds.dedup_samples(fx.labelled_docs(spark, sf), "text", "doc_id")
    sp = ds.stratified_split(d.select("doc_id", "text", "label"), "label", "doc_id", 0.1, 0.2, 42)
    _, report = ds.train_tier2(sp.filter(F.col("split") != "test"), sp.filter(F.col("split") == "test"))
    return report


@register("embed_prompts")
def q_embed_prompts(spark, sf):
    from gatelens.functions.embed import hashed_embeddings
    e = hashed_embeddings(pr.flatten_prompts(fx.conversations(spark, sf)), "prompt", "v", 64)
    return e.select("conv_id", F.size("v").alias("dim"),
                    F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


# ------------------------------------------------------------------ 2.12 streaming (availableNow runs, compared with batch)


def _latest_snapshot(sdf, keys, name):
    """Update-mode stream → latest row per key (read back as a batch)."""
    return stx.latest_snapshot(sdf, keys, name)[0]




@register("stream_guard")
def q_stream_guard(spark, sf):
    """The whole cascade on whole prompts, arriving in several files, one per micro-batch."""
    path = sio.scratch_path(spark, "prompts")
    fx.attack_corpus(spark, sf).repartition(3).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = spark.read.parquet(stx.run_to_parquet(det.guard_decisions(stream), "guard"))
    return out.select("conv_id", "label", "pattern_id", "severity", "ml_prob", "blocked", "tier_triggered", "reason")


@register("stream_contracts")
def q_stream_contracts(spark, sf):
    pairs_path = sio.scratch_path(spark, "pairs")
    fx.judged_pairs(spark, sf).write.mode("overwrite").parquet(pairs_path)
    stream = spark.readStream.schema(spark.read.parquet(pairs_path).schema).parquet(pairs_path)
    block_out, rest_out = sio.scratch_path(spark, "block-sink"), sio.scratch_path(spark, "flag-sink")
    defs = contract_defs()

    def sink(batch, batch_id):
        # the batch is evaluated once; a rule is told by (app, id), as one id may block in one app and flag in another
        v = ct.contract_tiered(batch, defs, PAIR_KEYS, judge_raw="judge_raw").persist()
        blocking = F.lit(False)
        for app, rules in defs.items():
            ids = [r.id for r in rules if r.action == "block"]
            blocking = blocking | ((F.col("app_id") == app) & F.col("contract_id").isin(*ids)) if ids else blocking
        v.filter(blocking).write.mode("overwrite").parquet(f"{block_out}/batch={batch_id}")
        v.filter(~blocking).write.mode("overwrite").parquet(f"{rest_out}/batch={batch_id}")
        v.unpersist()
    stx.run_foreach_batch(stream, "contracts", sink)
    return spark.read.parquet(block_out).unionByName(spark.read.parquet(rest_out)).drop("batch")


@register("stream_rate_admission")
def q_stream_rate_admission(spark, sf):
    s = stx.stream_rate_admission(stx.table_stream(spark, sf, "events"), fx.RATE_MAX, fx.RATE_WINDOW_S)
    out = spark.read.parquet(stx.run_to_parquet(s, "admission"))
    return out.select("key", "ts_ms", "request_id", "admitted", "count_after")


@register("stream_drift")
def q_stream_drift(spark, sf):
    scores = fx.compliance_scores(spark, sf, stx.table_stream(spark, sf, "events"))
    parts = _latest_snapshot(stx.hourly_partials(scores), ["app_id", "contract_id", "window"], "drift")
    as_of = F.lit(fx.AS_OF).cast("timestamp_ntz")
    start = stx.instant_to_ntz(F.col("window.start"))
    recent = start >= as_of - F.expr("INTERVAL 24 HOURS")
    base = parts.filter((start >= as_of - F.expr("INTERVAL 168 HOURS")) & (start < as_of))
    st = base.groupBy("app_id", "contract_id").agg(
        F.sum(F.when(recent, F.col("n")).otherwise(0)).alias("recent_n"), F.sum("n").alias("baseline_n"),
        dr._mean(F.sum(F.when(recent, F.col("units"))), F.sum(F.when(recent, F.col("n")))).alias("recent_avg"),
        dr._mean(F.sum("units"), F.sum("n")).alias("baseline_avg"))
    return st.filter(dr._is_alert(DRIFT_CFG)).select(*dr.KEY, *dr._alert_cols(DRIFT_CFG))


@register("stream_metrics")
def q_stream_metrics(spark, sf):
    log = fx.request_log(spark, sf, stx.table_stream(spark, sf, "events"))
    counts = stx.tumbling_counts(log, ["status"])
    snap = _latest_snapshot(counts, ["window", "status"], "metrics")
    return snap.select(F.date_format(stx.instant_to_ntz(F.col("window.start")), "yyyy-MM-dd HH:00:00").alias("hour"),
                       "status", "n")


@register("stream_metrics_sliding")
def q_stream_metrics_sliding(spark, sf):
    log = fx.request_log(spark, sf, stx.table_stream(spark, sf, "events"))
    snap = _latest_snapshot(stx.sliding_counts(log, ["status"]), ["window", "status"], "metrics-sliding")
    return snap.select(F.date_format(stx.instant_to_ntz(F.col("window.start")), "yyyy-MM-dd HH:mm:ss").alias("start"),
                       "status", "n")


@register("stream_dedup")
def q_stream_dedup(spark, sf):
    e = stx.table_stream(spark, sf, "events")
    dup = stx.table_stream(spark, sf, "events").filter(F.col("event_id") % 10 == 0)
    d = stx.stream_dedup(e.unionByName(dup), "event_id")
    out = spark.read.parquet(stx.run_to_parquet(d.drop("event_time"), "dedup"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_ids"))


@register("stream_latency_ema")
def q_stream_latency_ema(spark, sf):
    from gatelens.operators.ratelimit import epoch_ms
    log = mt.generated(fx.request_log(spark, sf, stx.table_stream(spark, sf, "events")))
    samples = log.select("alias", "provider", epoch_ms("ts").alias("ts_ms"), "request_id", "latency_ms")
    snap = _latest_snapshot(stx.stream_latency_ema(samples, fx.routes(spark)), ["alias", "provider"], "ema")
    return snap.select("alias", "provider", "samples", F.round("ema_ms", 6).alias("ema_ms"))


@register("score_histogram")
def q_score_histogram(spark, sf):
    """Unified P(injection) from every model's raw outputs, bucketed in tenths per model."""
    r = fx.raw_model_outputs(spark, sf)
    p = det.to_injection_prob(F.col("top_label"), F.col("top_score"))
    return (r.select("model", F.least(F.floor(p * 10), F.lit(9)).cast("int").alias("bucket"))
            .groupBy("model", "bucket").agg(F.count("*").alias("n")))
