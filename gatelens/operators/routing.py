"""Routing analytics: alias resolution, policies, fallback, alias registry upserts, latency EMA.

The alias table is a small dimension (one row per alias × provider, bounded by
configuration, never by traffic). It is reshaped to one array of candidates
per alias and broadcast, so resolving millions of requests is a map-side join
plus higher-order functions: no shuffle of the request log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.operators.ordered import sorted_fold

POLICIES = ("cost", "latency", "priority")
CAND = "struct<provider:string,canonical:string,priority:int,cost:double,avg_latency:double,pos:int>"


def policy_key(c: Column, policy: str) -> Column:
    if policy == "cost":
        return c["cost"]
    if policy == "latency":   # unmeasured (0) sorts last
        return F.when(c["avg_latency"] > 0, c["avg_latency"]).otherwise(F.lit(float("inf")))
    if policy == "priority":
        return c["priority"].cast("double")
    raise ValueError(policy)


def pick(cands: Column, policy: str) -> Column:
    """Candidate with the smallest policy key; ties → earliest registered (pos)."""
    ranked = F.transform(cands, lambda c: F.struct(policy_key(c, policy).alias("k"), c["pos"].alias("p"), c.alias("c")))
    return F.array_min(ranked)["c"]


def candidates_by_alias(routes: DataFrame) -> DataFrame:
    return routes.groupBy("alias").agg(F.collect_list(F.struct(
        "provider", "canonical", "priority", "cost", "avg_latency", "pos")).cast(f"array<{CAND}>").alias("cands"))


def _join_candidates(log: DataFrame, routes: DataFrame) -> DataFrame:
    return log.join(candidates_by_alias(routes), "alias", "left")


def route_resolve(log: DataFrame, routes: DataFrame, policy: str = "cost", default_provider: str = "openai",
                  x_provider: str = "x_provider") -> DataFrame:
    """Provider and canonical model per request. Unknown alias → default provider with the alias as model;
    ``x_provider`` narrows the candidates only when one of them matches."""
    j = _join_candidates(log, routes)
    default = F.array(F.struct(F.lit(default_provider).alias("provider"), F.col("alias").alias("canonical"),
                               F.lit(0).alias("priority"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("avg_latency"),
                               F.lit(0).alias("pos")).cast(CAND))
    cands = F.coalesce(F.col("cands"), default)
    narrowed = F.filter(cands, lambda c: c["provider"] == F.col(x_provider))
    use = F.when(F.col(x_provider).isNotNull() & (F.size(narrowed) > 0), narrowed).otherwise(cands)
    chosen = pick(use, policy)
    return j.withColumn("_sel", chosen).select(
        *log.columns, F.col("_sel.provider").alias("routed_provider"), F.col("_sel.canonical").alias("canonical_model"),
        F.col("cands").isNull().alias("unknown_alias"))


def route_fallback(failed: DataFrame, routes: DataFrame, policy: str = "cost", failed_col: str = "provider") -> DataFrame:
    """Alternative provider after a failure: candidates without the failed one, then the policy; none → NULL."""
    j = _join_candidates(failed, routes)
    alts = F.filter(F.coalesce(F.col("cands"), F.array().cast(f"array<{CAND}>")), lambda c: c["provider"] != F.col(failed_col))
    sel = F.when(F.size(alts) > 0, pick(alts, policy))
    return j.withColumn("_sel", sel).select(*failed.columns, F.col("_sel.provider").alias("fallback_provider"),
                                            F.col("_sel.canonical").alias("fallback_canonical"))


def alias_upsert(routes: DataFrame, updates: DataFrame, order_col: str | None = None) -> DataFrame:
    """Replace on (alias, provider), else append after the existing entries (MERGE semantics).

    Of several updates of one pair the last by ``order_col`` counts (without one, the last in the frame's order)."""
    fields = ("canonical", "priority", "cost", "avg_latency")
    latest = updates.withColumn("_order", F.col(order_col) if order_col else F.monotonically_increasing_id()) \
        .groupBy("alias", "provider").agg(F.max_by(F.struct(*fields), "_order").alias("u"))
    u = latest.select("alias", "provider", "u.*").select(*[F.col(c).alias("u_" + c) for c in ("alias", "provider", "canonical", "priority", "cost", "avg_latency")])
    j = routes.join(u, (routes["alias"] == u["u_alias"]) & (routes["provider"] == u["u_provider"]), "full_outer")
    max_pos = routes.agg(F.max("pos")).first()[0]   # scalar from the (small) registry
    j = j.withColumn("m", F.lit(-1 if max_pos is None else max_pos))
    new_rank = F.row_number().over(Window.partitionBy(F.col("pos").isNull()).orderBy("u_alias", "u_provider"))
    return j.select(
        F.coalesce("u_alias", "alias").alias("alias"), F.coalesce("u_provider", "provider").alias("provider"),
        F.coalesce("u_canonical", "canonical").alias("canonical"), F.coalesce("u_priority", "priority").cast("int").alias("priority"),
        F.coalesce("u_cost", "cost").alias("cost"), F.coalesce("u_avg_latency", "avg_latency").alias("avg_latency"),
        F.coalesce(F.col("pos"), F.col("m") + new_rank).cast("int").alias("pos"))


def model_catalog(routes: DataFrame) -> DataFrame:
    """One row per alias:provider (first registration wins), alias-sorted."""
    w = Window.partitionBy("alias", "provider").orderBy("pos")
    return (routes.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select(F.col("alias").alias("id"), F.col("provider").alias("owned_by"), F.col("canonical").alias("canonical_model"),
                    F.col("cost").alias("cost_per_1k_tokens"), F.col("avg_latency").alias("avg_latency_ms"))
            .orderBy("id", "owned_by"))


# ------------------------------------------------------------------ latency EMA
# The EMA is a linear recurrence, so it parallelises over time: each (alias, provider, day) chunk is
# folded from a zero state in parallel, a small (key, day) carry table chains the chunks, and each
# sample's value is   ema = local + (1 - alpha) ** pos * carry_in   (pos = samples so far in the chunk).
# A key with most of the traffic is therefore spread over all its days instead of one task.
CHUNK_MS = 86_400_000


def _local_step(alpha: float):
    keep = 1 - alpha

    def step(state, key, r):
        local, pos = state if state is not None else (0.0, 0)
        before, pos_before = local, pos
        local = alpha * float(r["latency_ms"]) + keep * local
        pos += 1
        return (local, pos), {"alias": r["alias"], "provider": r["provider"], "chunk": int(r["chunk"]),
                              "ts_ms": int(r["ts_ms"]), "request_id": int(r["request_id"]),
                              "local_before": before, "pos_before": pos_before, "local": local, "pos": pos}
    return step


LOCAL_SCHEMA = ("alias string, provider string, chunk long, ts_ms long, request_id long, local_before double, "
                "pos_before long, local double, pos long")


def _carry_step(keep: float):
    def step(state, key, r):
        e = float(r["e_init"]) if state is None else state
        out = {"alias": r["alias"], "provider": r["provider"], "chunk": int(r["chunk"]), "carry_in": e}
        return float(r["l_end"]) + keep ** int(r["n"]) * e, out
    return step


def running_latency_ema(samples: DataFrame, routes: DataFrame, alpha: float = 0.2) -> DataFrame:
    """EMA per (alias, provider) before/after every successful sample, seeded with the registered average.

    An average of exactly 0 is replaced by the next sample, so a 0 seed stays 0 through leading samples of 0 and
    starts at the first other one. Unregistered pairs are ignored."""
    keep = 1 - alpha
    pair, place = ["alias", "provider"], F.struct("ts_ms", "request_id")
    seeds = routes.select("alias", "provider", F.col("avg_latency").alias("seed"))
    every = samples.join(seeds, pair)
    starts = every.where("seed = 0 AND latency_ms <> 0").groupBy(*pair).agg(F.min(place).alias("start"))
    every = every.join(starts, pair, "left")
    leading = (F.col("seed") == 0) & F.coalesce(place < F.col("start"), F.lit(True))
    zeros = every.where(leading).select(*pair, "ts_ms", "request_id", F.lit(0.0).alias("ema_before"), F.lit(0.0).alias("ema_after"))
    s = every.where(~leading).drop("start").withColumn("chunk", F.floor(F.col("ts_ms") / CHUNK_MS).cast("long"))
    local = sorted_fold(s.select("alias", "provider", "chunk", "ts_ms", "request_id", "latency_ms"),
                        ["alias", "provider", "chunk"], ["ts_ms", "request_id"], _local_step(alpha), LOCAL_SCHEMA)
    first = s.groupBy("alias", "provider").agg(F.min_by("latency_ms", F.struct("ts_ms", "request_id")).alias("x1"),
                                               F.first("seed").alias("seed"))
    ends = local.groupBy("alias", "provider", "chunk").agg(F.max_by("local", "pos").alias("l_end"),
                                                           F.max("pos").alias("n"))
    summary = ends.join(first, ["alias", "provider"]).withColumn(
        "e_init", F.when(F.col("seed") == 0.0, F.col("x1")).otherwise(F.col("seed")))
    carry = sorted_fold(summary.select("alias", "provider", "chunk", "l_end", "n", "e_init"), ["alias", "provider"],
                        ["chunk"], _carry_step(keep), "alias string, provider string, chunk long, carry_in double")
    j = local.join(carry, ["alias", "provider", "chunk"])
    return j.select("alias", "provider", "ts_ms", "request_id",
                    (F.col("local_before") + F.pow(F.lit(keep), F.col("pos_before")) * F.col("carry_in")).alias("ema_before"),
                    (F.col("local") + F.pow(F.lit(keep), F.col("pos")) * F.col("carry_in")).alias("ema_after")) \
        .unionByName(zeros)


def latency_ema(samples: DataFrame, routes: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Final EMA per registered (alias, provider); pairs without samples keep their registered value."""
    run = running_latency_ema(samples, routes, alpha)
    last = run.groupBy("alias", "provider").agg(F.max_by("ema_after", F.struct("ts_ms", "request_id")).alias("ema"),
                                                F.count("*").alias("samples"))
    return (routes.select("alias", "provider", "avg_latency").join(last, ["alias", "provider"], "left")
            .select("alias", "provider", F.coalesce("samples", F.lit(0)).cast("long").alias("samples"),
                    F.round(F.coalesce("ema", "avg_latency"), 6).alias("ema_ms")))


def route_latency_asof(log: DataFrame, routes: DataFrame, ema_updates: DataFrame) -> DataFrame:
    """LATENCY policy per request using each candidate's EMA as known just before the request.

    As-of join without a range join: requests and EMA updates are unioned per alias and day;
    ``last(ignorenulls)`` over the time-ordered rows gives the intraday value, and a small
    (alias, provider, day) table carries the previous days' last value forward.
    """
    providers = [r[0] for r in routes.select("provider").distinct().orderBy("provider").collect()]
    day = F.floor(F.col("ts_ms") / 86_400_000)
    upd = ema_updates.select("alias", "provider", "ts_ms", "request_id", F.col("ema_after").alias("ema"), F.lit(1).alias("kind"))
    req = log.select("alias", F.lit(None).cast("string").alias("provider"), "ts_ms", "request_id",
                     F.lit(None).cast("double").alias("ema"), F.lit(0).alias("kind"))
    u = upd.unionByName(req).withColumn("day", day)
    w = Window.partitionBy("alias", "day").orderBy("ts_ms", "request_id", "kind").rowsBetween(Window.unboundedPreceding, 0)
    for p in providers:
        u = u.withColumn(f"e_{p}", F.last(F.when((F.col("kind") == 1) & (F.col("provider") == p), F.col("ema")), True).over(w))
    # end-of-day values carried forward over days (table size: aliases x providers x active days)
    eod = (upd.withColumn("day", day).groupBy("alias", "provider", "day")
              .agg(F.max_by("ema", F.struct("ts_ms", "request_id")).alias("eod")).withColumn("k", F.lit(1)))
    req_days = u.filter("kind = 0").select("alias", "day").distinct()
    asks = req_days.join(routes.select("alias", "provider").distinct(), "alias") \
                   .select("alias", "provider", "day", F.lit(None).cast("double").alias("eod"), F.lit(0).alias("k"))
    wd = Window.partitionBy("alias", "provider").orderBy("day", "k").rowsBetween(Window.unboundedPreceding, 0)
    carried = (asks.unionByName(eod).withColumn("prev", F.last("eod", True).over(wd)).filter("k = 0"))
    prevs = carried.groupBy("alias", "day").pivot("provider", providers).agg(F.first("prev"))
    r = u.filter("kind = 0").join(prevs, ["alias", "day"], "left")
    j = _join_candidates(r.drop("provider"), routes)
    known = {p: F.coalesce(F.col(f"e_{p}"), F.col(p) if p in prevs.columns else F.lit(None)) for p in providers}

    def current(c):
        val = F.lit(None).cast("double")
        for p in providers:
            val = F.when(c["provider"] == p, known[p]).otherwise(val)
        return F.coalesce(val, c["avg_latency"])

    cands = F.transform(F.col("cands"), lambda c: c.withField("avg_latency", current(c)))
    chosen = F.when(F.col("cands").isNotNull(), pick(cands, "latency"))
    return j.select("request_id", "alias", chosen["provider"].alias("routed_provider"),
                    F.round(chosen["avg_latency"], 6).alias("ema_used_ms"))
