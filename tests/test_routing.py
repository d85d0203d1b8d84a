from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatelens.operators import routing as rt
from gatelens.plans.fixtures import ROUTES_SCHEMA

ROUTES = [("m", "openai", "m-o", 2, 0.5, 300.0, 0), ("m", "anthropic", "m-a", 1, 0.5, 0.0, 1),
          ("m", "local", "m-l", 3, 0.1, 200.0, 2)]


def routes(spark):
    return spark.createDataFrame(ROUTES, ROUTES_SCHEMA)


def log(spark, rows):
    return spark.createDataFrame(rows, "request_id long, alias string, x_provider string")


def test_policies(spark):
    lg = log(spark, [(1, "m", None)])
    pick = {p: rt.route_resolve(lg, routes(spark), p).first()["routed_provider"] for p in rt.POLICIES}
    assert pick == {"cost": "local", "latency": "local", "priority": "anthropic"}


def test_unknown_alias_and_x_provider(spark):
    lg = log(spark, [(1, "nope", None), (2, "m", "openai"), (3, "m", "mistral")])
    r = {x["request_id"]: x for x in rt.route_resolve(lg, routes(spark), "cost").collect()}
    assert (r[1]["routed_provider"], r[1]["canonical_model"], r[1]["unknown_alias"]) == ("openai", "nope", True)
    assert r[2]["routed_provider"] == "openai"        # explicit provider narrows the candidates
    assert r[3]["routed_provider"] == "local"         # no candidate matches: ignored


def test_fallback(spark):
    f = spark.createDataFrame([(1, "m", "local"), (2, "zzz", "openai")], "request_id long, alias string, provider string")
    r = {x["request_id"]: x["fallback_provider"] for x in rt.route_fallback(f, routes(spark), "cost").collect()}
    assert r == {1: "openai", 2: None}                # cost tie → earliest registered


def test_ema_first_sample_then_smoothing(spark):
    rs = spark.createDataFrame([("m", "anthropic", "x", 1, 1.0, 0.0, 0)], ROUTES_SCHEMA)
    s = spark.createDataFrame([("m", "anthropic", 1, 1, 100.0), ("m", "anthropic", 2, 2, 200.0)],
                              "alias string, provider string, ts_ms long, request_id long, latency_ms double")
    assert rt.latency_ema(s, rs).first()["ema_ms"] == 120.0


def test_upsert_replaces_or_appends(spark):
    up = spark.createDataFrame([("m", "local", "new", 9, 0.0, 1.0), ("z", "openai", "z", 0, 1.0, 5.0)],
                               "alias string, provider string, canonical string, priority int, cost double, avg_latency double")
    out = {(r["alias"], r["provider"]): r for r in rt.alias_upsert(routes(spark), up).collect()}
    assert out[("m", "local")]["canonical"] == "new" and out[("m", "local")]["pos"] == 2
    assert out[("z", "openai")]["pos"] == 3 and len(out) == 4


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5 * 86_400_000), st.floats(1, 1000)), min_size=1, max_size=40),
       st.sampled_from([0.0, 250.0]))
def test_chunked_ema_equals_sequential(spark, samples, seed):
    rs = spark.createDataFrame([("m", "p", "x", 1, 1.0, seed, 0)], ROUTES_SCHEMA)
    rows = [("m", "p", t, i, float(x)) for i, (t, x) in enumerate(samples)]
    df = spark.createDataFrame(rows, "alias string, provider string, ts_ms long, request_id long, latency_ms double")
    got = {r["request_id"]: r["ema_after"] for r in rt.running_latency_ema(df, rs).collect()}
    e = seed
    for t, i, x in sorted((t, i, x) for _, _, t, i, x in rows):
        e = x if e == 0.0 else 0.2 * x + 0.8 * e
        assert abs(got[i] - e) <= 1e-9 * max(1.0, abs(e))


def _resolve_model(routes, alias, hint, policy):
    cands = [r for r in routes if r[0] == alias] or [(alias, "openai", alias, 0, 0.0, 0.0, 0)]
    if hint:
        narrowed = [c for c in cands if c[1] == hint]
        cands = narrowed or cands
    if len(cands) == 1:
        return cands[0][1]
    key = {"cost": lambda c: c[4], "priority": lambda c: c[3],
           "latency": lambda c: c[5] if c[5] > 0 else float("inf")}[policy]
    return min(cands, key=key)[1]          # Python min keeps the first of equal keys (registration order)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["m", "n"]), st.sampled_from(["openai", "anthropic", "local"]),
                          st.integers(0, 2), st.sampled_from([0.0, 0.5, 1.0]), st.sampled_from([0.0, 100.0, 200.0])),
                min_size=0, max_size=6, unique_by=lambda r: (r[0], r[1])),
       st.lists(st.tuples(st.sampled_from(["m", "n", "zz"]), st.sampled_from([None, "openai", "local", "mistral"])),
                min_size=1, max_size=10),
       st.sampled_from(["cost", "latency", "priority"]))
def test_resolution_matches_model(spark, rows, reqs, policy):
    routes = [(a, p, f"{a}-{p}", pr, c, lat, i) for i, (a, p, pr, c, lat) in enumerate(rows)]
    rdf = spark.createDataFrame(routes, ROUTES_SCHEMA)
    lg = log(spark, [(i, a, h) for i, (a, h) in enumerate(reqs)])
    got = {r["request_id"]: r["routed_provider"] for r in rt.route_resolve(lg, rdf, policy).collect()}
    for i, (a, h) in enumerate(reqs):
        assert got[i] == _resolve_model(routes, a, h, policy), (a, h, policy)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["m", "n"]), st.sampled_from(["openai", "anthropic", "local"])), max_size=6,
                unique=True),
       st.lists(st.tuples(st.sampled_from(["m", "n", "z"]), st.sampled_from(["openai", "local", "mistral"])), max_size=5,
                unique=True))
def test_upsert_matches_registry_semantics(spark, base, updates):
    routes = [(a, p, f"{a}-{p}", 1, 1.0, 10.0, i) for i, (a, p) in enumerate(base)]
    ups = [(a, p, f"new-{a}-{p}", 9, 0.5, 5.0) for a, p in updates]
    model = {(a, p): (c, pos) for a, p, c, _, _, _, pos in routes}
    nxt = max([r[6] for r in routes], default=-1)
    for a, p, c, *_ in sorted(ups):
        if (a, p) in model:
            model[(a, p)] = (c, model[(a, p)][1])
        else:
            nxt += 1
            model[(a, p)] = (c, nxt)
    rdf = spark.createDataFrame(routes, ROUTES_SCHEMA)
    udf = spark.createDataFrame(ups, "alias string, provider string, canonical string, priority int, cost double, avg_latency double")
    got = {(r["alias"], r["provider"]): (r["canonical"], r["pos"]) for r in rt.alias_upsert(rdf, udf).collect()}
    assert got == model


def test_ema_restarts_at_the_first_sample_after_zeros(spark):
    routes = spark.createDataFrame([("a", "p", 0.0), ("b", "p", 10.0)], "alias string, provider string, avg_latency double")
    day = 86_400_000
    rows = [("a", "p", i * day // 2, i, x) for i, x in enumerate([0.0, 0.0, 100.0, 0.0, 50.0])] + [("b", "p", 5, 9, 0.0)]
    samples = spark.createDataFrame(rows, "alias string, provider string, ts_ms long, request_id long, latency_ms double")
    got = {(r["alias"], r["request_id"]): r["ema_after"] for r in rt.running_latency_ema(samples, routes).collect()}
    want = {("a", 0): 0.0, ("a", 1): 0.0, ("a", 2): 100.0, ("a", 3): 80.0, ("a", 4): 74.0, ("b", 9): 8.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_last_update_of_a_pair_wins(spark):
    cols = "alias string, provider string, canonical string, priority int, cost double, avg_latency double"
    routes = spark.createDataFrame([("a", "p", "old", 1, 1.0, 1.0, 0)], cols + ", pos int")
    updates = spark.createDataFrame([("a", "p", "x", 2, 2.0, 2.0, 1), ("a", "p", "y", 3, 3.0, 3.0, 2), ("b", "q", "z", 4, 4.0, 4.0, 3)],
                                    cols + ", seq int")
    got = sorted((r["alias"], r["canonical"], r["pos"]) for r in rt.alias_upsert(routes, updates, "seq").collect())
    assert got == [("a", "y", 0), ("b", "z", 1)]
