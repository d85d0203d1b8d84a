import numpy as np
from pyspark.sql import functions as F

from gatelens.operators import vectors as vx


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frames(spark, store, queries):
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(store)], "entry_id long, v array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, v array<double>")
    return s, q


def brute(store, queries, thr):
    sims = queries @ store.T
    out = {}
    for i, row in enumerate(sims):
        j = [k for k in np.argsort(-row, kind="stable") if row[k] >= thr]
        out[i] = int(j[0]) if j else None
    return out


def test_exact_threshold_search_with_a_hot_cluster(spark):
    """A third of the store sits in one tight cluster (one hot cell): results still equal brute force."""
    rng = np.random.default_rng(7)
    d = 16
    centre = unit(rng, 1, d)[0]
    hot = centre + 0.05 * rng.normal(size=(200, d))
    hot /= np.linalg.norm(hot, axis=1, keepdims=True)
    store = np.vstack([hot, unit(rng, 400, d)])
    queries = np.vstack([store[::7] + 0.02 * rng.normal(size=store[::7].shape), unit(rng, 50, d)])
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    s, q = frames(spark, store, queries)
    cfg = vx.SearchConfig(threshold=0.92, pivots=8, block_size=32)
    got = {r["query_id"]: r["entry_id"] for r in vx.cache_lookup(q, s, cfg).collect()}
    assert got == brute(store, queries, 0.92)


def test_hit_miss_invalidate_and_stats(spark):
    rng = np.random.default_rng(1)
    store = unit(rng, 50, 8)
    s, q = frames(spark, store, store[:5])
    out = vx.cache_lookup(q, s, vx.SearchConfig(pivots=4))
    assert out.filter("hit").count() == 5
    kept = s.filter(F.col("entry_id") >= 3)
    out2 = vx.cache_lookup(q, kept, vx.SearchConfig(pivots=4))
    assert out2.filter("hit").count() == 2
    st = vx.cache_stats(out2.withColumn("g", F.lit(1)), "g").first()
    assert (st["hits"], st["misses"], st["hit_rate"]) == (2, 3, 0.4)


def test_ttl_expires_entries(spark):
    v = [1.0, 0.0]
    s = spark.createDataFrame([(1, v, 0.0)], "entry_id long, v array<double>, stored_at double")
    q = spark.createDataFrame([(1, v, 100.0), (2, v, 4000.0)], "query_id long, v array<double>, asked_at double")
    out = {r["query_id"]: r["hit"] for r in vx.cache_lookup(q, s, vx.SearchConfig(ttl_s=3600, pivots=1),
                                                            q_time="asked_at", s_time="stored_at").collect()}
    assert out == {1: True, 2: False}


def test_replay_matches_sequential_cache(spark):
    rng = np.random.default_rng(3)
    base = unit(rng, 20, 8)
    items = np.vstack([base, base + 0.01 * rng.normal(size=base.shape), base[:5]])
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    t = np.arange(len(items), dtype=float) * 100.0
    df = spark.createDataFrame([(i, items[i].tolist(), float(t[i])) for i in range(len(items))], "item_id long, v array<double>, t double")
    got = {r["item_id"]: r["hit"] for r in vx.cache_replay(df, vx.SearchConfig(pivots=4, ttl_s=3000)).collect()}
    stored, want = [], {}
    for i in range(len(items)):
        hit = any(t[i] - t[j] < 3000 and items[i] @ items[j] >= 0.92 for j in stored)
        want[i] = hit
        if not hit:
            stored.append(i)
    assert got == want


def test_empty_store_misses_and_entries_coexist(spark):
    rng = np.random.default_rng(5)
    store = unit(rng, 3, 8)
    s, q = frames(spark, store, store)
    empty = s.limit(0)
    out = vx.cache_lookup(q, empty, vx.SearchConfig(pivots=2)).collect()
    assert len(out) == 3 and not any(r["hit"] for r in out)
    got = {r["query_id"]: r["entry_id"] for r in vx.cache_lookup(q, s, vx.SearchConfig(pivots=2)).collect()}
    assert got == {0: 0, 1: 1, 2: 2}


def test_replay_decides_chains_of_any_length_in_time_order(spark):
    """Each item resembles only its neighbours in time: every second one is stored; ids run against time."""
    import math
    step = math.acos(0.95)
    rows = [(100 - i, [math.cos(i * step), math.sin(i * step)], float(i)) for i in range(14)]
    stream = spark.createDataFrame(rows, "item_id long, v array<double>, t double")
    got = {r["item_id"]: r["hit"] for r in vx.cache_replay(stream, vx.SearchConfig(threshold=0.94, pivots=2, ttl_s=None)).collect()}
    assert got == {100 - i: i % 2 == 1 for i in range(14)}


def test_replay_stores_only_what_passed_its_contracts(spark):
    rows = [(1, [1.0, 0.0], 0.0, False), (2, [1.0, 0.0], 1.0, True), (3, [1.0, 0.0], 2.0, True)]
    stream = spark.createDataFrame(rows, "item_id long, v array<double>, t double, passed boolean")
    got = {r["item_id"]: r["hit"] for r in vx.cache_replay(stream, vx.SearchConfig(pivots=1), storable_col="passed").collect()}
    assert got == {1: False, 2: False, 3: True}
