import numpy as np
from pyspark.sql import functions as F

from gatelens.operators import vectors as vx
from test_vectors import brute, frames, unit


def _sides(spark, n):
    side = spark.range(n).select("id", F.array(F.lit(1.0)).alias("v"), F.col("id").cast("double").alias("t"))
    return side.toDF("qid", "qv", "qt"), side


def test_copies_of_a_vector_do_not_grow_with_the_table(spark):
    """A vector used to be copied for every block of the store (and every ring of every pivot)."""
    cfg = vx.SearchConfig(block_size=16, slices=4)
    for n in (200, 2000):
        probes, members, keys = vx.dealt(*_sides(spark, n), cfg, False)
        assert (probes.count(), members.count(), keys) == (4 * n, 4 * n, ["blk", "qc"])
    # entries that expire: its own bucket and the one before
    probes, members, keys = vx.dealt(*_sides(spark, 2000), vx.SearchConfig(ttl_s=10.0), True)
    assert (probes.count(), members.count(), keys) == (3990, 2000, ["tb", "blk", "qc"])


def test_parts_are_bounded_in_rows(spark):
    probes, members, keys = vx.dealt(*_sides(spark, 4000), vx.SearchConfig(block_size=16, slices=2, slice_rows=200), False)
    assert members.select("blk").distinct().count() == 20
    assert members.groupBy(*keys).count().agg(F.max("count")).first()[0] < 400


def test_every_query_meets_every_entry_across_parts_and_rings(spark):
    """Clustered vectors, so that blocks out of reach are left out; copies tie and the smallest id wins; top 3 by similarity."""
    rng = np.random.default_rng(11)
    centres = unit(rng, 6, 12)
    store = np.repeat(centres, 60, axis=0) + 0.08 * rng.normal(size=(360, 12))
    store = np.vstack([store / np.linalg.norm(store, axis=1, keepdims=True)] * 2)
    queries = unit(rng, 40, 12)
    queries = np.vstack([queries, store[:80:2]])
    s, q = frames(spark, store, queries)
    cfg = vx.SearchConfig(threshold=0.9, pivots=5, block_size=16, slices=3)
    got = {r["query_id"]: r["entry_id"] for r in vx.cache_lookup(q, s, cfg).collect()}
    assert got == brute(store, queries, 0.9)
    cfg = vx.SearchConfig(threshold=0.5, pivots=5, block_size=16, slices=3, k=3)
    top = vx.top_k(vx.threshold_search(q, s, "query_id", "v", "entry_id", "v", cfg, query_chunk=7), 3).collect()
    sims = queries @ store.T
    for i in range(len(queries)):
        want = sorted((x for x in sims[i] if x >= 0.5), reverse=True)[:3]
        assert np.allclose([r["similarity"] for r in sorted(top, key=lambda r: r["rank"]) if r["query_id"] == i], want)


def test_null_vectors_match_nothing(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "entry_id long, v array<double>")
    q = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], "query_id long, v array<double>")
    got = {r["query_id"]: r["entry_id"] for r in vx.cache_lookup(q, s).collect()}
    assert got == {1: None, 2: 1}
