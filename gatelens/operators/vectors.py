"""Semantic response reuse: exact thresholded cosine search over unit vectors, at scale.

No cross join and no per-pair rows. Both sides are cut into parts by hashed ids, and each part of the queries meets each
part of the store in one cogrouped task, so a vector is shuffled once per part of the other side: at most ``slices``
times, whatever the size, until a part reaches the ``slice_rows`` that a task may hold (beyond that, copies grow with
the table, as an exact search in bounded memory must). Entries that expire are also kept apart by time bucket, so a
vector meets its own and the next bucket only.

Inside a task the triangle inequality saves products: members are sorted by their nearest pivot (some members of the
part) and their distance from it, in blocks of ``block_size``; a query can only reach cosine >= thr with members whose
distance from the pivot differs from its own by at most r = sqrt(2 - 2*thr), and other blocks are not scored for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.numeric import half_up


@dataclass(frozen=True)
class SearchConfig:
    threshold: float = 0.92       # fixed value: cache similarity threshold
    pivots: int = 16
    block_size: int = 1024
    k: int = 1
    ttl_s: float | None = None    # entries live for ttl seconds after being stored (None: forever)
    eps: float = 1e-9
    slices: int = 16              # parts of either side of a search, of block_size rows at least
    slice_rows: int = 131_072     # a part never holds more, on average


def normalize(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Unit-length double array (JVM-side higher-order functions)."""
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # the norm as an array of its own: inside a lambda it would be taken anew for every element
    return df.withColumn(out or col, F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n))


MATCH_SCHEMA = "query_id long, entry_id long, similarity double"
MARGIN = 1e-7                # rounding of a distance near 0, sqrt(2 - 2 cos)
HELD_MATCHES = 1_000_000     # matches of a query chunk that are held before all but the k best of each query are dropped


def _parts(rows: Column, cfg: SearchConfig) -> Column:
    """Parts that a side of so many rows is cut into: of ``block_size`` rows at least, up to ``slices`` of them, more only
    where a part would hold over ``slice_rows`` rows."""
    some = F.least(F.ceil(rows / F.lit(cfg.block_size)), F.lit(cfg.slices).cast("long"))
    return F.greatest(F.lit(1).cast("long"), some, F.ceil(rows / F.lit(cfg.slice_rows)))


def dealt(queries: DataFrame, store: DataFrame, cfg: SearchConfig, timed: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows (qid, qv, qt) and (id, v, t) of both sides with the keys of the groups they meet in: the part of the store, the
    part of the queries and, if entries expire, the time bucket. A row is copied once for each part of the other side."""
    q_rows, s_rows = F.count("*").alias("q_rows"), F.count("*").alias("s_rows")
    if timed:       # an entry of bucket b is live for queries of the buckets b and b + 1 only
        bucket = lambda t: F.floor(F.col(t) / cfg.ttl_s).cast("long")
        store = store.withColumn("tb", bucket("t"))
        queries = queries.withColumn("tb", F.explode(F.array(bucket("qt") - 1, bucket("qt"))))
        sizes = store.groupBy("tb").agg(s_rows).join(queries.groupBy("tb").agg(q_rows), "tb")
        store, queries = store.join(sizes, "tb"), queries.join(sizes, "tb")
    else:
        n_q, n_s = queries.agg(q_rows).first()[0], store.agg(s_rows).first()[0]
        store, queries = (x.withColumns({"q_rows": F.lit(n_q), "s_rows": F.lit(n_s)}) for x in (store, queries))
    s_parts, q_parts = _parts(F.col("s_rows"), cfg), _parts(F.col("q_rows"), cfg)

    def every(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))

    keys = [*(["tb"] if timed else []), "blk", "qc"]
    store = store.withColumns({"blk": F.pmod(F.xxhash64("id"), s_parts), "qc": every(q_parts)})
    queries = queries.withColumns({"qc": F.pmod(F.xxhash64("qid"), q_parts), "blk": every(s_parts)})
    return queries.select(*keys, "qid", "qv", "qt"), store.select(*keys, "id", "v", "t"), keys


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = pc.list_flatten(vectors).to_numpy()
    return flat.reshape(len(vectors), len(flat) // len(vectors))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _rings(m: np.ndarray, cfg: SearchConfig) -> tuple[np.ndarray, list[tuple[int, np.ndarray, float, float]]]:
    """Some members as pivots, and the members in blocks: (nearest pivot, rows, least and largest distance from it)."""
    n = max(1, min(cfg.pivots, math.ceil(len(m) / cfg.block_size)))
    pivots = m[np.linspace(0, len(m) - 1, n).astype(int)]
    d = _distances(m, pivots)
    near = d.argmin(axis=1)
    d = d[np.arange(len(m)), near]
    order = np.lexsort((d, near))
    out = []
    for p in range(n):
        own = order[near[order] == p]
        out += [(p, rows, d[rows].min(), d[rows].max()) for rows in np.split(own, range(cfg.block_size, len(own), cfg.block_size)) if len(rows)]
    return pivots, out


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, entry, similarity) of each query."""
    query, entry, sim = (np.concatenate(x) for x in zip(*found))
    if k >= len(query):
        return query, entry, sim
    order = np.lexsort((entry, -sim, query))
    query = query[order]
    first = np.concatenate(([True], query[1:] != query[:-1]))
    at = np.arange(len(query))
    keep = at - np.maximum.accumulate(np.where(first, at, 0)) < k
    return query[keep], entry[order][keep], sim[order][keep]


def threshold_search(queries: DataFrame, store: DataFrame, q_id: str, q_vec: str, s_id: str, s_vec: str,
                     cfg: SearchConfig = SearchConfig(), q_time: str | None = None, s_time: str | None = None,
                     exclude_self: bool = False, earlier_only: bool = False, query_chunk: int = 4096) -> DataFrame:
    """All (query, entry, sim) with cos >= threshold, best ``k`` per query and part of the store (exact).

    Work unit: a part of the store with a part of the queries, scored by matrix products of at most ``block_size``
    members and ``query_chunk`` queries in a cogrouped Arrow function; a query meets no member of a block out of its reach.
    With ``ttl_s``/times: an entry is live for a query when 0 <= t_q - t_s < ttl.
    ``earlier_only``: entries must be strictly earlier than the query in (time, id) order. A null vector matches nothing.
    """
    r = math.sqrt(max(2.0 - 2.0 * cfg.threshold, 0.0))
    ordered = s_time is not None and q_time is not None
    timed = cfg.ttl_s is not None and ordered

    def side(df: DataFrame, key: str, vec: str, time: str | None, names: list[str]) -> DataFrame:
        t = (F.col(time) if time else F.lit(None)).cast("double")
        return df.select(*(c.alias(n) for c, n in zip((F.col(key).cast("long"), F.col(vec), t), names)))

    probes, members, keys = dealt(side(queries, q_id, q_vec, q_time, ["qid", "qv", "qt"]),
                                  side(store, s_id, s_vec, s_time if ordered else None, ["id", "v", "t"]), cfg, timed)
    thr, k, ttl = cfg.threshold, cfg.k, cfg.ttl_s

    def chunk(qm: np.ndarray, qids: np.ndarray, qt: np.ndarray, m: np.ndarray, ids: np.ndarray, ts: np.ndarray,
              pivots: np.ndarray, rings: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        d = _distances(qm, pivots)
        for p, rows, low, high in rings:
            far = (d[:, p] > high + r + cfg.eps + MARGIN) | (d[:, p] < low - r - cfg.eps - MARGIN)
            near = np.flatnonzero(~far)
            if not len(near):
                continue
            sims = (qm[near] if far.any() else qm) @ m[rows].T         # queries x members
            qi, mi = np.nonzero(sims >= thr)
            sim, qi, mi = sims[qi, mi], near[qi], rows[mi]
            ok = np.ones(len(sim), bool)
            if exclude_self:
                ok &= ids[mi] != qids[qi]
            if timed:
                ok &= (qt[qi] - ts[mi] >= 0) & (qt[qi] - ts[mi] < ttl)
            if earlier_only and ordered:
                ok &= (ts[mi] < qt[qi]) | ((ts[mi] == qt[qi]) & (ids[mi] < qids[qi]))
            elif earlier_only:
                ok &= ids[mi] < qids[qi]
            yield qids[qi[ok]], ids[mi[ok]], sim[ok]

    def score(q: pa.Table, m: pa.Table) -> pa.Table:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        found = [none]
        q, m = q.filter(pc.is_valid(q["qv"])), m.filter(pc.is_valid(m["v"]))
        if q.num_rows and m.num_rows:
            qm, mm = _matrix(q["qv"]), _matrix(m["v"])
            qids, ids, qt, ts = (c.to_numpy() for c in (q["qid"], m["id"], q["qt"], m["t"]))
            pivots, rings = _rings(mm, cfg)
            for a in range(0, len(qm), query_chunk):
                b, held = a + query_chunk, [none]
                for part in chunk(qm[a:b], qids[a:b], qt[a:b], mm, ids, ts, pivots, rings):
                    held.append(part)
                    if sum(len(x[0]) for x in held) > HELD_MATCHES:
                        held = [_best(held, k)]
                found.append(_best(held, k))
        return pa.table(dict(zip(("query_id", "entry_id", "similarity"), _best(found, k))))

    return probes.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(score, MATCH_SCHEMA)


def top_k(matches: DataFrame, k: int) -> DataFrame:
    """k best entries per query (similarity desc, entry id asc); a window group limit keeps it per partition."""
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("entry_id"))
    return matches.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cache_lookup(queries: DataFrame, store: DataFrame, cfg: SearchConfig = SearchConfig(),
                 q_id: str = "query_id", q_vec: str = "v", s_id: str = "entry_id", s_vec: str = "v",
                 payload: str | None = None, **kw) -> DataFrame:
    """Top-1 live entry per query; hit iff cosine >= threshold. Misses keep NULL entry/similarity."""
    m = top_k(threshold_search(queries, store, q_id, q_vec, s_id, s_vec, cfg, **kw), 1).drop("rank")
    out = queries.select(F.col(q_id).alias("query_id")).join(m, "query_id", "left")
    if payload:
        out = out.join(store.select(F.col(s_id).alias("entry_id"), F.col(payload).alias("payload")), "entry_id", "left")
    return out.select("query_id", "entry_id", half_up("similarity", 6).alias("similarity"),
                      F.col("entry_id").isNotNull().alias("hit"), *(["payload"] if payload else []))


def cache_stats(outcomes: DataFrame, by: str) -> DataFrame:
    h = F.count_if("hit")
    m = F.count_if(~F.col("hit"))
    return outcomes.groupBy(by).agg(h.alias("hits"), m.alias("misses"),
                                    F.when(h + m == 0, F.lit(0.0)).otherwise(half_up(h / (h + m), 4)).alias("hit_rate"))


def cache_capacity(store: DataFrame, cap: int, order_col: str, id_col: str) -> DataFrame:
    """Entries retained under a size cap, newest first (distributed top-k, bounded by the cap)."""
    return store.orderBy(F.col(order_col).desc(), F.col(id_col).desc()).limit(cap)


def cache_replay(stream: DataFrame, cfg: SearchConfig, id_col: str = "item_id", vec_col: str = "v",
                 time_col: str = "t", storable_col: str | None = None) -> DataFrame:
    """Time-ordered replay: an item is a hit if an earlier *stored*, live item is similar enough; else it is stored.

    The stored set is the lexicographically-first maximal independent set of the similarity graph
    (edges: earlier item within TTL and cos >= threshold), computed in parallel rounds: an item whose
    earlier neighbours are all decided becomes a hit if one of them is stored, else it is stored - unless
    ``storable_col`` is false (the answer failed its contracts). Every round decides at least the earliest undecided
    item, so the loop ends for any chain of dependencies. Earlier means (time, id), with or without a TTL. Each round's state is checkpointed to the shared checkpoint folder.
    """
    from gatelens.session import cut_lineage
    edges = threshold_search(stream, stream, id_col, vec_col, id_col, vec_col,
                             SearchConfig(cfg.threshold, cfg.pivots, cfg.block_size, k=1 << 30, ttl_s=cfg.ttl_s),
                             q_time=time_col, s_time=time_col, earlier_only=True)
    edges = cut_lineage(edges.select(F.col("query_id").alias("dst"), F.col("entry_id").alias("src")))
    storable = F.coalesce(F.col(storable_col), F.lit(False)) if storable_col else F.lit(True)
    state = cut_lineage(stream.select(F.col(id_col).alias("node"), storable.alias("storable"), F.lit("undecided").alias("state")))
    while True:
        und = state.filter(F.col("state") == "undecided")
        if und.isEmpty():
            return state.select(F.col("node").alias(id_col), (F.col("state") == "hit").alias("hit"))
        e = edges.join(state.select(F.col("node").alias("src"), F.col("state").alias("sst")), "src")
        agg = e.groupBy("dst").agg(F.count_if(F.col("sst") == "undecided").alias("n_und"),
                                   F.count_if(F.col("sst") == "stored").alias("n_stored"))
        j = state.join(agg.withColumnRenamed("dst", "node"), "node", "left")
        new = (F.when(F.col("state") != "undecided", F.col("state"))
               .when(F.coalesce("n_stored", F.lit(0)) > 0, F.lit("hit"))
               .when(F.coalesce("n_und", F.lit(0)) == 0, F.when(F.col("storable"), F.lit("stored")).otherwise("passed"))
               .otherwise(F.lit("undecided")))
        state = cut_lineage(j.select("node", "storable", new.alias("state")))
