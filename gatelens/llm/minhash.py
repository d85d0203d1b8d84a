"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find grouping.

Shape of the job: equal shingle sets collapse first (one class per set, so copies never form pairs); class
representatives are banded; each bucket's members are compared with a few hubs of the bucket, not with each other;
buckets whose members end in one component are finished. In the others, what is outside a bucket's largest component meets
the whole bucket inside blocks of bounded size. Pairs never leave a block: it skips what sizes, one-byte registers or a
component found so far decide, takes each pair in its first common bucket, confirms it on full sets with a local
union-find, and gives out only the links that join components.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import jaccard_at_least, mix, shingle_sets, slices
from gatelens.session import cut_lineage

BANDS, ROWS = 32, 4      # a pair at similarity 0.8 shares no bucket with probability (1 - 0.8**4)**32 = 5e-8
REGISTERS = BANDS * ROWS
SKETCH_MARGIN = 0.2      # 5.6 standard deviations of the estimate from REGISTERS one-byte registers at 0.8
HUBS = 3                 # hubs of a bucket, with which all its members are compared first
BLOCK = 256              # members of one side in a block comparison, fewer where they are long:
BLOCK_SHINGLES = 1 << 19
EDGES_A_TASK = 1 << 18   # edges that one task's union-find takes
_GOLDEN, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def superminhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int = REGISTERS) -> np.ndarray:
    """SuperMinHash signatures (n_sets x m) of many sets at once.

    Every element draws a random permutation of the registers step by step (Fisher-Yates); step j offers the value
    j + random to the register of rank j. A set stops as soon as no register can fall any further, so large sets
    stop after one or two steps. ``owner`` is the set index of each element. Values are level << 48 | 48 random bits.
    """
    sig = np.full(n_sets * m, np.iinfo(np.uint64).max, np.uint64)
    state, base, perm = elements.astype(np.uint64), owner.astype(np.int64), None
    for level in range(m):
        state = mix(state + _GOLDEN)
        pick = level + ((mix(state ^ _SALT) >> np.uint64(32)) * np.uint64(m - level) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            register, first_pick = pick, pick
        else:
            at = np.arange(len(state))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(state), 1))
                perm[at, first_pick], perm[:, 0] = 0, first_pick
            register = perm[at, pick].astype(np.int64)
            perm[at, pick] = perm[:, level]
        np.minimum.at(sig, base * m + register, np.uint64(level << 48) | (state >> np.uint64(16)))
        open_sets = (sig.reshape(n_sets, m).max(axis=1) >> np.uint64(48)) > level
        stay = open_sets[base]
        if not stay.any():
            break
        if not stay.all():
            state, base = state[stay], base[stay]
            first_pick = first_pick[stay] if perm is None else first_pick
            perm = None if perm is None else perm[stay]
    return sig.reshape(n_sets, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * _GOLDEN + rows[:, :, r])
    return key.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, sets = b.column(0), shingle_sets(b.column(1), k)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            bands, sketch = [None] * len(sets), [None] * len(sets)
            if len(full):
                owner = np.repeat(np.arange(len(full)), sizes[full])
                sig = superminhash(np.concatenate([sets[i] for i in full]), owner, len(full))
                keys, low = band_keys(sig), (mix(sig) & np.uint64(255)).astype(np.uint8)
                for row, i in enumerate(full):
                    bands[i], sketch[i] = keys[row], low[row].tobytes()
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(sizes), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])
    return run


def _local_union_find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contract the edges of one partition to a forest: each node with the smallest node it reaches here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): every node of ``edges(a, b)`` with the smallest node it is connected to.

    Union-find inside partitions leaves a forest: in one partition that is the answer. Otherwise every root is hooked to
    its smallest neighbour and pointers jump across partitions; each round at least halves the roots of an unfinished
    component. Edges are counted first, so a partition holds about EDGES_A_TASK of them, not what a shuffle left in it.
    """
    edges = cut_lineage(edges.select("a", "b"))
    tasks = -(-edges.count() // EDGES_A_TASK) or 1
    rest = cut_lineage(edges.coalesce(tasks).mapInPandas(_local_union_find, "a long, b long"))
    if tasks == 1:
        roots = rest.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
        return rest.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
    comp = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct() \
        .select("node", F.col("node").alias("comp"))
    while not rest.isEmpty():
        hook = rest.union(rest.select("b", "a")).groupBy(F.col("a").alias("x")).agg(F.min("b").alias("p")) \
            .select("x", F.least("x", "p").alias("p"))
        hook, moved = cut_lineage(hook), True
        while moved:
            one, two = (hook.select(F.col("x").alias(f"p{i}"), F.col("p").alias(f"p{i + 1}")) for i in (1, 2))
            jumped = hook.withColumnRenamed("p", "p1").join(one, "p1").join(two, "p2") \
                .select("x", F.col("p3").alias("p"), (F.col("p3") != F.col("p2")).alias("moved"))
            jumped = cut_lineage(jumped)
            hook, moved = jumped.select("x", "p"), not jumped.where("moved").isEmpty()
        comp = comp.join(hook, comp["comp"] == hook["x"], "left").select("node", F.coalesce("p", "comp").alias("comp"))
        ha, hb = (hook.select(F.col("x").alias(c), F.col("p").alias("p" + c)) for c in "ab")
        rest = rest.join(ha, "a").join(hb, "b").where("pa <> pb") \
            .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        rest = cut_lineage(rest.mapInPandas(_local_union_find, "a long, b long"))
    return cut_lineage(comp)


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()     # a hub's set serves its run of pairs
        for b in slices(batches, 64):
            a = b.column(0).to_pylist()
            new = [i for i, x in enumerate(a) if x not in recent and x not in a[:i]]
            recent.update(zip((a[i] for i in new), shingle_sets(b.column(2).take(pa.array(new, pa.int64())), k)))
            linked = [jaccard_at_least(recent[x], s, percent) for x, s in zip(a, shingle_sets(b.column(3), k))]
            while len(recent) > 64:
                recent.popitem(last=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
    return run


def _similar(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``others`` have similarity >= percent / 100 with ``one`` (sorted distinct hashes, no set empty)."""
    sizes = np.array([len(s) for s in others])
    hashes = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, hashes), len(one) - 1)] == hashes
    both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(one) + sizes - both)


class _Block:
    """Rows of one block, those that ask and those asked: which pairs may still link."""

    def __init__(self, frame: pd.DataFrame, percent: int):
        self.percent, self.cut = percent, percent / 100 - SKETCH_MARGIN
        self.rep, self.n, self.comp, self.asks, self.stray = (frame[c].to_numpy().copy() for c in ("rep", "n", "comp", "asks", "stray"))
        self.registers = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, REGISTERS)
        self.band, self.bands = frame["band"].iat[0], np.stack(frame["bands"].to_numpy())

    def askers(self) -> np.ndarray:
        return np.flatnonzero(self.asks)

    def may_link(self, i: int) -> np.ndarray:
        """Rows of other components that sizes and registers leave possible for row i, each pair asked from one side and
        in its first common bucket only (a first bucket that was finished before has had the pair compared)."""
        n = self.n[i]
        may = ~self.asks & (self.comp != self.comp[i]) & (~self.stray | (self.rep > self.rep[i]))
        at = np.flatnonzero(may & (100 * np.minimum(self.n, n) >= self.percent * np.maximum(self.n, n)))
        at = at[(self.registers[at] == self.registers[i]).mean(axis=1) >= self.cut]
        first = (self.bands[at] == self.bands[i]).argmax(axis=1)
        return at[self.bands[i][first] == self.band]


def _wanted(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """The rows of one block that some pair needs, so that only their texts are fetched."""
        block, wanted = _Block(frame, percent), np.zeros(len(frame), bool)
        for i in block.askers():
            at = block.may_link(i)
            wanted[at] = True
            wanted[i] |= len(at) > 0
        return frame[wanted]
    return run


def _links(k: int, percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of one block, confirmed on full sets. Pairs of components joined on the way are skipped, and only links
        that join two components come out: fewer rows than the block has."""
        block, sets = _Block(frame, percent), shingle_sets(pa.array(frame["text"], pa.string()), k)
        full, found = np.array([len(s) > 0 for s in sets]), []
        for i in block.askers():
            at = block.may_link(i)
            at = at[full[at]]
            if not len(at) or not full[i]:
                continue
            for j in at[_similar(sets[i], [sets[x] for x in at], percent)]:
                if block.comp[j] != block.comp[i]:
                    found.append((block.rep[i], block.rep[j]))
                    block.comp[block.comp == block.comp[j]] = block.comp[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets have Jaccard similarity >= percent / 100, directly or through others.

    Returns (doc_id, n_shingles, component_id, kept), one row per input row; only the two named columns are read, so
    extra columns cannot clash. A null or empty text, or one without words, has an empty set and links with nothing;
    a text of fewer than ``shingle_words`` words is one shingle. Very long texts are read whole; blocks hold fewer of
    them. A row without id is returned with component null and kept true, and links with nothing. Repeated rows are one class (the id is kept on each of them); rows that repeat
    an id with another text count as the same document where they represent their class. Ties go to the smallest id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut_lineage(docs.mapInArrow(_sign(shingle_words), _SIGNED))
    classes = cut_lineage(signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
                          .groupBy("set_key", F.col("n_shingles").alias("n"), "bands", "sketch")
                          .agg(F.min("doc_id").alias("rep")))
    rows = classes.select(F.explode("bands").alias("band"), "rep", "n")
    # a bucket's hubs: the members that come first by HUBS different hashes, alike in all buckets they share
    hubs = [F.min(F.struct(F.xxhash64("rep", F.lit(h)).alias("order"), "rep", "n")).alias(f"hub{h}") for h in range(HUBS)]
    shared = rows.groupBy("band").agg(F.count("*").alias("members"), *hubs).where("members > 1")
    members = cut_lineage(rows.join(shared, "band"))
    near = members.select("rep").distinct()
    # the texts that verification needs, fetched once; rows that repeat an id count with one of their texts
    texts = cut_lineage(docs.join(near, docs["doc_id"] == near["rep"]).groupBy("rep").agg(F.min("text").alias("text")))

    def verified(pairs: DataFrame) -> DataFrame:
        ta, tb = (texts.select(F.col("rep").alias(c), F.col("text").alias("text_" + c)) for c in "ab")
        with_texts = pairs.join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b")
        return cut_lineage(with_texts.mapInArrow(_verify(shingle_words, percent), "a long, b long, linked boolean"))

    # first every member against its buckets' hubs
    sides = [members.select("rep", "n", F.col(f"hub{h}.rep").alias("hub"), F.col(f"hub{h}.n").alias("hub_n")) for h in range(HUBS)]
    pairs = reduce(DataFrame.unionByName, sides).where("rep <> hub") \
        .where(f"100 * least(n, hub_n) >= {int(percent)} * greatest(n, hub_n)") \
        .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    tested = verified(pairs)
    comp = components(tested.where("linked"))

    # then, in the buckets that still hold several components, the members of different ones, inside blocks of bounded
    # size; a bucket of at most one member more than it has hubs has had all its pairs compared
    n_hubs = F.size(F.array_distinct(F.array(*(F.col(f"hub{h}.rep") for h in range(HUBS)))))
    rest = members.where(F.col("members") > n_hubs + 1).select("band", "rep", "n", "members")

    def mixed() -> DataFrame:
        """Members of the buckets with several components: whether one is outside the bucket's largest, how many are."""
        now = rest.join(comp, rest["rep"] == comp["node"], "left").select(*rest.columns, F.coalesce("comp", "rep").alias("comp"))
        largest = now.groupBy("band", "comp").agg(F.count("*").alias("of"), F.sum("n").alias("load")).groupBy("band") \
            .agg(F.max(F.struct("of", "comp")).alias("top"), F.sum("load").alias("load")) \
            .select("band", F.col("top.comp").alias("main"), F.col("top.of").alias("in_main"), "load")
        return cut_lineage(now.join(largest, "band").where("members > in_main")
                           .select("band", "rep", "n", "members", "comp", "load", (F.col("members") - F.col("in_main")).alias("strays"),
                                   (F.col("comp") != F.col("main")).alias("stray")))

    def chunks(count: str, load: str) -> Column:
        return F.ceil(F.greatest(F.col(count) / F.lit(BLOCK), F.col(load) / F.lit(BLOCK_SHINGLES))).cast("int")

    def chunk(number: Column, salt: str) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(salt)), number).cast("int")

    now = mixed()
    if not now.isEmpty():
        # what is left outside the largest component of its bucket meets all the bucket, chunk by chunk
        grid = now.withColumn("stray_chunks", chunks("strays", "load")).withColumn("all_chunks", chunks("members", "load"))
        to_all, to_strays = F.sequence(F.lit(0), F.col("all_chunks") - 1), F.sequence(F.lit(0), F.col("stray_chunks") - 1)
        row = ["band", "rep", "n", "comp", "stray"]
        ask = grid.where("stray").select(*row, F.lit(True).alias("asks"), chunk(F.col("stray_chunks"), "stray").alias("i"), F.explode(to_all).alias("j"))
        asked = grid.select(*row, F.lit(False).alias("asks"), F.explode(to_strays).alias("i"), chunk(F.col("all_chunks"), "all").alias("j"))
        blocks, keys = ask.unionByName(asked).join(classes.select("rep", "sketch", "bands"), "rep"), ["band", "i", "j"]
        wanted = cut_lineage(blocks.groupBy(*keys).applyInPandas(_wanted(percent), blocks.schema))
        links = wanted.join(texts, "rep").groupBy(*keys).applyInPandas(_links(shingle_words, percent), "a long, b long")
        comp = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(links))

    by_class = classes.select("set_key", "rep")
    by_class = by_class.join(comp, by_class["rep"] == comp["node"], "left").select("set_key", F.coalesce("comp", "rep").alias("rep"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                  percent: int = 80) -> DataFrame:
    """``docs`` with one document (the smallest id) of each near-duplicate group; all columns stay as they are."""
    dropped = near_duplicates(docs, id_col, text_col, shingle_words, percent).where("NOT kept") \
        .select(F.col("doc_id").alias("__dropped_id")).distinct()
    return docs.join(dropped, docs[id_col].cast("long") == dropped["__dropped_id"], "left_anti")
