"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact check.

The benchmark is a stated set of queries: it is read in blocks of bounded size and each block is held against all
documents in one pass. A window can only resemble an item if it holds one of the item's shingles, so windows around
such places are fingerprinted; the block tables return every item whose fingerprint lies within RADIUS bits, and the
weighted Jaccard similarity of the shingle bags decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import hashed_words, mix, shingles, slices

SHINGLE = 5
PERCENT = 80
BITS, BLOCKS = 256, 16                 # 16 blocks of 16 bits
RADIUS = 79                            # bags at similarity 0.8 have a cosine of 8/9 or more: 39 bits, standard deviation 6
NEAR = RADIUS // BLOCKS                # within RADIUS bits, some block differs in at most this many
BLOCK_ITEMS, BLOCK_WORDS = 256, 65_536  # bounds of one block of the benchmark, hence of what is broadcast
GROUP = 64                             # items of one bit mask

_SALTS = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([sum(1 << b for b in c) for n in range(NEAR + 1) for c in combinations(range(16), n)], np.uint16)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 / -1 for each of the BITS bits of each shingle."""
    bits = np.unpackbits(mix(hashes[:, None] ^ _SALTS).view(np.uint8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Fingerprints (n x BLOCKS of 16 bits) of summed signs."""
    return np.packbits(sums >= 0, axis=-1).view(np.uint16)


def numbered(hashes: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how many of it so far): as sets of these, bags differ by their weighted Jaccard similarity alone."""
    return np.where(nth == 1, hashes, mix(hashes ^ (nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))


def window_sums(s: np.ndarray, width: int) -> np.ndarray:
    """Summed signs of the numbered shingles of every window of ``width`` shingles. A window that moves on by one loses
    the highest number of its first shingle and gains the next number of the new one."""
    _, value = np.unique(s, return_inverse=True)
    at = np.arange(len(s))
    key = value * (len(s) + width + 1)
    order = np.sort(key + at)

    def copies(of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.searchsorted(order, key[of] + high) - np.searchsorted(order, key[of] + low)
    steps = signs(numbered(s, copies(at, np.maximum(at - width + 1, 0), at + 1)))
    moves = len(s) - width
    out = np.empty((moves + 1, BITS), np.int32)
    out[0] = steps[:width].sum(axis=0)
    lost = at[:moves]
    out[1:] = steps[width:] - signs(numbered(s[:moves], copies(lost, lost, lost + width)))
    return np.cumsum(out, axis=0, out=out)


@dataclass
class Items:
    """A block of benchmark items, as broadcast: ids, word counts, shingle bags and fingerprints."""

    ids: list[int]
    n_words: list[int]
    bags: list[dict[int, int]]
    prints: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        hashes, first, end = hashed_words(pa.array([t for _, t in rows], pa.string()))
        out = Items([], [], [], np.zeros((len(rows), BLOCKS), np.uint16))
        for (item, _), a, b in zip(rows, first, end):
            s = shingles(hashes[a:b], SHINGLE)
            if len(s):
                out.prints[len(out.ids)] = fingerprint(window_sums(s, len(s))[0])
                values, counts = np.unique(s, return_counts=True)
                out.ids.append(item), out.n_words.append(int(b - a))
                out.bags.append(dict(zip(values.tolist(), counts.tolist())))
        return out


class HammingIndex:
    """Block tables over a block of items: entry [g, j, v] is the bit mask of the items of group g whose j-th 16 bits
    differ from v in at most NEAR bits. Every item within RADIUS bits of a query is in one of the query's entries."""

    def __init__(self, items: Items):
        self.items = items
        groups = -(-len(items.ids) // GROUP)
        self.tables = np.zeros((groups, BLOCKS, 1 << 16), np.uint64)
        for i in range(len(items.ids)):
            for j in range(BLOCKS):
                self.tables[i // GROUP, j, items.prints[i, j] ^ _MASKS] |= np.uint64(1 << (i % GROUP))
        place: dict[int, list[int]] = {}
        for i, bag in enumerate(items.bags):
            for h in bag:
                place.setdefault(h, []).append(i)
        self.seeds = np.array(sorted(place), np.uint64)
        self.owners = [place[h] for h in self.seeds.tolist()]
        self.coarse = np.zeros(1 << 16, bool)           # first look: 16 bits of the shingle hash
        self.coarse[(self.seeds >> np.uint64(48)).astype(np.int64)] = True

    def within(self, prints: np.ndarray, wanted: list[int]) -> Iterator[tuple[int, int]]:
        """(row, item) for all wanted items within RADIUS bits of a row's fingerprint."""
        for g in {i // GROUP for i in wanted}:
            mask = np.uint64(sum(1 << (i % GROUP) for i in wanted if i // GROUP == g))
            hit = reduce(np.bitwise_or, (self.tables[g, j, prints[:, j]] for j in range(BLOCKS))) & mask
            for row in np.flatnonzero(hit).tolist():
                bits = int(hit[row])
                while bits:
                    low = bits & -bits
                    i = g * GROUP + low.bit_length() - 1
                    if int(np.bitwise_count(prints[row] ^ self.items.prints[i]).sum()) <= RADIUS:
                        yield row, i
                    bits ^= low

    def seed_hits(self, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and seed numbers of the shingles that some item holds."""
        maybe = np.flatnonzero(self.coarse[(every >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.seeds, every[maybe]), len(self.seeds) - 1)
        same = self.seeds[at] == every[maybe]
        return maybe[same], at[same]

    def search(self, s: np.ndarray, n: int, at: np.ndarray, seed: np.ndarray) -> dict[int, tuple[float, int]]:
        """Best window of a text for every item that resembles one: {item: (similarity, first word)}.

        ``s``: the text's shingles by position, ``n``: its words, ``at`` and ``seed``: its places that items share.
        """
        by_length: dict[int, tuple[set[int], set[int]]] = {}
        for p, number in zip(at.tolist(), seed.tolist()):
            for i in self.owners[number]:
                length = self.items.n_words[i]
                own, places = by_length.setdefault(length, (set(), set()))
                own.add(i), places.add(p)
        best: dict[int, tuple[float, int]] = {}
        for length, (own, places) in by_length.items():
            width = max(1, min(length, n) - SHINGLE + 1)            # shingles of a window
            p = np.array(sorted(places))
            last = len(s) - width                                   # last start
            edge = np.zeros(last + 2, np.int64)
            np.add.at(edge, np.clip(p - width + 1, 0, last), 1)
            np.add.at(edge, np.minimum(p, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for a in range(0, len(run), 4096):                  # bounds memory in texts full of seeds
                    part = run[a:a + 4096]
                    prints = fingerprint(window_sums(s[part[0]:part[-1] + width], width))
                    for row, i in self.within(prints, sorted(own)):
                        start = int(part[0]) + row
                        value = self.similarity(s[start:start + width], i)
                        if value is not None and (i not in best or (-value, start) < (-best[i][0], best[i][1])):
                            best[i] = (value, start)
        return best

    def similarity(self, window: np.ndarray, item: int) -> float | None:
        """Weighted Jaccard similarity of the bags, if it reaches PERCENT."""
        bag, low = self.items.bags[item], 0
        values, counts = np.unique(window, return_counts=True)
        for v, c in zip(values.tolist(), counts.tolist()):
            low += min(c, bag.get(v, 0))
        high = len(window) + sum(bag.values()) - low
        return low / high if 100 * low >= PERCENT * high else None


_indexes: dict[str, HammingIndex] = {}     # of a Python worker, by the block's name


def _search(block, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = HammingIndex(block.value)
        index = _indexes[name]
        items = index.items
        short = sorted({n for n in items.n_words if n < SHINGLE})
        for b in slices(batches):
            rows = []
            hashes, first, end = hashed_words(b.column(1))
            for k in [SHINGLE, *short]:
                every = shingles(hashes, k) if len(hashes) >= k else hashes[:0]
                at, seed = index.seed_hits(every)
                doc = np.searchsorted(first, at, "right") - 1
                inside = at + k <= end[doc]
                at, seed, doc = at[inside], seed[inside], doc[inside]
                cuts = np.flatnonzero(np.diff(doc)) + 1
                for p, q in zip(np.split(at, cuts), np.split(seed, cuts)):
                    if not len(p):
                        continue
                    d = int(np.searchsorted(first, p[0], "right") - 1)
                    a, e = int(first[d]), int(end[d])
                    if k == SHINGLE:
                        found = index.search(every[a:e - k + 1], e - a, p - a, q)
                    else:
                        found = {i: (1.0, int(x) - a) for x, y in zip(p[::-1], q[::-1]) for i in index.owners[y] if items.n_words[i] == k}
                    rows += [(d, items.ids[i], value, start) for i, (value, start) in found.items()]
            doc, item, value, start = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()),
                                              pa.array(value, pa.float64()), pa.array(start, pa.int64())],
                                             names=["doc_id", "item_id", "similarity", "first_word"])
    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in id order, in blocks of at most BLOCK_ITEMS items and BLOCK_WORDS words (one item may be
    larger). Rows without id or words are left out."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")) \
        .where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t")
    block, words = [], 0
    for r in rows.toLocalIterator():
        n = len(r["t"].split())
        if block and (len(block) >= BLOCK_ITEMS or words + n > BLOCK_WORDS):
            yield block
            block, words = [], 0
        block.append((r["i"], r["t"]))
        words += n
    if block:
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word): the best window of a document for every item it resembles.

    A window has as many words as the item (the whole text if that is shorter); words are lower-cased (A-Z). The
    similarity is that of the bags of 5-word shingles and reaches 0.8; an item of fewer words is one shingle and must
    occur as it is. Null and empty texts hold nothing, as do rows without id; equal rows give equal matches; ties go to
    the first window. Items with several texts match if one of them does. Only the named columns are read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id long, item_id long, similarity double, first_word long"
    out = spark.createDataFrame([], schema)
    for rows in benchmark_blocks(benchmark):
        items = Items.of(rows)
        if items.ids:
            block = spark.sparkContext.broadcast(items)
            out = out.unionByName(texts.mapInArrow(_search(block, uuid.uuid4().hex), schema))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, contaminated, item_ids, best_similarity); see ``find_passages``."""
    found = find_passages(docs, benchmark, id_col, text_col).groupBy(F.col("doc_id").alias("found_id")) \
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("best_similarity"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(found, ids["doc_id"] == found["found_id"], "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "best_similarity")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; columns unchanged."""
    hit = find_passages(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__hit_id")).distinct()
    return docs.join(hit, docs[id_col].cast("long") == hit["__hit_id"], "left_anti")
