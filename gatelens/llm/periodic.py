"""Periodic runs of words: maximal stretches that repeat with some period, by difference-cover LCE queries.

A run with smallest period q holds, on the grid 0, q, 2q, ... of its text, a point i for which the words at i and i + q
are equal and the common extensions of both to the right and left span q words or more. So every period p is tried on
its own grid (n/1 + n/2 + ... = n log n points), each by two longest-common-extension queries. These are answered by a
structure over the words of many texts at once: only suffixes at positions of a difference cover are sorted; a query
compares fewer than 13 words to reach two sampled positions at the same distance, and a sparse table of minima gives
the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import slices

# fixed values: every difference modulo 13 is a difference of two members of the cover
MODULUS, COVER = 13, (0, 1, 3, 9)
BLOCK_WORDS = 150_000       # words handled at a time (a longer text is a block of its own)
BLOCK_QUERIES = 2_000_000   # grid points handled at a time

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
#: distance from (i, j) to the next pair of sampled positions, by the remainders of i and j
_SHIFT = np.array([[next(d for d in range(MODULUS) if _IN_COVER[(i + d) % MODULUS] and _IN_COVER[(j + d) % MODULUS])
                    for j in range(MODULUS)] for i in range(MODULUS)])


def _names(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys, from 1."""
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.concatenate(([1], (keys[order][1:] != keys[order][:-1]).astype(np.int64))))
    return ranks


class CommonExtension:
    """Longest common extensions to the right of two positions in a sequence of word numbers (0 and above)."""

    def __init__(self, words: np.ndarray):
        n, top = len(words), int(words.max(initial=0)) + 1
        # words past the end are all different, so no extension passes it
        self.words = w = np.concatenate((words.astype(np.int64), top + np.arange(2 * MODULUS)))
        self.sampled = at = np.flatnonzero(_IN_COVER[np.arange(n + MODULUS) % MODULUS])
        self.index = np.full(n + MODULUS, -1, np.int64)
        self.index[at] = np.arange(len(at))
        width = int(w.max()) + 1
        name, k = np.zeros(len(at), np.int64), 0
        while k < MODULUS:                         # rank by the first 13 words, as many at a time as a key holds
            key = name
            space = int(name.max(initial=0)) + 1
            while k < MODULUS and space * width < 1 << 62:
                key, space, k = key * width + w[at + k], space * width, k + 1
            name = _names(key)
        levels = [name]                            # then by 26, 52, ... words until all differ
        step = len(COVER)                          # sampled positions in 13 words
        while int(name.max(initial=0)) < len(at) and step < len(at):
            after = np.zeros(len(at), np.int64)
            after[:-step] = name[step:]
            name = _names(name * (len(at) + 1) + after)
            levels.append(name)
            step *= 2
        self.rank = name - 1
        order = np.argsort(self.rank, kind="stable")
        self._minima = [self._neighbours(order[:-1], order[1:], levels)]
        while len(self._minima[-1]) > 1 << (len(self._minima) - 1):
            half, last = 1 << (len(self._minima) - 1), self._minima[-1]
            self._minima.append(np.minimum(last[:-half], last[half:]))

    def _neighbours(self, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of sampled suffixes that are neighbours in order: equal blocks from the longest down, then words."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            step = len(COVER) << level
            ok = np.flatnonzero((a < len(self.sampled)) & (b < len(self.sampled)))
            same = ok[levels[level][a[ok]] == levels[level][b[ok]]]
            a[same] += step
            b[same] += step
            total[same] += MODULUS << level
        live = np.flatnonzero((a < len(self.sampled)) & (b < len(self.sampled)))
        x, y = self.sampled[a[live]], self.sampled[b[live]]
        for k in range(MODULUS):
            same = self.words[x + k] == self.words[y + k]
            live, x, y = live[same], x[same], y[same]
            total[live] += 1
        return total

    def query(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on, for arrays of different positions."""
        out = np.zeros(len(i), np.int64)
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        live = np.arange(len(i))
        for k in range(MODULUS):
            arrived = shift[live] == k
            done = live[arrived]
            if len(done):
                out[done] = k + self._between(self.rank[self.index[i[done] + k]], self.rank[self.index[j[done] + k]])
            live = live[~arrived]
            if not len(live):
                break
            same = self.words[i[live] + k] == self.words[j[live] + k]
            out[live[~same]] = k
            live = live[same]
        return out

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for at in np.unique(level):
            pick = np.flatnonzero(level == at)
            row = self._minima[at]
            out[pick] = np.minimum(row[low[pick]], row[high[pick] - (1 << int(at))])
        return out


def runs(words: np.ndarray, first: np.ndarray, end: np.ndarray, min_length: int = 12) -> np.ndarray:
    """Rows (start, end, smallest period), in order, of the runs of texts words[first:end].

    A run has at least ``min_length`` words and two periods. ``words`` starts with, and each text is followed by, a word
    found nowhere else, so no run crosses texts.
    """
    sizes = end - first
    tried = np.where(sizes >= min_length, sizes // 2, 0)
    if not tried.sum():
        return np.zeros((0, 3), np.int64)
    right, left, last = CommonExtension(words), CommonExtension(words[::-1]), len(words) - 1
    text = np.repeat(np.arange(len(first)), tried)
    period = np.arange(len(text)) - np.repeat(np.cumsum(tried) - tried, tried) + 1
    points = (sizes[text] - 1) // period
    total = np.cumsum(points)
    found = []
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK_QUERIES, "right")))
        many = points[a:b]
        which = np.repeat(np.arange(a, b), many)
        p = period[which]
        i = first[text[which]] + (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)) * p
        same = words[i] == words[i + p]
        i, p = i[same], p[same]
        ahead, behind = right.query(i, i + p), left.query(last - i + 1, last - i - p + 1)
        good = (ahead + behind >= p) & (ahead + behind + p >= min_length)
        found.append(np.stack((i - behind, i + p + ahead, p), axis=1)[good])
        a = b
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):                                        # multiples of a run's smallest period give the same stretch
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, total = [], [], 0
    for b in slices(batches):
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = text.encode().split() if text else []     # bytes split at exactly [\x20\x09-\x0D]+
            if texts and total + len(words) > BLOCK_WORDS:
                yield ids, texts
                ids, texts, total = [], [], 0
            ids.append(i)
            texts.append(words)
            total += len(words)
    if texts:
        yield ids, texts


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            number: dict[bytes, int] = {}
            for words in texts:
                number.update(dict.fromkeys(words, 0))
            number = {w: k for k, w in enumerate(number)}
            sizes = np.array([len(t) for t in texts])
            first = np.cumsum(sizes + 1) - sizes
            end = first + sizes
            flat = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
            flat[0] = len(number)
            flat[end] = len(number) + 1 + np.arange(len(texts))
            for words, a, b in zip(texts, first.tolist(), end.tolist()):
                flat[a:b] = np.fromiter(map(number.__getitem__, words), np.int64, b - a)
            rows = runs(flat, first, end, min_length)
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
            np.add.at(edge, rows[:, 1], -1)
            dropped = np.cumsum(edge) > 0
            cut = np.searchsorted(rows[:, 0], np.append(first, len(flat)))
            kept = []
            for k, words in enumerate(texts):
                if cut[k] < cut[k + 1]:
                    words = [words[x] for x in np.flatnonzero(~dropped[first[k]:end[k]])]
                kept.append(b" ".join(words).decode())
            base = np.repeat(first, np.diff(cut))
            table = pa.StructArray.from_arrays([pa.array(rows[:, 0] - base), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])],
                                               fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), table),
                 pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12) -> DataFrame:
    """Runs of words of each row's text: (doc_id, n_words, runs array<struct<start, length, period>>, collapsed).

    ``runs`` are in order of start, then period; ``collapsed`` is the text's words, joined by one space, without those
    that some run holds after its first period. A null or empty text has no words, no runs and an empty ``collapsed``.
    Very long texts are handled whole: memory grows with the longest text, n log n time. Equal rows give equal rows;
    a null id stays null. Only the two named columns are read, so other columns cannot clash.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_find(min_length), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in which every tenth text, by the checksum of its id, repeats some of its words up to its end.

    With h = crc32 of the decimal id, g = floor(h / 10), n words and h % 10 = 0: from word a = g % n on, words repeat
    with period 1 + floor((n - a) / (3 + g % 8)). Texts without words, and rows without an id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("words", F.when(h % 10 == 0, words)).withColumn("g", F.floor(h / 10)).withColumn("n", F.size("words")) \
        .withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))) \
        .withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    repeated = F.expr("array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("floor(1000 * best.length / -best.period)").cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
