"""Periodic runs against all periods tried one by one, and rows of odd kinds."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gatelens.llm import periodic
from gatelens.llm.queries import op13_periodic_runs
from gatelens.sources.tables import table

from paths import SF_SMALL


def brute(words, min_length=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_length, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def numbered(texts):
    flat, first, end = [1 << 20], [], []
    for k, words in enumerate(texts):
        first.append(len(flat))
        flat += words
        end.append(len(flat))
        flat.append((1 << 20) + 1 + k)
    return np.array(flat), np.array(first), np.array(end)


def found_in(texts):
    flat, first, end = numbered(texts)
    rows = periodic.runs(flat, first, end)
    return [[(a - f, b - a, p) for a, b, p in rows.tolist() if f <= a < e] for f, e in zip(first.tolist(), end.tolist())]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 40))
def test_runs_equal_brute_force(texts, period, start):
    texts = [[t[i] if i < start else t[start + (i - start) % period] for i in range(len(t))] if k % 2 and len(t) > start + period else t
             for k, t in enumerate(texts)]
    assert found_in(texts) == [brute(t) for t in texts]


def test_common_extension_equals_word_by_word():
    rng = random.Random(4)
    words = np.array([rng.randrange(2) for _ in range(300)] + [0, 1, 1] * 60)
    lce = periodic.CommonExtension(words)
    i = np.array([rng.randrange(len(words)) for _ in range(3000)])
    j = np.array([rng.randrange(len(words)) for _ in range(3000)])
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        k = 0
        while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        return k
    assert lce.query(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_long_text_with_one_period_all_over():
    words = [k % 7 for k in range(60_000)] + list(range(10, 30_010))
    assert found_in([words]) == [[(0, 60_000, 7)]]


def restated(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_on_the_small_table(spark):
    rows = [r for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect() if len((r.text or "").split()) < 800]
    got = {r["doc_id"]: tuple(r) for r in op13_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == table(spark, SF_SMALL, "documents").count()
    assert [got[r.doc_id] for r in rows] == [restated(r.doc_id, r.text) for r in rows]


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "a " * 12, "x b b　b b b b b b b b b b b b", "é " * 30, "a b c", "a " * 12]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "a " * 20, "n"), (3, "a " * 12, "again")],
                                 "doc_id long, text string, runs string")
    got = sorted((tuple(r) for r in periodic.digests(periodic.periodic_runs(periodic.planted(docs))).collect()), key=str)
    want = [restated(k, t) for k, t in enumerate(texts)] + [restated(3, "a " * 12), (None, 1, 0, 20, 1, 20_000, restated(0, "a " * 20)[6], None)]
    want = [w[:-1] + (restated(4, "a")[7],) if w[0] is None else w for w in want]
    assert [g[:7] for g in got] == [w[:7] for w in sorted(want, key=str)]
    none = docs.where("doc_id < -1")
    assert periodic.digests(periodic.periodic_runs(periodic.planted(none))).collect() == []
