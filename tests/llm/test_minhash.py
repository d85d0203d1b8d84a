import random

import brute
import numpy as np
import pytest
from paths import SF_SMALL

from gatelens.llm import minhash
from gatelens.sources.tables import table


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def expected(rows, k):
    return {i: (n, c, i == c) for i, (n, c) in brute.near_duplicates(rows, k).items()}


def test_whole_small_table_matches_all_pairs(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(minhash.near_duplicates(docs, shingle_words=4)) == expected(rows, 4)


def test_families_around_the_threshold_match_all_pairs(spark):
    rng, rows = random.Random(5), []
    for family in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(60 + 40 * family)]
        for copy in range(14):
            w = list(base)
            for _ in range(copy % 7):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((len(rows) * 3 % 251, " ".join(w)))
    rows += [(300, "one two"), (301, "One  TWO"), (302, ""), (303, None), (304, " \t\n"), (305, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(minhash.near_duplicates(docs, shingle_words=4)) == expected(rows, 4)


def test_large_group_around_the_threshold_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng, rows = random.Random(11), []
    base = [f"w{rng.randrange(5000)}" for _ in range(160)]
    for copy in range(150):
        w = list(base)
        for _ in range(copy % 9):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((copy * 7 % 601, " ".join(w)))
    rows += [(700, " ".join(base * 3000)), (701, " ".join(base * 3000) + " end"), (702, " ".join(base[:120] * 2000))]   # very long texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = expected(rows, 4)
    assert result(minhash.near_duplicates(docs, shingle_words=4)) == want
    assert len({c for _, c, _ in want.values()}) > 5      # members that link with nothing are there


def test_odd_rows_and_clashing_columns(spark):
    rows = [(7, "a b c d e f", 1, "x"), (7, "a b c d e f", 1, "x"), (3, "a b c d e f", 2, "y"), (None, "a b c d e f", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, bands string")
    got = sorted(minhash.near_duplicates(docs).select("doc_id", "component_id", "kept").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(3, 3, True), (7, 3, False), (7, 3, False), (None, None, True)], key=lambda r: f"Row(doc_id={r[0]}")
    kept = minhash.keep_one_each(docs)
    assert kept.columns == docs.columns and sorted(r["component_id"] for r in kept.collect()) == [2, 3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001)], "a long, b long").repartition(7)
    got = {r["node"]: r["comp"] for r in minhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2 ** 63, 600, dtype=np.uint64)
    a, b = x[:500], x[100:]
    sig = minhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.2
    alone = minhash.superminhash(b, np.zeros(len(b), int), 1)
    assert (alone[0] == sig[1]).all()


@pytest.mark.parametrize("edges_a_task", [1 << 18, 7])
def test_components_in_one_task_and_across_tasks(spark, monkeypatch, edges_a_task):
    """A long chain, a star, repeated and self edges, and no edge at all."""
    from gatelens.llm import minhash
    monkeypatch.setattr(minhash, "EDGES_A_TASK", edges_a_task)
    chain, star = [(i + 1, i) for i in range(100, 130)], [(500, 500 + i) for i in range(1, 12)]
    rows = chain + star + [(700, 701), (701, 700), (700, 701), (900, 900)]
    edges = spark.createDataFrame(rows[::2] + rows[1::2], "a long, b long").repartition(5)
    got = {r["node"]: r["comp"] for r in minhash.components(edges).collect()}
    want = {n: 100 for n in range(100, 131)} | {n: 500 for n in range(500, 512)} | {700: 700, 701: 700}
    assert {n: c for n, c in got.items() if n != 900} == want and got.get(900, 900) == 900
    assert minhash.components(edges.where("a < 0")).count() == 0
