import random

import brute
from paths import SF_SMALL

from gatelens.llm import decontaminate as dec
from gatelens.sources.tables import table


def found(df):
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in df.collect()}


def test_small_table_matches_all_windows(spark):
    docs, bench = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "benchmark")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 6000]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert found(dec.find_passages(docs.where("length(text) < 6000"), bench)) == brute.passages(rows, items)


def test_planted_passages_around_the_threshold(spark):
    rng = random.Random(2)
    items = [(n, " ".join(f"i{rng.randrange(900)}" for _ in range(size))) for n, size in enumerate((3, 5, 6, 20, 40, 40, 90))]
    items += [(50, "same same same same same same same")]
    docs = []
    for n, text in items:
        w = text.upper().split()
        for edits in range(0, 5):
            x = list(w)
            for _ in range(edits):
                x[rng.randrange(max(1, len(x) // 6))] = f"z{rng.randrange(99)}"
            before = [f"b{rng.randrange(500)}" for _ in range(rng.randrange(60))]
            docs.append((len(docs), " \n".join(before + x + x[:edits])))
    docs += [(900, None), (901, ""), (902, "same " * 5000)]
    d = spark.createDataFrame(docs + docs[:2], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items + [(60, None), (61, "  ")], "item_id long, text string")
    want = brute.passages(docs, items)
    assert want and found(dec.find_passages(d, b)) == want
    rows = dec.contamination(d, b).collect()
    assert len(rows) == d.count() and {r["doc_id"] for r in rows if r["contaminated"]} == {k for k, _ in want}
    assert dec.contamination(d.limit(0), b).count() == 0 and not dec.find_passages(d, b.limit(0)).count()
    clash = d.selectExpr("*", "1 AS item_id", "'x' AS found_id")
    assert dec.without_benchmark(clash, b).columns == clash.columns


def test_blocks_cover_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_ITEMS", 3)
    b = spark.createDataFrame([(i, f"alpha{i} b c d e f g") for i in range(8)], "item_id long, text string")
    d = spark.createDataFrame([(i, f"x alpha{i} b c d e f g y") for i in range(8)], "doc_id long, text string")
    assert [len(x) for x in dec.benchmark_blocks(b)] == [3, 3, 2]
    assert set(found(dec.find_passages(d, b))) >= {(i, i) for i in range(8)}


def test_block_tables_hold_every_item_within_the_radius():
    rng = random.Random(7)
    items = dec.Items.of([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(30))) for i in range(70)])
    index = dec.HammingIndex(items)
    for _ in range(50):
        i = rng.randrange(70)
        p = items.prints[i:i + 1].copy()
        for bit in rng.sample(range(dec.BITS), rng.randrange(dec.RADIUS + 1)):
            p[0, bit // 16] ^= 1 << (bit % 16)
        near = {j for j in range(70) if sum(bin(int(x)).count("1") for x in p[0] ^ items.prints[j]) <= dec.RADIUS}
        assert {j for _, j in index.within(p, list(range(70)))} == near and i in near


def runs_replaced():
    """Items that begin with a run of one word, and documents with a run of another word there: similarity 0.8 or a bit more."""
    rng = random.Random(5)
    items, docs = [], []
    for n in range(20):
        run, size = ((12, 112), (16, 148), (22, 202), (22, 210))[n % 4]
        rest = " ".join(f"w{rng.randrange(10**6)}" for _ in range(size - run))
        items.append((n, "_ " * run + rest))
        docs.append((n, f"a{n} b{n} " + "0 " * run + rest + " c d"))
    return items, docs


def test_long_repeated_runs_match_all_windows(spark):
    items, docs = runs_replaced()
    want = brute.passages(docs, items)
    assert len(want) == 20
    got = found(dec.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == want


def test_window_sums_are_those_of_the_windows():
    rng = dec.np.random.default_rng(3)
    s = rng.integers(1, 6, 60).astype(dec.np.uint64)
    for width in (1, 7, 60):
        want = [dec.window_sums(s[a:a + width], width)[0] for a in range(60 - width + 1)]
        assert (dec.window_sums(s, width) == want).all()
