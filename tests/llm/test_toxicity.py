"""Gradients by differences, held-out accuracy, windows over whole texts, and rows of odd kinds."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.llm import toxicity as tox
from gatelens.llm.queries import op11_toxicity
from gatelens.sources.tables import table

from paths import SF_CHECK


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = tox.Network.fresh({}, rng)
    vectors, index = rng.normal(size=(20, tox.WORD_DIM + tox.CHAR_DIM)), rng.integers(0, 20, (5, tox.WINDOW))
    lengths, y = np.array([tox.WINDOW, 7, 1, 0, 20]), np.array([1, 0, 1, 1, 0.0])

    def loss():
        z = net.forward(net.gates(vectors), index, lengths).astype(float)
        return float((np.logaddexp(0, z) - y * z).sum())
    g, d = net.gradients(vectors, index, lengths, y, np.ones(5))
    for name in tox.Network.TABLES[2:]:
        weights = getattr(net, name)
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in weights.shape)
            kept = weights[at]
            weights[at] = kept + 0.01
            above = loss()
            weights[at] = kept - 0.01
            below = loss()
            weights[at] = kept
            assert (above - below) / 0.02 == pytest.approx(g[name][at], rel=0.02, abs=2e-4), name
    at = (int(index[1, 3]), 4)
    kept = vectors[at]
    vectors[at] = kept + 0.01
    above = loss()
    vectors[at] = kept - 0.01
    assert (above - loss()) / 0.02 == pytest.approx(d[at], rel=0.02, abs=2e-4)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 48, 49, 500])
def test_windows_cover_all_words_and_overlap(n):
    starts = list(tox.window_starts(n))
    assert {i for s in starts for i in range(s, min(n, s + tox.WINDOW))} == set(range(n))
    assert all(b - a == tox.STRIDE < tox.WINDOW for a, b in zip(starts, starts[1:]))


def tables(spark):
    """Clean texts of invented words; toxic ones hold one of three words somewhere. Labels of every fifth id are kept back."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        words = [f"w{k}" for k in rng.integers(0, 300, rng.integers(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(int(rng.integers(0, len(words))), ["vile!", "Rotten", "scummy,"][i % 3])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_held_out_texts_are_told_apart(spark):
    docs, labels = tables(spark)
    net = tox.fit_on_labels(docs, labels.where(~tox.held_out()))
    got = tox.toxicity(docs, net).join(labels, "doc_id").where(tox.held_out()).toPandas()
    assert (got.predicted == got.toxic).mean() >= 0.95
    # one such word at the end of a long text is found there; the same text without it is left alone
    words = [f"w{k % 300}" for k in np.random.default_rng(8).permutation(60_000)]
    long = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + ["Rotten", "w1"]))], "doc_id long, text string")
    clean, toxic = tox.toxicity(long, net).orderBy("doc_id").collect()
    assert toxic.score > clean.score and toxic.window_start + tox.WINDOW >= 60_000 and toxic.predicted == 1
    # equal input, equal network
    again = tox.fit_on_labels(docs.repartition(7), labels.where(~tox.held_out()).repartition(3))
    assert all(np.array_equal(getattr(net, k), getattr(again, k)) for k in tox.Network.TABLES) and net.shift == again.shift


def test_query_on_the_supplied_table(spark):
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    got = op11_toxicity(spark, SF_CHECK).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id", "left").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    # toxic texts in English hold words of abuse; in the other languages nothing tells them apart
    kept = got[got.held_out & got.toxic.notna() & (got.lang == "en")]
    toxic, clean = kept[kept.toxic == 1], kept[kept.toxic == 0]
    assert (toxic.predicted == 1).mean() >= 0.75 and (clean.predicted == 0).mean() >= 0.9
    above = (toxic.score.values[:, None] > clean.score.values).mean()
    assert above >= 0.9


def test_odd_rows(spark):
    docs, labels = tables(spark)
    odd = spark.createDataFrame([(7, None, "c"), (8, "", "c"), (9, " \n ", "c"), (None, "Rotten", "c"), (10, "é" * 5000, "c"), (10, "é" * 5000, "c")],
                                "doc_id long, text string, score string")
    net = tox.fit_on_labels(docs, labels)
    got = tox.toxicity(odd, net).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (7, 8, 9)}
    assert len(empty) == 1 and len({r.score for r in got if r.doc_id == 10}) == 1
    assert tox.toxicity(odd.where("doc_id > 99"), net).collect() == []
    # no labels, one kind of label, labels without texts: one constant score
    for some in (labels.where("toxic > 5"), labels.where("toxic = 0"), labels.withColumn("doc_id", F.col("doc_id") + 10_000)):
        assert len({r.score for r in tox.toxicity(docs, tox.fit_on_labels(docs, some)).collect()}) == 1
