import brute
import numpy as np
import pytest
from paths import SF_SMALL

from gatelens.llm import quality
from gatelens.sources.tables import table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_match_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    odd = [(10_001, None), (10_002, ""), (10_003, " \n\t"), (None, "a b c d e f"), (10_004, "x y z v w x y z v w\nx y z v w\n\nx y z v w"),
           (10_005, "A a\u00a0b # <é>\n" * 12), (10_006, "one " * 30)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    rows = quality.quality(both, quality.LineField()).collect()
    assert len(rows) == both.count()
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == brute.quality_counts(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def test_fitted_field_separates_held_out_labels(spark):
    sf = SF_SMALL.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit_on_labels(docs, labels.where("doc_id % 2 = 0"), sample_docs=500)
    held = quality.quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").toPandas()
    good, bad = held[held["quality"] == 1], held[held["quality"] == 0]
    assert good["kept"].mean() > 0.99 and (len(bad) == 0 or bad["kept"].mean() < 0.1)


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(4)
    model = quality.LineField(rng.normal(size=(quality.FEATURES, 2)), rng.normal(size=(2, 2)))
    for n in (1, 2, 7):
        x = rng.integers(0, 2, (n, quality.FEATURES)).astype(float)
        e = x @ model.emit
        best = max(range(2 ** n), key=lambda c: sum(e[i, c >> i & 1] for i in range(n))
                   + sum(model.move[c >> i & 1, c >> (i + 1) & 1] for i in range(n - 1)))
        assert model.decode(x).tolist() == [bool(best >> i & 1) for i in range(n)]


def test_fit_climbs_the_likelihood():
    a, b = np.zeros((5, quality.FEATURES)), np.zeros((3, quality.FEATURES))
    a[:, 0] = b[:, 0] = 1
    b[:, 6] = 1
    model = quality.fit([a, b, a], [1, 0, 1])
    assert model.decode(a).all() and not model.decode(b).any()


def test_no_labels_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 4 + "and six more words in here", True)], "doc_id long, text string, kept boolean")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_on_labels(docs, none)
    assert quality.keep_good(docs, model).collect() == docs.collect()
    assert quality.quality(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("text", ["a | b | c", "!!", "x" * 200_000, "\n" * 1000])
def test_long_and_odd_lines_have_features(text):
    assert quality.line_features(text.encode().split(b"\n")).shape[1] == quality.FEATURES
