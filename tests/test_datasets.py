from pyspark.sql import functions as F

from gatelens.operators import datasets as ds


def test_balance_is_seeded_and_equal(spark):
    df = spark.range(0, 100).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    a = ds.balance_classes(df, "label", "doc_id", 30, 7)
    b = ds.balance_classes(df, "label", "doc_id", 30, 7)
    counts = {r["label"]: r["count"] for r in a.groupBy("label").count().collect()}
    assert counts == {0: 25, 1: 25}
    assert sorted(r[0] for r in a.select("doc_id").collect()) == sorted(r[0] for r in b.select("doc_id").collect())


def test_stratified_split_keeps_class_ratio_exactly(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    s = ds.stratified_split(df, "label", "doc_id", 0.1, 0.2, 42)
    c = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert c == {(0, "test"): 160, (0, "val"): 80, (0, "train"): 560, (1, "test"): 40, (1, "val"): 20, (1, "train"): 140}


def test_dedup_keeps_smallest_id(spark):
    df = spark.createDataFrame([(3, " Hello "), (1, "hello"), (2, "other")], "doc_id long, text string")
    got = {r["doc_id"]: r["copies"] for r in ds.dedup_samples(df, "text", "doc_id").collect()}
    assert got == {1: 2, 2: 1}


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["Hello", " hello ", "HELLO", "bye", "Bye ", "x"]), st.integers(0, 1)),
                min_size=1, max_size=30))
def test_dedup_matches_model(spark, rows):
    data = [(i, t, y) for i, (t, y) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, label int")
    got = {r["doc_id"]: (r["label"], r["copies"]) for r in ds.dedup_samples(df, "text", "doc_id").collect()}
    groups = {}
    for i, t, y in data:
        groups.setdefault(t.strip(" ").lower(), []).append((i, y))
    want = {min(g)[0]: (min(g)[1], len(g)) for g in groups.values()}
    assert got == want


def test_train_tier2_learns_from_labels(spark):
    from gatelens.operators import datasets as ds
    rows = [(i, ("you are a stupid fool " if i % 2 else "what a lovely calm day ") + f"w{i % 7}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model, report = ds.train_tier2(df.where("doc_id < 40"), df.where("doc_id >= 40"), num_features=1 << 10, max_iter=20)
    r = report.first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (10, 0, 10, 0) and r["f1"] == 1.0
    assert model.transform(df.limit(1).withColumn("label", df["label"].cast("double"))).count() == 1
