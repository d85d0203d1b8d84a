"""Dataset preparation: class balancing, seeded order, stratified splits, dedup, tier-2 training.

Randomness is a seeded hash of (seed, id) so every engine and every rerun
agrees. Balancing keeps the n smallest hashes per class (a per-group top-k
that Spark limits per partition before the exchange). Stratified splits need
exact within-class ranks; they come from one range-partitioned sort plus
per-partition offsets (a small partitions x classes table), never a window
over a whole class.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.session import cut_lineage


def seeded_key(id_col: str, seed: int) -> Column:
    """md5 of 'seed:id' (hex) — reproducible order shared with SQL engines."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def balance_classes(df: DataFrame, label: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Equal count per class: min(n, smallest class size), chosen by the seeded key."""
    counts = [r["c"] for r in df.groupBy(label).agg(F.count("*").alias("c")).collect()]   # one row per class
    n_eff = min([n] + counts) if counts else 0
    # a limit per class: each partition passes on at most n_eff rows of a class before the exchange
    place = F.row_number().over(Window.partitionBy(label).orderBy(seeded_key(id_col, seed), id_col))
    return df.withColumn("_rank", place).filter(F.col("_rank") <= n_eff).drop("_rank")


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Reproducible pseudo-random order (a distributed range sort on the seeded key)."""
    return df.withColumn("shuffle_key", seeded_key(id_col, seed)).orderBy("shuffle_key", id_col)


def ranks_within(df: DataFrame, group: str, order: list[str], num_partitions: int | None = None) -> DataFrame:
    """0-based rank of each row inside its group by ``order`` plus the group size, without a per-group window."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = cut_lineage(df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
                    .withColumn("_pid", F.spark_partition_id()))
    counts = s.groupBy("_pid", group).agg(F.count("*").alias("c")).collect()      # partitions x groups rows
    offs, tot = {}, {}
    for r in sorted(counts, key=lambda r: (r["_pid"], str(r[group]))):
        offs[(r["_pid"], r[group])] = tot.get(r[group], 0)
        tot[r[group]] = tot.get(r[group], 0) + r["c"]
    from pyspark.sql import types as T
    schema = T.StructType(list(s.schema.fields) + [T.StructField("_rank", T.LongType()), T.StructField("_gsize", T.LongType())])

    def run(it):
        seen = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            ranks, sizes = [], []
            for pid, g in zip(pdf["_pid"], pdf[group]):
                k = (int(pid), g)
                i = seen.get(k, 0)
                seen[k] = i + 1
                ranks.append(offs[k] + i)
                sizes.append(tot[g])
            out = pdf.copy()
            out["_rank"] = pd.Series(ranks, dtype="int64")
            out["_gsize"] = pd.Series(sizes, dtype="int64")
            yield out
    return s.mapInPandas(run, schema).drop("_pid")


def stratified_split(df: DataFrame, label: str, id_col: str, val: float = 0.1, test: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """train/val/test with the class ratio kept: within each class, the first round(test*n) rows by the
    seeded key go to test, the next round(val*n) to val, the rest to train."""
    keyed = df.withColumn("_k", seeded_key(id_col, seed))
    r = ranks_within(keyed, label, ["_k", id_col])
    n_test = F.floor(F.col("_gsize") * test + 0.5)
    n_val = F.floor(F.col("_gsize") * val + 0.5)
    split = (F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train"))
    return r.withColumn("split", split).drop("_k", "_rank", "_gsize")


def dedup_samples(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """One row per normalised text (lower, trimmed), keeping the smallest id (partial aggregation, skew-safe).

    Texts are told apart by their SHA-256, so the shuffle and its sort compare digests, not whole texts."""
    norm = F.sha2(F.lower(F.trim(F.col(text))).cast("binary"), 256)
    cols = [c for c in df.columns]
    g = df.groupBy(norm.alias("_norm")).agg(F.min_by(F.struct(*cols), F.col(id_col)).alias("_row"),
                                            F.count("*").alias("copies"))
    return g.select("_row.*", "copies")


def train_tier2(train: DataFrame, test: DataFrame, text: str = "text", label: str = "label",
                num_features: int = 1 << 16, max_iter: int = 100, reg: float = 0.001):
    """Tokenizer → HashingTF (term presence) → IDF → LogisticRegression; returns (model, held-out report).

    Defaults (presence features, IDF over terms in >= 2 documents, L2 0.001) were chosen on the
    validation split of the supplied labelled documents, never on the test split.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[^\p{L}\p{N}_]+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features, binary=True),
        IDF(inputCol="_tf", outputCol="_feat", minDocFreq=2),
        LogisticRegression(featuresCol="_feat", labelCol=label, maxIter=max_iter, regParam=reg),
    ])
    model = pipe.fit(train.withColumn(label, F.col(label).cast("double")))
    pred = model.transform(test.withColumn(label, F.col(label).cast("double")))
    p, y = F.col("prediction") == 1.0, F.col(label) == 1.0
    c = pred.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                 F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    from gatelens.operators.evaluation import prf
    report = c.select("tp", "fp", "tn", "fn", *prf(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))
    return model, report
