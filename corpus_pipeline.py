"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm import decontaminate, linededup, minhash, packing, quality
from gatelens.llm.queries import tokenizer_path
from gatelens.session import ensure_checkpoint_dir
from gatelens.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content; the line model is fitted on labels."""
    return quality.keep_good(docs, quality.fit_on_labels(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more are taken out everywhere; no document is dropped."""
    out = linededup.without_frequent_lines(docs, min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 of five-word shingles."""
    return minhash.keep_one_each(docs, shingle_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, placed in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), seq_len=4096)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", pack)]

ORACLE_SQL = None      # the line model, signatures and packing are not expressible in SQL; tests compare by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; the stages' tables go to a folder of their own in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
