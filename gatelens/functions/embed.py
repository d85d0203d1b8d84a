"""Deterministic text embedding: hashed term frequencies of word tokens, L2-normalised (Spark ML, JVM-side).

A stand-in encoder with the encoder interface (text → unit vector); real models
plug in through ``mapInPandas`` with one model load per worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.lexicon import tokens


def hashed_embeddings(df: DataFrame, text: str, out: str = "v", dim: int = 64) -> DataFrame:
    """Adds ``out``: a dense unit-length array<double> of ``dim`` hashed token counts (O(tokens) per row)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    t = df.withColumn("_toks", tokens(F.coalesce(F.col(text), F.lit(""))))
    tf = HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=dim).transform(t)
    norm = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(tf)
    return norm.withColumn(out, vector_to_array("_unit")).drop("_toks", "_tf", "_unit")
