"""File sources and sinks: labelled JSONL, rule files, proxy access logs, evaluation reports, score stores."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.functions.lexicon import strict_parse_json
from gatelens.functions.patterns import SEVERITY_RANK
from gatelens.session import ensure_checkpoint_dir

RESOURCES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (visible to every executor)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/gatelens-io/{name}-{uuid.uuid4().hex[:12]}"


def read_labelled_jsonl(spark: SparkSession, path: str, require_rows: bool = True):
    """JSONL of {text, label}: blank lines skipped; rows that are not JSON or miss a field go to ``bad``.

    Returns (good DF[text string, label int], bad DF[line string, reason string]).
    """
    raw = spark.read.text(path).filter(F.trim("value") != "")
    v = strict_parse_json(F.col("value"))
    text = F.try_variant_get(v, "$.text", "string")
    label = F.try_variant_get(v, "$.label", "string").try_cast("int")
    p = raw.select("value", v.isNull().alias("bad_json"), text.alias("text"), label.alias("label"))
    reason = (F.when(F.col("bad_json"), "not JSON").when(F.col("text").isNull(), "missing text")
              .when(F.col("label").isNull(), "missing or non-integer label"))
    tagged = p.withColumn("reason", reason)
    good = tagged.filter(F.col("reason").isNull()).select("text", "label")
    bad = tagged.filter(F.col("reason").isNotNull()).select(F.col("value").alias("line"), "reason")
    if require_rows and good.isEmpty():
        raise ValueError(f"no labelled samples in {path}")
    return good, bad


def class_counts(good: DataFrame) -> DataFrame:
    return good.groupBy("label").agg(F.count("*").alias("n"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8 (non-ASCII kept as is)."""
    df.write.mode("overwrite").option("compression", "none").json(path)


def write_patterns(spark: SparkSession, rules: list[dict], path: str) -> None:
    """A rule file: one JSON array of {id, severity, regex, description}."""
    spark.createDataFrame([(json.dumps(rules),)], "value string").coalesce(1).write.text(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a JSON array; uncompilable regexes dropped; stable order by severity desc, then file order."""
    arr = spark.read.option("multiLine", True).option("wholetext", False).json(path, schema=(
        "id string, severity string, regex string, description string"))
    # file order: the JSON array is read in order by a single-file scan; keep it explicitly
    rules = arr.withColumn("pos", F.monotonically_increasing_id()).collect()   # a rule file: tens of rows
    from gatelens.operators.contracts import regex_error
    ok = []
    for i, r in enumerate(sorted(rules, key=lambda r: r["pos"])):
        if regex_error("(?is)" + r["regex"], spark) is not None:   # a bad rule must not stop the guard from loading
            continue
        if r["severity"] not in SEVERITY_RANK:
            continue
        ok.append((r["id"], r["severity"], r["regex"], r["description"] or "", i, SEVERITY_RANK[r["severity"]]))
    df = spark.createDataFrame(ok, "id string, severity string, regex string, description string, pos int, severity_rank int")
    return df.orderBy(F.col("severity_rank").desc(), "pos")


ACCESS_LOG_SCHEMA = ("time string, remote_addr string, method string, uri string, status int, request_time double, "
                     "bytes_sent long, upstream_response_time double, http_user_agent string, x_request_id string")


def read_access_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Structured proxy access-log lines (one JSON object per line) with a fixed schema."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(ACCESS_LOG_SCHEMA).json(path)


def write_eval_report(metrics: DataFrame, curve: DataFrame, judge: DataFrame | None, path: str) -> None:
    """Metrics + curve + optional judge block as one JSON document (all inputs are small aggregates)."""
    parts = [("metrics", metrics), ("pr_curve", curve)] + ([("tier3", judge)] if judge is not None else [])
    blocks = [df.agg(F.collect_list(F.struct(*df.columns)).alias(name)) for name, df in parts]
    # one-row blocks combined by union + first(ignorenulls): no join between them
    typed = [b.select(*[(F.col(n) if n == b.columns[0] else F.lit(None).cast(o.schema[0].dataType)).alias(n)
                        for n, o in zip([p[0] for p in parts], blocks)]) for b in blocks]
    u = typed[0]
    for t in typed[1:]:
        u = u.unionByName(t)
    doc = u.agg(*[F.first(n, ignorenulls=True).alias(n) for n, _ in parts])
    cols = [F.col(n) for n, _ in parts]
    doc.select(F.to_json(F.struct(*cols)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_compliance(df: DataFrame, path: str, mode: str = "append") -> None:
    from gatelens.operators.drift import write_compliance as _w
    _w(df, path, mode)
