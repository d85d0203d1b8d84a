"""Structured Streaming variants that reuse the batch Columns and folds.

Every runner reads a file stream, writes to a parquet sink (or idempotent
``foreachBatch`` sinks) with its checkpoint in the shared checkpoint folder,
and can run with ``availableNow`` so tests compare it with the batch result.
State is bounded: admission keeps at most ``max`` stamps per key and times out
after one window of event time; drift keeps hourly partials behind a watermark.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatelens.sources.io import scratch_path
from gatelens.sources.tables import epoch_us


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A supplied table as a file stream (schema taken from the files)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")      # a pattern may name a file; this one names no other table


def with_event_time(df: DataFrame, col: str = "ts", out: str = "event_time") -> DataFrame:
    """TIMESTAMP_NTZ → TIMESTAMP (watermarks need zoned timestamps), independent of the session zone."""
    return df.withColumn(out, F.timestamp_micros(epoch_us(col)))


def instant_to_ntz(c) -> "F.Column":
    """TIMESTAMP (an instant, e.g. a window bound) → UTC wall-clock TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def run_to_parquet(sdf: DataFrame, name: str, mode: str = "append", available_now: bool = True) -> str:
    spark = sdf.sparkSession
    out, ckpt = scratch_path(spark, f"stream-{name}"), scratch_path(spark, f"ckpt-{name}")
    w = sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode(mode)
    q = (w.trigger(availableNow=True) if available_now else w).start()
    if available_now:
        q.awaitTermination()
    return out


def run_foreach_batch(sdf: DataFrame, name: str, fn, mode: str = "append"):
    ckpt = scratch_path(sdf.sparkSession, f"ckpt-{name}")
    q = (sdf.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def rows_dropped_by_watermark(query) -> int:
    """Late rows a finished query's stateful operators discarded (from its progress reports)."""
    return int(sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress
                   for op in (p.get("stateOperators") or [])))


def latest_snapshot(sdf: DataFrame, keys: list[str], name: str):
    """Update-mode stream → idempotent per-batch parquet parts → (latest row per key, finished query)."""
    from pyspark.sql import Window
    spark = sdf.sparkSession
    out = scratch_path(spark, f"snap-{name}")

    def sink(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    q = run_foreach_batch(sdf, name, sink, mode="update")
    parts = spark.read.parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return parts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_batch", "batch"), q


# ------------------------------------------------------------------ stateful: admission and EMA
def admission_state_fn(max_requests: int, window_ms: int):
    def fn(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        dq = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(pdfs)).sort_values(["ts_ms", "request_id"])
        out = []
        for ts, rid in zip(rows["ts_ms"].tolist(), rows["request_id"].tolist()):
            while dq and dq[0] <= ts - window_ms:
                dq.popleft()
            if len(dq) >= max_requests:
                retry = max(0.0, ((dq[0] + window_ms) - ts) / 1000)
                out.append((key[0], ts, rid, False, len(dq), retry))
            else:
                dq.append(ts)
                out.append((key[0], ts, rid, True, len(dq), None))
        state.update((list(dq),))
        # a stamp matters until one window after itself, however far the watermark (of all keys) is; a timeout must
        # lie after the watermark
        newest = max(dq, default=0)
        state.setTimeoutTimestamp(max(newest + window_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "ts_ms", "request_id", "admitted", "count_after", "retry_after"])
    return fn


def stream_rate_admission(events: DataFrame, max_requests: int, window_s: int) -> DataFrame:
    """Keyed admission with bounded state (≤ max stamps per key), kept until the watermark is one window past the
    key's newest stamp. A key's rows of one micro-batch are sorted in memory: bound them with maxFilesPerTrigger."""
    w_ms = window_s * 1000
    e = (with_event_time(events).withWatermark("event_time", f"{window_s} seconds")
         .select(F.col("user_id").cast("string").alias("key"),
                 F.floor(epoch_us("ts") / 1000).cast("long").alias("ts_ms"), F.col("event_id").alias("request_id"),
                 "event_time"))
    return e.groupBy("key").applyInPandasWithState(
        admission_state_fn(max_requests, w_ms),
        "key string, ts_ms long, request_id long, admitted boolean, count_after int, retry_after double",
        "stamps array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def ema_state_fn(alpha: float, seeds: dict):
    keep = 1 - alpha

    def fn(key, pdfs, state: GroupState):
        old = state.get[0] if state.exists else float(seeds.get(tuple(key), 0.0))
        rows = pd.concat(list(pdfs)).sort_values(["ts_ms", "request_id"])
        n = state.get[1] if state.exists else 0
        for x in rows["latency_ms"].tolist():
            old = x if old == 0.0 else alpha * x + keep * old
            n += 1
        state.update((old, n))
        yield pd.DataFrame([(key[0], key[1], n, old)], columns=["alias", "provider", "samples", "ema_ms"])
    return fn


def stream_latency_ema(samples: DataFrame, routes: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Running EMA per (alias, provider); emits the latest value per key after each micro-batch."""
    seeds = {(r["alias"], r["provider"]): r["avg_latency"] for r in routes.collect()}   # alias registry: small
    s = samples.join(routes.select("alias", "provider"), ["alias", "provider"])
    return s.groupBy("alias", "provider").applyInPandasWithState(
        ema_state_fn(alpha, seeds), "alias string, provider string, samples long, ema_ms double",
        "ema double, n long", "update", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ windows
def hourly_partials(scores: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(key, hour window) → exact unit sums and counts behind a watermark."""
    s = with_event_time(scores).withWatermark("event_time", delay)
    units = F.round(F.col("score") * 10000).cast("long")
    return s.groupBy("app_id", "contract_id", F.window("event_time", "1 hour")).agg(
        F.sum(units).alias("units"), F.count("*").alias("n"))


def tumbling_counts(df: DataFrame, by: list[str], size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return (with_event_time(df).withWatermark("event_time", delay)
            .groupBy(F.window("event_time", size), *by).agg(F.count("*").alias("n")))


def sliding_counts(df: DataFrame, by: list[str], size: str = "1 hour", slide: str = "15 minutes",
                   delay: str = "10 minutes") -> DataFrame:
    return (with_event_time(df).withWatermark("event_time", delay)
            .groupBy(F.window("event_time", size, slide), *by).agg(F.count("*").alias("n")))


def session_counts(df: DataFrame, by: list[str], gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return (with_event_time(df).withWatermark("event_time", delay)
            .groupBy(F.session_window("event_time", gap), *by).agg(F.count("*").alias("n")))


def stream_dedup(df: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    return with_event_time(df).withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])
