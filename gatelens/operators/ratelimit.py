"""Rate-limit analytics: exact sliding-window admission replay and related reports.

Admission is order dependent (a rejected request consumes no slot), so plain
window counts are wrong. It runs as a fold over range-partitioned chunks whose
state is at most ``max_requests`` timestamps per key; a busy key is spread over
many chunks, whose start states are settled first (``ordered.chunked_fold``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.operators.ordered import chunked_fold


def epoch_ms(ts: str | Column) -> Column:
    from gatelens.sources.tables import epoch_us
    return F.floor(epoch_us(ts) / F.lit(1000)).cast("long")


def _admission_kernel(max_requests: int, window_ms: int):
    """A request is refused if the ``max_requests``-th latest admitted one is still inside the window.

    State: the stamps admitted within the window before the last request, at most ``max_requests``.
    """
    if max_requests < 1:
        raise ValueError("a limit admits at least one request a window")

    def kernel(state: list, stamps: list):
        used, oldest = list(state), 0              # used[oldest:] lie inside the window
        admitted, counts, retry, header = [], [], [], []
        for now in stamps:
            left = now - window_ms
            while oldest < len(used) and used[oldest] <= left:
                oldest += 1
            wait_ms = used[-max_requests] - left if len(used) >= max_requests else 0
            admitted.append(wait_ms <= 0)
            if wait_ms <= 0:
                used.append(now)
            counts.append(len(used) - oldest)
            retry.append(wait_ms / 1000 if wait_ms > 0 else None)
            header.append(wait_ms // 1000 if wait_ms > 0 else None)
        return used[oldest:], [admitted, counts, retry, header]
    return kernel


ADMISSION_COLUMNS = "admitted boolean, count_after int, retry_after double, retry_after_header int"


def _requests(log: DataFrame, key: str, ts_ms: str, request_id: str) -> DataFrame:
    return log.select(F.col(key).cast("string").alias("key"), F.col(ts_ms).cast("long").alias("ts_ms"),
                      F.col(request_id).cast("long").alias("request_id")).filter(F.col("ts_ms").isNotNull())


def rate_admission(log: DataFrame, key: str, ts_ms: str, request_id: str, max_requests: int = 100,
                   window_s: int = 60, split: bool = True) -> DataFrame:
    """Replay the sliding-window limiter: admitted, count after the decision, retry-after for rejections.

    A busy caller is folded by many tasks (``chunked_fold``), with or without quiet gaps. Requests of one instant go by
    id; requests without a time have no place in the order and give no row; a null key is a caller like any other.
    ``split=False`` folds each caller in one task, the plain definition that tests compare with.
    """
    return chunked_fold(_requests(log, key, ts_ms, request_id), "key", ["ts_ms", "request_id"],
                        _admission_kernel(max_requests, int(window_s) * 1000), ADMISSION_COLUMNS,
                        num_partitions=None if split else 1)


def rate_peek(decisions: DataFrame, as_of_ms: int, window_s: int, max_requests: int) -> DataFrame:
    """Per key at ``as_of``: used slots, remaining, reset_at (oldest + W, or as_of when empty), no consumption."""
    w_ms = int(window_s) * 1000
    live = decisions.filter(F.col("admitted") & (F.col("ts_ms") > as_of_ms - w_ms) & (F.col("ts_ms") <= as_of_ms))
    used = live.groupBy("key").agg(F.count("*").alias("used"), F.min("ts_ms").alias("oldest_ms"))
    keys = decisions.select("key").distinct()
    j = keys.join(used, "key", "left")
    used_c = F.coalesce("used", F.lit(0)).cast("long")
    return j.select("key", used_c.alias("used"), F.greatest(F.lit(0), F.lit(max_requests) - used_c).alias("remaining"),
                    F.when(F.col("oldest_ms").isNotNull(), (F.col("oldest_ms") + w_ms) / 1000.0)
                    .otherwise(F.lit(as_of_ms / 1000.0)).alias("reset_at"))


def with_reset_epochs(log: DataFrame, resets: DataFrame, key: str, ts_ms: str, chunk_ms: int = 86_400_000) -> DataFrame:
    """As-of attach: each request gets the number of its key's resets at or before it.

    A running count over the union of requests and resets, computed per (key, day) and carried across
    days by a small (key, day) table, so a busy key is spread over its days.
    """
    a = log.select("*", F.lit(0).alias("_is_reset"))
    b = resets.select(F.col(key), F.col(ts_ms), F.lit(1).alias("_is_reset"))
    u = a.unionByName(b, allowMissingColumns=True).withColumn("_chunk", F.floor(F.col(ts_ms) / chunk_ms).cast("long"))
    w = (Window.partitionBy(key, "_chunk").orderBy(F.col(ts_ms), F.col("_is_reset").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    per_chunk = u.groupBy(key, "_chunk").agg(F.sum("_is_reset").alias("_n"))
    before = per_chunk.select(key, "_chunk", F.sum("_n").over(
        Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return (u.join(before, [key, "_chunk"])
             .withColumn("reset_epoch", (F.coalesce("_before", F.lit(0)) + F.sum("_is_reset").over(w)).cast("long"))
             .filter(F.col("_is_reset") == 0).drop("_is_reset", "_chunk", "_before"))


def rate_rollup(decisions: DataFrame, prefix: str = "ratelimit") -> DataFrame:
    return decisions.groupBy(F.lit(prefix).alias("prefix"), "key").agg(
        F.count_if("admitted").alias("allowed"), F.count_if(~F.col("admitted")).alias("rejected_429"))


def rate_fixed_vs_sliding(log: DataFrame, key: str, ts_ms: str, window_s: int, chunk_ms: int = 86_400_000) -> DataFrame:
    """Busiest fixed (tumbling) window vs busiest trailing window per key; the gap shows boundary bursts.

    Trailing counts run per (key, day) chunk; rows from the last window-width of the previous day are
    copied in as context (a halo), so every count is exact and a busy key is spread over its days.
    """
    w_ms = int(window_s) * 1000
    chunk_ms = max(chunk_ms, w_ms)
    fixed = (log.groupBy(key, F.floor(F.col(ts_ms) / w_ms).alias("bucket")).agg(F.count("*").alias("n"))
             .groupBy(key).agg(F.max("n").alias("max_fixed")))
    chunk = F.floor(F.col(ts_ms) / chunk_ms).cast("long")
    own = log.select(key, ts_ms, chunk.alias("_chunk"), F.lit(True).alias("_own"))
    halo = (log.filter(F.col(ts_ms) >= (chunk + 1) * chunk_ms - w_ms)
            .select(key, ts_ms, (chunk + 1).alias("_chunk"), F.lit(False).alias("_own")))
    trailing = F.count("*").over(Window.partitionBy(key, "_chunk").orderBy(F.col(ts_ms)).rangeBetween(-(w_ms - 1), 0))
    sliding = (own.unionByName(halo).select(key, "_own", trailing.alias("n")).filter("_own")
               .groupBy(key).agg(F.max("n").alias("max_sliding")))
    return fixed.join(sliding, key).select(key, F.col("max_fixed").cast("long").alias("max_fixed"),
                                           F.col("max_sliding").cast("long").alias("max_sliding"),
                                           (F.col("max_sliding") > F.col("max_fixed")).alias("boundary_burst"))


def _leaky_kernel(rate_mph: int, burst: int):
    """State: the excess after the last admitted request and that request's time (none before a caller's first)."""
    limit = burst * 1000

    def kernel(state: list, stamps: list):
        admitted, excesses = [], []
        for now in stamps:
            if not state:
                excess = 0
            else:
                excess = max(state[0] - rate_mph * (now - state[1]) // 3_600_000 + 1000, 0)
            admitted.append(excess <= limit)
            if excess <= limit:
                state = [excess, now]
            excesses.append(state[0])
        return list(state), [admitted, excesses]
    return kernel


def rate_leaky_bucket(log: DataFrame, key: str, ts_ms: str, request_id: str, rate_per_hour: float,
                      burst: int) -> DataFrame:
    """Leaky bucket with burst and no delay: excess (milli-requests) drains at ``rate``; reject above burst."""
    return chunked_fold(_requests(log, key, ts_ms, request_id), "key", ["ts_ms", "request_id"],
                        _leaky_kernel(int(round(rate_per_hour * 1000)), burst), "admitted boolean, excess_milli bigint")
