"""Compliance drift: score series, windows, snapshots, alerts and timelines.

Every check is one conditional aggregation per (app, contract) key: the recent
and baseline windows are two FILTERed aggregates over one scan (the baseline
window contains the recent one, as in the online detector). Time filters are
on the event-time column, so they reach the parquet scan as pushed filters.
Timelines sum the scores that enter and leave the windows per (key, tick)
first; running sums then go over ticks, not rows, so their cost does not grow
with traffic per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.numeric import half_up
from gatelens.session import cut_lineage
from gatelens.sources.tables import epoch_us

KEY = ["app_id", "contract_id"]
SCALE = 10000.0  # scores carry 4 decimals: sums run over exact integer units, independent of partitioning


def _units(c: Column | str = "score") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(SCALE)).cast("long")


def _mean(units_sum: Column, n: Column) -> Column:
    return F.try_divide(units_sum.cast("double"), n.cast("double")) / F.lit(SCALE)


@dataclass(frozen=True)
class DriftConfig:
    # Online detector defaults (24 h recent, 7 d baseline, 10 % drop, 10 samples, 30 d retention).
    recent_hours: float = 24.0
    baseline_hours: float = 168.0
    threshold: float = 0.10
    min_samples: int = 10
    retention_days: int = 30


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _minus_hours(as_of: str, hours: float) -> Column:
    return _ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600.0))


def severity(drop: Column) -> Column:
    """Severity from the 4-dp rounded drop: >=.25 critical, >=.15 high, >=.10 medium, else low."""
    return (F.when(drop >= 0.25, "critical").when(drop >= 0.15, "high").when(drop >= 0.10, "medium").otherwise("low"))


def compliance_series(scores: DataFrame) -> DataFrame:
    """(app, contract, ts, score rounded to 4 dp); identical (ts, score) per key kept once."""
    return (scores.select(*KEY, "ts", epoch_us("ts").alias("ts_us"), F.round("score", 4).alias("score"))
            .dropDuplicates(KEY + ["ts", "score"]))   # ts as key: window filters on ts push down to the scan


def scores_in_window(series: DataFrame, as_of: str, hours: float) -> DataFrame:
    """Inclusive [as_of - hours, as_of]."""
    return series.filter((F.col("ts") >= _minus_hours(as_of, hours)) & (F.col("ts") <= _ts(as_of)))


def compliance_snapshot(series: DataFrame, as_of: str, hours: float = 24.0) -> DataFrame:
    """avg/n/min/max per key in the window; keys without samples produce no row."""
    w = scores_in_window(series, as_of, hours)
    return w.groupBy(*KEY).agg(half_up(_mean(F.sum(_units()), F.count("*")), 6).alias("avg_score"),
                               F.count("*").alias("sample_count"),
                               F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def _window_stats(series: DataFrame, as_of: str, cfg: DriftConfig) -> DataFrame:
    base = scores_in_window(series, as_of, cfg.baseline_hours)
    recent = F.col("ts") >= _minus_hours(as_of, cfg.recent_hours)
    return base.groupBy(*KEY).agg(
        F.count_if(recent).alias("recent_n"), F.count("*").alias("baseline_n"),
        _mean(F.sum(F.when(recent, _units())), F.count_if(recent)).alias("recent_avg"),
        _mean(F.sum(_units()), F.count("*")).alias("baseline_avg"))


def _alert_cols(cfg: DriftConfig, extra: list | None = None) -> list[Column]:
    drop = F.try_divide(F.col("baseline_avg") - F.col("recent_avg"), F.col("baseline_avg"))
    drop_r = half_up(drop, 4)
    return (extra or []) + [half_up("baseline_avg", 4).alias("baseline_avg"), half_up("recent_avg", 4).alias("recent_avg"),
                            drop_r.alias("drop_pct"), severity(drop_r).alias("severity"),
                            F.lit(cfg.recent_hours).alias("window_hours"), F.lit(cfg.baseline_hours).alias("baseline_hours")]


def _is_alert(cfg: DriftConfig) -> Column:
    drop = F.try_divide(F.col("baseline_avg") - F.col("recent_avg"), F.col("baseline_avg"))
    return ((F.col("recent_n") >= cfg.min_samples) & (F.col("baseline_n") >= cfg.min_samples)
            & (F.col("baseline_avg") > 0) & (drop > cfg.threshold))


def drift_check(series: DataFrame, as_of: str, cfg: DriftConfig = DriftConfig(), apps: list[str] | None = None) -> DataFrame:
    """One alert row per key whose recent average dropped more than the threshold below the baseline."""
    s = series.filter(F.col("app_id").isin(*apps)) if apps else series
    st = _window_stats(s, as_of, cfg)
    return st.filter(_is_alert(cfg)).select(*KEY, *_alert_cols(cfg))


def drift_severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("app_id", "severity").agg(F.count("*").alias("alerts"))


def drift_summary(series: DataFrame, as_of: str, cfg: DriftConfig = DriftConfig(),
                  catalog: DataFrame | None = None) -> DataFrame:
    """Every catalogued key: recent snapshot (NULL/0 when empty) plus its alert (if any)."""
    cat = catalog if catalog is not None else series.select(*KEY).distinct()
    snap = compliance_snapshot(series, as_of, cfg.recent_hours)
    alerts = drift_check(series, as_of, cfg).select(*KEY, "drop_pct", "severity")
    out = cat.join(snap, KEY, "left").join(alerts, KEY, "left")
    return out.select(*KEY, half_up("avg_score", 4).alias("avg_compliance"),
                      F.coalesce("sample_count", F.lit(0)).cast("long").alias("sample_count"),
                      "min_score", "max_score", "drop_pct", "severity",
                      F.col("severity").isNotNull().cast("int").alias("alert_count"))


_TICKS = 1024      # ticks a chunk of the running sums


def drift_timeline(series: DataFrame, first_tick: str, last_tick: str, cfg: DriftConfig = DriftConfig(),
                   every_s: int = 86_400, keys: DataFrame | None = None) -> DataFrame:
    """The drift check at every tick first_tick, first_tick + every_s, ... up to last_tick, for any windows.

    A sweep: a score enters both windows [T - hours, T] at the first tick at or after its time and leaves each at the first
    tick beyond time + hours. These changes are summed per (key, tick) before the shuffle, and running sums over ticks give
    the windows' counts and exact sums; they run per (key, 1024 ticks) and start from the totals of earlier chunks, so
    neither a busy key nor a long timeline is one task. Only scores of [first_tick - longest window, last_tick] are read.
    Every key gets every tick: the keys of ``keys`` if given, else those of the whole series (a scan of its own).
    """
    named = keys is not None
    keys = (keys if named else series).select(*KEY).distinct()
    step, first = int(every_s) * 1_000_000, epoch_us(_ts(first_tick))

    def ticks_until(us: Column) -> Column:          # floor of (us - first) / step, exactly
        return ((us - first - F.pmod(us - first, F.lit(step))) / step).cast("long")

    final = ticks_until(epoch_us(_ts(last_tick)))
    longest = max(cfg.recent_hours, cfg.baseline_hours)
    near = series.filter((F.col("ts") >= _minus_hours(first_tick, longest)) & (F.col("ts") <= _ts(last_tick)))
    units, zero, one = F.coalesce(_units(), F.lit(0)).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")

    def change(j: Column, rn: Column, rs: Column, bn: Column, bs: Column) -> Column:
        return F.struct(F.greatest(j, zero).alias("j"), rn.alias("rn"), rs.alias("rs"), bn.alias("bn"), bs.alias("bs"))

    def leaves(hours: float) -> Column:
        return ticks_until(F.col("ts_us") + F.lit(int(round(hours * 3_600_000_000)))) + 1

    changes = near.select(*KEY, F.inline(F.array(
        change(ticks_until(F.col("ts_us") - 1) + 1, one, units, one, units),
        change(leaves(cfg.recent_hours), -one, -units, zero, zero),
        change(leaves(cfg.baseline_hours), zero, zero, -one, -units))))
    chunk = ((F.col("j") - F.pmod(F.col("j"), F.lit(_TICKS))) / _TICKS).cast("long")
    grid = (keys.select(*KEY, F.explode(F.sequence(zero, ((final - F.pmod(final, F.lit(_TICKS))) / _TICKS).cast("long"))).alias("c"))
            .select(*KEY, F.explode(F.sequence(F.col("c") * _TICKS, F.least(F.col("c") * _TICKS + _TICKS - 1, final))).alias("j"),
                    *[zero.alias(n) for n in ("rn", "rs", "bn", "bs")]))
    sums = ["rn", "rs", "bn", "bs"]
    at = (grid.unionByName(changes.filter(F.col("j") <= final)).groupBy(*KEY, chunk.alias("chunk"), "j")
          .agg(*[F.sum(n).alias(n) for n in sums]))
    if named:
        at = at.join(keys, KEY, "left_semi")
    before = Window.partitionBy(*KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (at.groupBy(*KEY, "chunk").agg(*[F.sum(n).alias(n) for n in sums])
             .select(*KEY, "chunk", *[F.coalesce(F.sum(n).over(before), zero).alias(f"{n}0") for n in sums]))
    inside = Window.partitionBy(*KEY, "chunk").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    run = at.join(carry, KEY + ["chunk"]).select(*KEY, "j", *[(F.col(f"{n}0") + F.sum(n).over(inside)).alias(n) for n in sums])
    st = run.select(*KEY, F.timestamp_add("SECOND", (F.col("j") * int(every_s)).cast("int"), _ts(first_tick)).alias("tick"),
                    F.col("rn").alias("recent_n"), F.col("bn").alias("baseline_n"),
                    _mean(F.col("rs"), F.col("rn")).alias("recent_avg"), _mean(F.col("bs"), F.col("bn")).alias("baseline_avg"))
    tick = F.date_format("tick", "yyyy-MM-dd" if every_s % 86_400 == 0 else "yyyy-MM-dd HH:mm:ss")
    return st.select(*KEY, tick.alias("tick"), "recent_n", "baseline_n",
                     F.coalesce(_is_alert(cfg), F.lit(False)).alias("alert"),
                     half_up("recent_avg", 4).alias("recent_avg"), half_up("baseline_avg", 4).alias("baseline_avg"))


def daily_compliance(series: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Day × key mean; marked when the mean fell more than ``threshold`` (relative) below the previous day's."""
    d = series.groupBy(*KEY, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"),
                                                               _mean(F.sum(_units()), F.count("*")).alias("mean"))
    prev = F.lag("mean").over(Window.partitionBy(*KEY).orderBy("day"))
    return d.select(*KEY, F.col("day").cast("string").alias("day"), "n", half_up("mean", 6).alias("mean_score"),
                    F.coalesce(F.try_divide(prev - F.col("mean"), prev) > threshold, F.lit(False)).alias("drop_alert"))


def prune_retention(series: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Drop entries with ts <= as_of - days (the reference removes the cutoff instant too)."""
    return series.filter(F.col("ts") > _ts(as_of) - F.make_dt_interval(F.lit(days)))


def write_compliance(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append scores partitioned by day so retention and window reads prune whole partitions."""
    (df.withColumn("day", F.to_date("ts")).write.mode(mode).partitionBy("day").parquet(path))


def read_compliance(spark, path: str, as_of: str, hours: float) -> DataFrame:
    """Scores of the window [as_of - hours, as_of] from the day-partitioned store (whole-day partitions pruned)."""
    lo = _minus_hours(as_of, hours)
    s = spark.read.parquet(path).filter((F.col("day") >= F.to_date(lo)) & (F.col("day") <= F.to_date(_ts(as_of))))
    return s.filter((F.col("ts") >= lo) & (F.col("ts") <= _ts(as_of))).drop("day")


def prune_store(spark, path: str, as_of: str, days: int = 30) -> None:
    """Apply the retention to the day-partitioned store in place: entries with ts <= as_of - days go.

    Folders of days before the cutoff's day are removed, the cutoff's own day is rewritten (its remaining rows are
    checkpointed, then dynamic partition overwrite replaces that folder alone); later days' files are not touched.
    Running it again changes nothing, so a job that died half-way is run again. A missing store or an empty one stays so.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return
    cutoff = spark.range(1).select((_ts(as_of) - F.make_dt_interval(F.lit(days))).alias("c")).first()["c"]
    last = cutoff.date().isoformat()
    stored = {s.getPath().getName().removeprefix("day="): s.getPath() for s in fs.listStatus(root)
              if s.getPath().getName().startswith("day=")}
    if last in stored:
        boundary = spark.read.parquet(path).filter(F.col("day") == F.to_date(F.lit(last)))
        kept = cut_lineage(boundary.filter(F.col("ts") > F.lit(cutoff).cast("timestamp_ntz")))
        if kept.isEmpty():
            fs.delete(stored[last], True)
        else:
            (kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
    for day, folder in stored.items():
        if day < last:            # ISO dates order as text
            fs.delete(folder, True)
