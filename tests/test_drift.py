import datetime as dt

from pyspark.sql import functions as F

from gatelens.operators import drift as dr

AS_OF = "2024-01-31 00:00:00"


def series(spark, rows):
    df = spark.createDataFrame(rows, "app_id string, contract_id string, ts timestamp_ntz, score double")
    return dr.compliance_series(df)


def hours_before(h):
    return dt.datetime(2024, 1, 31) - dt.timedelta(hours=h)


def test_alert_needs_samples_and_a_strict_drop(spark):
    rows = [("a", "c", hours_before(100 + i), 1.0) for i in range(20)] + [("a", "c", hours_before(1 + i * 0.5), 0.7) for i in range(10)]
    a = dr.drift_check(series(spark, rows), AS_OF).collect()
    assert len(a) == 1 and a[0]["severity"] == "high" and a[0]["recent_avg"] == 0.7
    few = rows[:20] + rows[20:25]
    assert dr.drift_check(series(spark, few), AS_OF).count() == 0            # recent window under 10 samples


def test_severity_from_rounded_drop(spark):
    df = spark.createDataFrame([(0.25,), (0.1499,), (0.10,), (0.05,)], "d double")
    got = [r[0] for r in df.select(dr.severity(F.col("d"))).collect()]
    assert got == ["critical", "medium", "medium", "low"]


def test_identical_points_stored_once_and_retention(spark):
    t = hours_before(1)
    s = series(spark, [("a", "c", t, 0.5), ("a", "c", t, 0.5), ("a", "c", hours_before(24 * 31), 0.5)])
    assert s.count() == 2
    assert dr.prune_retention(s, AS_OF, 30).count() == 1


def test_timeline_equals_point_checks(spark):
    rows = [("a", "c", dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * i), 1.0 if i < 200 else 0.6) for i in range(240)]
    s = series(spark, rows)
    tl = {r["tick"]: r["alert"] for r in dr.drift_timeline(s, "2024-01-20", "2024-01-31").collect()}
    for tick, alert in tl.items():
        assert alert == (dr.drift_check(s, tick + " 00:00:00").count() == 1), tick


def test_day_partitioned_store_prunes_and_filters(spark, tmp_path):
    rows = [("a", "c", hours_before(h), 0.9) for h in (1, 30, 80)]
    s = series(spark, rows)
    path = str(tmp_path / "store")
    dr.write_compliance(s, path, mode="overwrite")
    got = dr.read_compliance(spark, path, AS_OF, 48)
    assert got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


def _drift_model(points, as_of, recent_h=24, base_h=168, thr=0.10, min_n=10):
    def window(h):
        lo = as_of - dt.timedelta(hours=h)
        return [s for t, s in points if lo <= t <= as_of]
    r, b = window(recent_h), window(base_h)
    if len(r) < min_n or len(b) < min_n:
        return None
    ra, ba = sum(r) / len(r), sum(b) / len(b)
    if ba <= 0:
        return None
    drop = (ba - ra) / ba
    return drop if drop > thr else None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10 * 24 * 60), st.integers(0, 10000)), min_size=1, max_size=80),
       st.integers(0, 10000))
def test_drift_check_matches_model(spark, pts, recent_cut):
    as_of = dt.datetime(2024, 1, 31)
    points = {}
    for minutes, units in pts:
        t = as_of - dt.timedelta(minutes=minutes)
        score = units / 10000.0 if minutes >= 24 * 60 else min(units, recent_cut) / 10000.0
        points[(t, score)] = None
    points = list(points)
    got = dr.drift_check(series(spark, [("a", "c", t, s) for t, s in points]), AS_OF).collect()
    want = _drift_model(points, as_of)
    assert (len(got) == 1) == (want is not None)
    if want is not None:
        assert abs(got[0]["drop_pct"] - want) <= 0.00005 + 1e-12


def test_store_is_pruned_in_place_and_later_days_are_untouched(spark, tmp_path):
    import os
    path = str(tmp_path / "store")
    dr.prune_store(spark, path, AS_OF, 2)                        # nothing there: nothing happens
    rows = [("a", "c", hours_before(h), 0.5) for h in (0, 1, 30, 47, 48, 49, 71, 72, 100, 1000)]
    s = series(spark, rows)
    dr.write_compliance(s, path)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns     # noqa: E731
                     for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    for _ in range(2):                                           # a second run changes no row
        dr.prune_store(spark, path, AS_OF, 2)
        back = spark.read.parquet(path)
        assert sorted(r["ts_us"] for r in back.collect()) == sorted(r["ts_us"] for r in dr.prune_retention(s, AS_OF, 2).collect())
        later = {f for f in before if f.split("day=")[1][:10] > "2024-01-29"}
        assert later and all(files().get(f) == before[f] for f in later)
        assert min(f.split("day=")[1][:10] for f in files()) == "2024-01-29"
    dr.prune_store(spark, path, "2024-03-31 12:00:00", 2)
    assert not files()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 5000), st.integers(0, 10_000)), min_size=1, max_size=60),
       st.sampled_from([1, 7, 60, 300]), st.sampled_from([(0.01, 0.1), (0.25, 0.05), (0.5, 0.5)]))
def test_sweep_equals_the_windows_at_any_cadence(spark, points, every_s, hours):
    """Few ticks a chunk, scores on tick and window borders, scores before the first tick."""
    base = dt.datetime(2024, 1, 1)
    s = series(spark, [(a, "c", base + dt.timedelta(seconds=t), u / 10_000) for a, t, u in points])
    stored = {(a, t, u) for a, t, u in points}
    cfg = dr.DriftConfig(recent_hours=hours[0], baseline_hours=hours[1])
    first, last = 600, 600 + 5 * every_s + 3600
    saved, dr._TICKS = dr._TICKS, 4
    try:
        got = {(r["app_id"], r["tick"]): r for r in dr.drift_timeline(
            s, str(base + dt.timedelta(seconds=first)), str(base + dt.timedelta(seconds=last)), cfg, every_s=every_s).collect()}
    finally:
        dr._TICKS = saved
    apps, ticks = {a for a, _, _ in stored}, range(first, last + 1, every_s)
    assert len(got) == len(apps) * len(ticks)
    for a in apps:
        for t in ticks:
            r = got[a, str(base + dt.timedelta(seconds=t))]
            recent = [u for b, x, u in stored if b == a and t - hours[0] * 3600 <= x <= t]
            longer = [u for b, x, u in stored if b == a and t - hours[1] * 3600 <= x <= t]
            assert (r["recent_n"], r["baseline_n"]) == (len(recent), len(longer)), (a, t)
            if recent:
                assert abs(r["recent_avg"] - sum(recent) / len(recent) / 10_000) < 6e-5


def test_sweep_reads_its_window_only_and_takes_named_keys(spark, tmp_path):
    path = str(tmp_path / "scores")
    spark.createDataFrame([("a", "c", hours_before(h), 0.5) for h in (1, 30, 900)] + [("b", "c", hours_before(2), 0.5)],
                          "app_id string, contract_id string, ts timestamp_ntz, score double").write.parquet(path)
    s = dr.compliance_series(spark.read.parquet(path))
    named = spark.createDataFrame([("a", "c"), ("z", "c")], "app_id string, contract_id string")
    tl = dr.drift_timeline(s, "2024-01-30 00:00:00", AS_OF, every_s=3600, keys=named)
    plan = tl._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    got = {(r["app_id"], r["tick"]): (r["recent_n"], r["baseline_n"]) for r in tl.collect()}
    assert {a for a, _ in got} == {"a", "z"} and len(got) == 50
    assert got["a", AS_OF] == (1, 2) and got["z", AS_OF] == (0, 0)
