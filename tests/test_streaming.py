from pyspark.sql import functions as F

from conftest import SF_SMALL
from gatelens.plans import fixtures as fx
from gatelens.streaming import streams as stx


def test_sliding_and_session_windows_match_batch(spark):
    log = fx.request_log(spark, SF_SMALL, stx.table_stream(spark, SF_SMALL, "events"))
    from gatelens.plans.catalog import _latest_snapshot
    sl = _latest_snapshot(stx.sliding_counts(log, ["status"]), ["window", "status"], "sliding")
    batch = fx.request_log(spark, SF_SMALL)
    want = stx.with_event_time(batch).groupBy(F.window("event_time", "1 hour", "15 minutes"), "status").count()
    assert sl.count() == want.count()
    assert sl.agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0]
    # session windows support append only: closed sessions are emitted once the watermark passes them
    out = spark.read.parquet(stx.run_to_parquet(stx.session_counts(log, ["user_id"]), "sessions"))
    got = {(r["user_id"], r["session_window"]["start"], r["n"]) for r in out.collect()}
    sess = stx.with_event_time(batch).groupBy(F.session_window("event_time", "30 minutes"), "user_id").count()
    want = {(r["user_id"], r["session_window"]["start"], r["count"]) for r in sess.collect()}
    assert got and got <= want


def test_stream_admission_equals_batch(spark):
    from gatelens.plans.catalog import QUERIES
    a = {tuple(r) for r in QUERIES["stream_rate_admission"](spark, SF_SMALL).collect()}
    b = {tuple(r) for r in QUERIES["rate_admission"](spark, SF_SMALL).collect()}
    assert a == b


def test_late_rows_behind_the_watermark_are_counted(spark, tmp_path):
    """Late events are filtered with the watermark of the previous batch, so old rows arriving in the third
    batch (after two batches advanced the watermark) are dropped and reported."""
    import datetime as dt
    import time
    src = str(tmp_path / "scores")
    schema = "app_id string, contract_id string, ts timestamp_ntz, score double"
    batches = [[dt.datetime(2024, 1, 10, h) for h in range(5)], [dt.datetime(2024, 1, 11, h) for h in range(4)],
               [dt.datetime(2024, 1, 1, h) for h in range(3)]]
    for i, ts in enumerate(batches):
        spark.createDataFrame([("a", "c", t, 0.9) for t in ts], schema).coalesce(1).write.parquet(f"{src}/f={i}")
        time.sleep(1.5)      # the file source orders new files by modification time
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    parts, q = stx.latest_snapshot(stx.hourly_partials(stream), ["app_id", "contract_id", "window"], "late")
    assert stx.rows_dropped_by_watermark(q) == 3
    assert parts.agg(F.sum("n")).first()[0] == 9


def _files(spark, src, schema, batches):
    import time
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/f={i}")
        time.sleep(1.2)      # the file source orders new files by modification time
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src))


def test_admission_state_survives_other_keys_batches(spark, tmp_path):
    """A key idle for a while keeps its stamps until they leave the window, whatever other keys do meanwhile."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 10, 0)
    at = lambda h: t0 + dt.timedelta(hours=h)
    batches = [[(1, 7, at(0)), (2, 7, at(1)), (3, 7, at(2))], [(4, 8, at(20))], [(5, 7, at(4))], [(6, 9, at(23))],
               [(7, 7, at(24.5)), (8, 7, at(24.6))]]
    stream = _files(spark, str(tmp_path / "calls"), "event_id long, user_id long, ts timestamp_ntz", batches)
    out = spark.read.parquet(stx.run_to_parquet(stx.stream_rate_admission(stream, 3, 86_400), "admission-idle"))
    got = {r["request_id"]: (r["admitted"], r["count_after"]) for r in out.collect()}
    assert got == {1: (True, 1), 2: (True, 2), 3: (True, 3), 4: (True, 1), 5: (False, 3), 6: (True, 1), 7: (True, 3), 8: (False, 3)}


def test_ema_state_crosses_micro_batches(spark, tmp_path):
    schema = "alias string, provider string, ts_ms long, request_id long, latency_ms double"
    batches = [[("a", "p", 1, 1, 0.0)], [("a", "p", 2, 2, 100.0), ("a", "p", 3, 3, 50.0)], [("a", "p", 4, 4, 10.0)]]
    routes = spark.createDataFrame([("a", "p", 0.0)], "alias string, provider string, avg_latency double")
    stream = _files(spark, str(tmp_path / "samples"), schema, batches)
    last, _ = stx.latest_snapshot(stx.stream_latency_ema(stream, routes), ["alias", "provider"], "ema-batches")
    row = last.first()
    assert row["samples"] == 4 and abs(row["ema_ms"] - (0.2 * 10 + 0.8 * (0.2 * 50 + 0.8 * 100))) < 1e-9
