from collections import deque

from hypothesis import given, settings
from hypothesis import strategies as st

from gatelens.operators import ratelimit as rl


def model(events, max_requests, window_ms):
    out, dqs = {}, {}
    for key, ts, rid in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        dq = dqs.setdefault(key, deque())
        while dq and dq[0] <= ts - window_ms:
            dq.popleft()
        if len(dq) >= max_requests:
            out[rid] = False
        else:
            dq.append(ts)
            out[rid] = True
    return out


def admit(spark, events, m, w_s, split=True):
    df = spark.createDataFrame(events, "key string, ts long, rid long")
    return {r["request_id"]: r["admitted"] for r in rl.rate_admission(df, "key", "ts", "rid", m, w_s, split).collect()}


def test_five_per_ten_seconds_then_reject_and_keys_isolated(spark):
    ev = [("a", 1000 + i, i) for i in range(7)] + [("b", 1000, 100)]
    got = admit(spark, ev, 5, 10)
    assert [got[i] for i in range(7)] == [True] * 5 + [False] * 2 and got[100]


def test_rejected_requests_use_no_slot_and_retry_after(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 5000, 2), ("a", 10000, 3)], "key string, ts long, rid long")
    rows = {r["request_id"]: r for r in rl.rate_admission(df, "key", "ts", "rid", 1, 10).collect()}
    assert rows[1]["admitted"] and not rows[2]["admitted"] and rows[2]["retry_after"] == 5.0
    assert rows[2]["retry_after_header"] == 5 and rows[3]["admitted"]          # the entry at 0 is evicted at 10 s


def test_peek_and_reset_epochs(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1000, 2), ("b", 0, 3)], "key string, ts long, rid long")
    d = rl.rate_admission(df, "key", "ts", "rid", 5, 10)
    p = {r["key"]: r for r in rl.rate_peek(d, 5000, 10, 5).collect()}
    assert (p["a"]["used"], p["a"]["remaining"], p["a"]["reset_at"]) == (2, 3, 10.0)
    resets = spark.createDataFrame([("a", 500)], "key string, ts long")
    e = {r["rid"]: r["reset_epoch"] for r in rl.with_reset_epochs(df, resets, "key", "ts").collect()}
    assert e == {1: 0, 2: 1, 3: 0}


events = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 60_000)), min_size=1, max_size=60)


@settings(max_examples=15, deadline=None)
@given(events, st.integers(1, 4), st.integers(1, 20))
def test_fold_equals_sequential_model_and_never_exceeds_limit(spark, evs, m, w):
    ev = [(k, t, i) for i, (k, t) in enumerate(evs)]
    got = admit(spark, ev, m, w)
    assert got == model(ev, m, w * 1000)
    assert got == admit(spark, ev, m, w, split=False)          # quiet-gap splitting changes nothing
    for k in "abc":
        ts = sorted(t for kk, t, i in ev if kk == k and got[i])
        assert all(sum(1 for u in ts if t - w * 1000 < u <= t) <= m for t in ts)


def test_leaky_bucket_burst(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(5)], "key string, ts long, rid long")
    got = [r["admitted"] for r in rl.rate_leaky_bucket(df, "key", "ts", "rid", 3600.0, 2).orderBy("request_id").collect()]
    assert got == [True, True, True, False, False]              # first + burst of 2, nothing drained in 4 ms


@settings(max_examples=10, deadline=None)
@given(events, st.integers(1, 5000), st.integers(50, 20_000))
def test_chunked_segmentation_equals_single_chunk(spark, evs, gap, chunk):
    from gatelens.operators.ordered import quiet_gap_segments
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(evs)], "key string, ts long, rid long")
    a = {r["rid"]: r["_seg"] for r in quiet_gap_segments(df, ["key"], "ts", "rid", gap, chunk_ms=chunk).collect()}
    b = {r["rid"]: r["_seg"] for r in quiet_gap_segments(df, ["key"], "ts", "rid", gap, chunk_ms=10**12).collect()}
    assert a == b


def test_chunked_reset_epochs_equal_single_chunk(spark):
    df = spark.createDataFrame([("a", t, t) for t in range(0, 100_000, 700)], "key string, ts long, rid long")
    resets = spark.createDataFrame([("a", t) for t in range(350, 100_000, 9_000)], "key string, ts long")
    a = {r["rid"]: r["reset_epoch"] for r in rl.with_reset_epochs(df, resets, "key", "ts", chunk_ms=5_000).collect()}
    b = {r["rid"]: r["reset_epoch"] for r in rl.with_reset_epochs(df, resets, "key", "ts", chunk_ms=10**12).collect()}
    assert a == b and max(a.values()) == 12


def test_sliding_counts_with_halo_equal_single_chunk(spark):
    rows = [("a", t, t) for t in list(range(0, 30_000, 900)) + list(range(9_500, 10_500, 50))]
    df = spark.createDataFrame(rows, "key string, ts long, rid long")
    a = rl.rate_fixed_vs_sliding(df, "key", "ts", 2, chunk_ms=3_000).first()
    b = rl.rate_fixed_vs_sliding(df, "key", "ts", 2, chunk_ms=10**12).first()
    assert a == b and a["max_sliding"] >= a["max_fixed"]


def test_simultaneous_requests_admit_exactly_the_limit(spark):
    got = admit(spark, [("k", 5000, i) for i in range(10)], 5, 10)
    assert sum(got.values()) == 5 and all(got[i] for i in range(5))      # tie order: request id


def _leaky_model(events, rate_mph, burst):
    out, state = {}, {}
    for key, ts, rid in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if key not in state:
            state[key] = (0, ts)
            out[rid] = True
            continue
        excess, last = state[key]
        e = max(excess - rate_mph * (ts - last) // 3_600_000 + 1000, 0)
        if e > burst * 1000:
            out[rid] = False
        else:
            out[rid] = True
            state[key] = (e, ts)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40 * 3_600_000)), min_size=1, max_size=60),
       st.sampled_from([0.05, 1.0, 30.0]), st.integers(0, 3))
def test_leaky_bucket_matches_model(spark, evs, rate, burst):
    ev = [(k, t, i) for i, (k, t) in enumerate(evs)]
    df = spark.createDataFrame(ev, "key string, ts long, rid long")
    got = {r["request_id"]: r["admitted"] for r in rl.rate_leaky_bucket(df, "key", "ts", "rid", rate, burst).collect()}
    assert got == _leaky_model(ev, int(round(rate * 1000)), burst)


@settings(max_examples=12, deadline=None)
@given(events, st.integers(1, 3), st.integers(1, 20))
def test_retry_after_and_counts_match_model(spark, evs, m, w):
    ev = [(k, t, i) for i, (k, t) in enumerate(evs)]
    df = spark.createDataFrame(ev, "key string, ts long, rid long")
    got = {r["request_id"]: r for r in rl.rate_admission(df, "key", "ts", "rid", m, w).collect()}
    dqs = {}
    for key, ts, rid in sorted(ev, key=lambda e: (e[0], e[1], e[2])):
        dq = dqs.setdefault(key, deque())
        while dq and dq[0] <= ts - w * 1000:
            dq.popleft()
        r = got[rid]
        if len(dq) >= m:
            assert not r["admitted"] and r["count_after"] == len(dq)
            retry = max(0.0, ((dq[0] + w * 1000) - ts) / 1000)
            assert r["retry_after"] == retry and r["retry_after_header"] == int(retry)
        else:
            dq.append(ts)
            assert r["admitted"] and r["count_after"] == len(dq) and r["retry_after"] is None


@settings(max_examples=12, deadline=None)
@given(events, st.integers(1, 3), st.integers(1, 20), st.integers(0, 70_000))
def test_peek_matches_model(spark, evs, m, w, as_of):
    ev = [(k, t, i) for i, (k, t) in enumerate(evs)]
    df = spark.createDataFrame(ev, "key string, ts long, rid long")
    d = rl.rate_admission(df, "key", "ts", "rid", m, w)
    got = {r["key"]: (r["used"], r["remaining"], r["reset_at"]) for r in rl.rate_peek(d, as_of, w, m).collect()}
    adm = model(ev, m, w * 1000)
    for key in {k for k, _, _ in ev}:
        live = sorted(t for k, t, i in ev if k == key and adm[i] and as_of - w * 1000 < t <= as_of)
        reset = (live[0] + w * 1000) / 1000 if live else as_of / 1000
        assert got[key] == (len(live), max(0, m - len(live)), reset)


def _busy_log(spark, n, every_ms):
    """Half the rows belong to one caller without a quiet gap; the other half to 500 callers."""
    from pyspark.sql import functions as F
    i = F.col("id")
    return spark.range(n).select(F.when(i % 2 == 0, "busy").otherwise(F.concat(F.lit("k"), (F.xxhash64(i) % 250).cast("string"))).alias("key"),
                                 (i * every_ms + F.pmod(F.xxhash64(i, F.lit(7)), F.lit(every_ms * 3))).alias("ts"), i.alias("rid"))


def _chunks_of_busy_caller(decisions):
    from pyspark.sql import functions as F
    return decisions.filter(F.col("key") == "busy").select(F.spark_partition_id().alias("p")).distinct().count()


def test_busy_caller_without_quiet_gaps_is_spread_over_tasks(spark):
    log = _busy_log(spark, 40_000, 20)                       # 25 requests a second for the busy caller
    for limit, window_s in ((3000, 60), (200, 10), (40, 2)):  # never full; nearly always full; now and then full
        d = rl.rate_admission(log, "key", "ts", "rid", limit, window_s)
        assert _chunks_of_busy_caller(d) >= 3
        whole = rl.rate_admission(log, "key", "ts", "rid", limit, window_s, split=False)
        assert d.exceptAll(whole).count() == 0 and d.count() == 40_000
        got = {r["request_id"]: r["admitted"] for r in d.collect()}
        events = [tuple(r) for r in log.collect()]
        assert got == model(events, limit, window_s * 1000)


def test_chunks_that_never_agree_are_folded_by_one_task(spark):
    rows = [("tick", 10 * i, i) for i in range(3000)] + [("other", 10 * i, 10_000 + i) for i in range(50)]
    got = admit(spark, rows, 1, 1)                           # 1 admitted in 100, phase never forgotten
    assert got == model(rows, 1, 1000)
    from gatelens.operators.ordered import chunked_fold
    df = spark.createDataFrame(rows, "key string, ts_ms long, request_id long")
    for rounds in (0, 1, 2):
        d = chunked_fold(df, "key", ["ts_ms", "request_id"], rl._admission_kernel(1, 1000), rl.ADMISSION_COLUMNS, rounds=rounds)
        assert {r["request_id"]: r["admitted"] for r in d.collect()} == got


def test_chunked_leaky_bucket_of_a_busy_caller(spark):
    log = _busy_log(spark, 20_000, 3000)
    got = {r["request_id"]: r["admitted"] for r in rl.rate_leaky_bucket(log, "key", "ts", "rid", 300.0, 5).collect()}
    assert got == _leaky_model([tuple(r) for r in log.collect()], 300_000, 5)


def test_odd_requests_have_a_defined_result(spark):
    schema = "key string, ts long, rid long"
    assert rl.rate_admission(spark.createDataFrame([], schema), "key", "ts", "rid", 1, 1).count() == 0
    rows = [(None, 5, 1), (None, 6, 2), ("a", None, 3), ("a", 5, 4), ("a", 5, 4), ("a", 5, None)]
    d = rl.rate_admission(spark.createDataFrame(rows, schema), "key", "ts", "rid", 1, 10).collect()
    assert sorted((r["key"] or "", r["request_id"] or 0, r["admitted"]) for r in d) == [
        ("", 1, True), ("", 2, False), ("a", 0, True), ("a", 4, False), ("a", 4, False)]
