"""Classifier evaluation over a persisted ``scored`` table (model, id, label, prob, latency_ms).

Inference happens once upstream; every report is an aggregate. Threshold
sweeps count scores per interval between thresholds (partial aggregation
map-side) and add the intervals up from the top; the curve over all distinct
scores does the same with running totals over range-partitioned chunks.
Percentiles over all history are exact and selected by refining histograms, so
no task holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.operators.detection import attack_category
from gatelens.operators.ordered import running_totals
from gatelens.session import cut_lineage

# Curve thresholds 0.10 .. 0.95 step 0.05.
CURVE_THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(18)]


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion(scored: DataFrame, threshold: float = 0.5, by: str = "model") -> DataFrame:
    pos = F.col("prob") >= threshold
    y = F.col("label") == 1
    return scored.groupBy(by).agg(
        F.count_if(pos & y).alias("tp"), F.count_if(pos & ~y).alias("fp"),
        F.count_if(~pos & ~y).alias("tn"), F.count_if(~pos & y).alias("fn"))


def prf(tp: Column, fp: Column, tn: Column, fn: Column, digits: int = 6) -> list[Column]:
    p = _div(tp, tp + fp)
    r = _div(tp, tp + fn)
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))
    acc = _div(tp + tn, tp + fp + tn + fn)
    return [F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"),
            F.round(f1, digits).alias("f1"), F.round(acc, digits).alias("accuracy")]


def precision_recall_f1(scored: DataFrame, threshold: float = 0.5, by: str = "model") -> DataFrame:
    c = confusion(scored, threshold, by)
    return c.select(by, "tp", "fp", "tn", "fn", *prf(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


def pr_curve(scored: DataFrame, thresholds=CURVE_THRESHOLDS, by: str = "model") -> DataFrame:
    """Precision, recall and f1 at each threshold: a score falls into the interval that ends at the number of thresholds
    it reaches, intervals are counted, and a threshold takes those from its own upwards. The plan holds one expression
    for any number of (ascending) thresholds."""
    y = F.col("label") == 1
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.size(F.filter(ts, lambda t: F.col("prob") >= t))
    cells = (scored.groupBy(by, reached.alias("i")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
             .groupBy(by).agg(F.collect_list(F.struct("i", "p", "n")).alias("cells"), F.sum("p").alias("npos")))

    def upwards(i: Column, name: str) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["i"] > i, c[name]).otherwise(0))

    rows = F.transform(ts, lambda t, i: F.struct(t.alias("threshold"), upwards(i, "p").alias("tp"), upwards(i, "n").alias("fp")))
    long = cells.select(by, "npos", F.inline(rows))
    fn = F.col("npos") - F.col("tp")
    p, r, f1, _ = prf(F.col("tp"), F.col("fp"), F.lit(0), fn)
    return long.select(by, "threshold", "tp", "fp", p, r, f1)


def pr_curve_all(scored: DataFrame, by: str = "model") -> DataFrame:
    """The curve at every distinct score, highest first: rows at or above it that are positive (tp) and not (fp).

    Equal scores are counted first; the running totals go over range-partitioned chunks, so neither many scores nor one
    model with most of them make one large task. Null and NaN scores reach no threshold; null labels count as neither, but
    a recall of 0 is given where a model has no positive row at all.
    """
    y = F.col("label") == 1
    counts = (scored.filter(F.col("prob").isNotNull() & ~F.isnan("prob"))
              .groupBy(by, F.col("prob").cast("double").alias("threshold"))
              .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))
    run = running_totals(counts.withColumn("_down", -F.col("threshold")), by, "_down", {"pos": "tp", "neg": "fp"})
    npos = scored.groupBy(by).agg(F.count_if(y).alias("npos"))
    c, t = run.alias("c"), npos.alias("t")
    j = c.join(t, F.col(f"c.{by}").eqNullSafe(F.col(f"t.{by}"))).select(f"c.{by}", "threshold", "pos", "tp", "fp", "npos")
    return j.select(by, "threshold", "pos", "tp", "fp", "npos", *prf(F.col("tp"), F.col("fp"), F.lit(0), F.col("npos") - F.col("tp"))[:3])


def average_precision(curve: DataFrame, by: str = "model") -> DataFrame:
    """Per model: distinct scores, best f1 and average precision (precision weighted by the recall each score adds)."""
    step = _div(F.col("pos"), F.col("npos")) * _div(F.col("tp"), F.col("tp") + F.col("fp"))
    return curve.groupBy(by).agg(F.count("*").alias("n_thresholds"), F.max("f1").alias("best_f1"),
                                 F.round(F.sum(step), 6).alias("average_precision"))


_CELLS = 1024


def exact_percentiles(rows: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation (as ``percentile``) per group: (by, name of each point).

    Selection by refining histograms: the ranks a percentile needs start with the group's whole range; a round counts the
    values of each open range in 1024 equal cells (the range's two ends are cells of their own), and each rank goes on with
    the least and greatest value of its cell until they are equal. A round is one scan of two columns and one aggregation
    whose state is bounded by the cells, whatever a group's rows or distinct values; three or four rounds are usual. Every
    round takes a range's ends off it, so it ends for any values. Null and NaN values are left out; a group without others
    has null percentiles; a null group is a group.
    """
    v = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    whole = F.when(~F.isnan("v"), F.col("v"))
    groups = cut_lineage(v.groupBy("g").agg(F.count(whole).alias("n"), F.min(whole).alias("lo"), F.max(whole).alias("hi")))
    v = v.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    position = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in points.items()}
    ranks = F.array_distinct(F.array(*[f(c).cast("long") for c in position.values() for f in (F.floor, F.ceil)]))
    wanted = groups.filter(F.col("n") > 0).select("g", F.explode(ranks).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    done = None
    while True:
        wanted = cut_lineage(wanted)
        settled = wanted.filter(F.col("lo") == F.col("hi")).select("g", "k", F.col("lo").alias("v"))
        done = settled if done is None else done.unionByName(settled)
        still = wanted.filter(F.col("lo") < F.col("hi"))
        if still.isEmpty():
            break
        ranges = still.groupBy("g").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))   # two a point at most
        a, b = v.alias("a"), ranges.alias("b")
        inside = (a.join(b, F.col("a.g").eqNullSafe(F.col("b.g")))
                  .select("a.g", "v", F.explode(F.filter("ranges", lambda r: (F.col("v") >= r["lo"]) & (F.col("v") <= r["hi"]))).alias("r"))
                  .select("g", "v", "r.lo", "r.hi"))
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)     # halves: no overflow
        middle = F.when(F.isnan(share), 0).otherwise(F.least(F.floor(share * _CELLS), F.lit(_CELLS - 1)))
        cell = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), _CELLS).otherwise(middle).cast("int")
        hist = inside.groupBy("g", "lo", "hi", cell.alias("cell")).agg(
            F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        earlier = Window.partitionBy("g", "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
        s, h = still.alias("s"), hist.alias("h")
        at = F.col("s.k") - F.col("s.below")
        wanted = (s.join(h, F.col("s.g").eqNullSafe(F.col("h.g")) & (F.col("s.lo") == F.col("h.lo")) & (F.col("s.hi") == F.col("h.hi")))
                  .filter((at >= F.col("before")) & (at < F.col("before") + F.col("m")))
                  .select("s.g", "s.k", F.col("least").alias("lo"), F.col("most").alias("hi"),
                          (F.col("s.below") + F.col("before")).alias("below")))
    g, d = groups.select("g", "n").alias("a"), done.alias("d")
    ranked = g.join(d, F.col("a.g").eqNullSafe(F.col("d.g")), "left").select("a.g", "n", "k", "v")

    def point(name: str) -> Column:
        at = position[name]
        low, high = F.max(F.when(F.col("k") == F.floor(at), F.col("v"))), F.max(F.when(F.col("k") == F.ceil(at), F.col("v")))
        up = F.max(at - F.floor(at))
        return F.when(low == high, low).otherwise((1 - up) * low + up * high).alias(name)

    return ranked.groupBy(F.col("g").alias(by)).agg(*[point(name) for name in points])


def latency_summary(scored: DataFrame, by: str = "model") -> DataFrame:
    """Exact p50/p95/p99 (linear interpolation) and samples/s over all rows of a group, in bounded memory."""
    counts = scored.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.count("*") / (F.sum("latency_ms") / F.lit(1000.0)), 4).alias("samples_per_s"))
    points = exact_percentiles(scored, by, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    c, p = counts.alias("c"), points.alias("p")
    return c.join(p, F.col(f"c.{by}").eqNullSafe(F.col(f"p.{by}"))).select(
        f"c.{by}", "n", *[F.round(name, 4).alias(name) for name in ("p50_ms", "p95_ms", "p99_ms")], "samples_per_s")


def missed_attacks(scored: DataFrame, threshold: float = 0.5, n: int = 20, by: str = "model", key: str = "doc_id") -> DataFrame:
    """The n lowest-scored positives below threshold per model (top-k is the feature)."""
    miss = scored.filter((F.col("label") == 1) & (F.col("prob") < threshold))
    w = Window.partitionBy(by).orderBy(F.col("prob").asc(), F.col(key).asc())
    return (miss.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(by, "rank", key, "prob", F.substring("text", 1, 300).alias("snippet")))


def miss_categories(scored: DataFrame, threshold: float = 0.5, by: str = "model") -> DataFrame:
    miss = scored.filter((F.col("label") == 1) & (F.col("prob") < threshold))
    c = miss.groupBy(by, attack_category(F.col("text")).alias("category")).agg(F.count("*").alias("n"))
    tot = F.sum("n").over(Window.partitionBy(by))
    return c.select(by, "category", "n", F.round(F.col("n") / tot, 6).alias("share"))


def combined_recall(scored: DataFrame, verdicts: DataFrame, threshold: float = 0.5, by: str = "model",
                    key: str = "doc_id") -> DataFrame:
    """Tier-2 recall plus judge catches among its misses (judge errors count as no catch)."""
    v = verdicts.select(key, "is_injection", "error")
    j = scored.filter(F.col("label") == 1).join(v, key, "left")
    miss = F.col("prob") < threshold
    caught = miss & F.coalesce(F.col("is_injection") & F.col("error").isNull(), F.lit(False))
    a = j.groupBy(by).agg(
        F.count("*").alias("positives"),
        F.count_if(~miss).alias("tier2_tp"),
        F.count_if(miss).alias("misses"),
        F.count_if(caught).alias("judge_catches"),
        F.count_if(miss & F.col("error").isNotNull()).alias("judge_errors"))
    r2 = _div(F.col("tier2_tp"), F.col("positives"))
    rc = _div(F.col("tier2_tp") + F.col("judge_catches"), F.col("positives"))
    return a.select("*", F.round(r2, 6).alias("tier2_recall"), F.round(rc, 6).alias("combined_recall"),
                    F.round(_div(F.col("judge_catches"), F.col("misses")), 6).alias("catch_rate"),
                    F.round(rc - r2, 6).alias("recall_delta"))


def model_comparison(scored: DataFrame, threshold: float = 0.5, by: str = "model") -> DataFrame:
    """Quality and latency side by side, one row per model."""
    q, lat = precision_recall_f1(scored, threshold, by).alias("q"), exact_percentiles(
        scored, by, "latency_ms", {"p50_ms": 0.5, "p99_ms": 0.99}).alias("l")
    return q.join(lat, F.col(f"q.{by}").eqNullSafe(F.col(f"l.{by}"))).select(
        "q.*", F.round("p50_ms", 4).alias("p50_ms"), F.round("p99_ms", 4).alias("p99_ms"))
