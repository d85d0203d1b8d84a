"""Sorted-partition folds: order-dependent per-key state machines as Spark jobs.

``sorted_fold`` hash-partitions by key, sorts within partitions by (key, order)
and streams the rows through ``mapInPandas``. The fold keeps only the current
key's state (bounded by the operator, e.g. at most ``max`` timestamps), so a
hot key never has to fit in memory; Arrow batches arrive in order and state is
carried across batch boundaries.

Keys whose state provably resets (a quiet gap longer than the state's memory)
are split into independent segments first, so one busy key with idle periods
is folded by many tasks in parallel with the same exact result.

``chunked_fold`` needs no quiet period: rows are range-partitioned by (key, order),
each partition is a chunk, and a chunk that continues its predecessor's key is
folded from a guessed start state, which is corrected until it equals the
predecessor's end state.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gatelens.session import cut_lineage


DAY_MS = 86_400_000


def quiet_gap_segments(df: DataFrame, keys: list[str], ts: str, tiebreak: str, gap: int, name: str = "_seg",
                       chunk_ms: int = DAY_MS) -> DataFrame:
    """Adds a segment number that increases whenever the previous row of the key is >= ``gap`` earlier.

    Chunk-parallel: windows run per (key, time chunk); a small (key, chunk) table carries the previous
    chunk's last timestamp and segment count across the boundary, so a busy key is not one task.
    """
    c = df.withColumn("_chunk", F.floor(F.col(ts) / chunk_ms).cast("long"))
    wc = Window.partitionBy(*keys, "_chunk").orderBy(ts, tiebreak)
    c = c.withColumn("_prev", F.lag(ts).over(wc))
    summary = c.groupBy(*keys, "_chunk").agg(F.max(ts).alias("_last"), F.min(ts).alias("_first"),
                                             F.count_if(F.col("_prev").isNotNull() & (F.col(ts) - F.col("_prev") >= gap))
                                             .alias("_inner"))
    # per chunk: starts inside it, plus one at its first row when it follows a gap (or is the key's first chunk)
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    summary = summary.withColumn("_prev_last", F.lag("_last").over(by_chunk)).withColumn(
        "_starts", F.col("_inner") + F.when(F.col("_prev_last").isNull() | (F.col("_first") - F.col("_prev_last") >= gap), 1)
        .otherwise(0))
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_chunk", F.col("_prev_last").alias("_carry_prev"),
                           F.sum("_starts").over(earlier).alias("_before"))
    j = c.join(carry, keys + ["_chunk"])
    prev = F.coalesce(F.col("_prev"), F.col("_carry_prev"))
    start = F.when(prev.isNull() | (F.col(ts) - prev >= gap), 1).otherwise(0)
    return (j.withColumn("_start", start)
             .withColumn(name, (F.coalesce(F.col("_before"), F.lit(0))
                                + F.sum("_start").over(wc.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
             .drop("_start", "_chunk", "_prev", "_carry_prev", "_before"))


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str,
                num_partitions: int | None = None) -> DataFrame:
    """Run ``step(state, key_tuple, row_dict) -> (state, out_dict)`` over rows in (keys, order) order.

    ``state`` is None at the start of every key. ``schema`` describes the output rows.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = list(dict.fromkeys(keys + order + [c for c in df.columns if c not in keys + order]))
    out_cols = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key, state = None, None
        for pdf in batches:
            out = []
            columns = [pdf[c].tolist() for c in cols]
            key_idx = [cols.index(c) for c in keys]
            for vals in zip(*columns):
                r = dict(zip(cols, vals))
                k = tuple(vals[i] for i in key_idx)
                if k != cur_key:
                    cur_key, state = k, None
                state, o = step(state, k, r)
                out.append(o)
            yield pd.DataFrame(out, columns=out_cols)

    return (df.select(*cols).repartition(n, *keys).sortWithinPartitions(*keys, *order)
            .mapInPandas(run, schema))


def running_totals(df: DataFrame, key: str, order: str, sums: dict[str, str], num_partitions: int | None = None) -> DataFrame:
    """Adds running sums (column -> name of its sum, the row's own included) per key in ascending ``order``.

    Rows are range-partitioned by (key, order) into chunks; each chunk sums by itself and starts from the total of the
    key's earlier chunks (one row per key and chunk). (key, order) must be unique. A key may span any number of chunks.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = cut_lineage(df.repartitionByRange(n, key, order).withColumn("_chunk", F.spark_partition_id()))
    totals = base.groupBy(key, "_chunk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    chunks = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(F.col(key).alias("_key"), F.col("_chunk").alias("_at"),
                          *[F.coalesce(F.sum(f"_t_{c}").over(chunks), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    j = base.join(start, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_at")))
    return j.select(*df.columns, *[(F.col(f"_b_{c}") + F.sum(c).over(inside)).alias(name) for c, name in sums.items()])


SETTLE_ROUNDS = 8


def _key_runs(keys: list) -> list[tuple[int, int]]:
    """[start, end) of each stretch of equal keys."""
    cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
    return list(zip(cuts, cuts[1:])) if keys else []


def chunked_fold(df: DataFrame, key: str, order: list[str], kernel: Callable, added: str,
                 num_partitions: int | None = None, rounds: int = SETTLE_ROUNDS) -> DataFrame:
    """Fold each key's rows in ``order``; one key may be spread over any number of tasks.

    ``kernel(state, values) -> (state, columns)`` takes a stretch of one key's rows (``values``: its ``order[0]`` as a
    list) with the state before it (a list of integers, empty at a key's start) and returns the state after it and one
    list per column of ``added`` (a DDL schema). The rows come back with these columns behind their own.

    A chunk is one range partition. Only a chunk's first key can have earlier rows, and only in the chunk before, so one
    end state a chunk (at most the kernel's state, kept on the driver) says where the next one starts. Chunks that hold
    one key alone pass states on: they are folded from the empty state, then again from the end state of their
    predecessor, until no start changes. States that forget their start agree after a round or two; a key whose chunks
    still disagree after ``rounds`` rounds (a caller beyond its limit all the time) is folded by one task, in bounded
    memory. Results do not depend on the chunks.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = cut_lineage(df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
                       .withColumn("_chunk", F.spark_partition_id()))
    key_type = df.schema[key].dataType.simpleString()
    value = order[0]

    def end_states(starts: dict, todo: set | None) -> dict:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = first = last = None
            state: list = []
            for b in batches:
                if not b.num_rows:
                    continue
                keys, values = b.column(0).to_pylist(), b.column(1).to_pylist()
                if chunk is None:
                    chunk, first = b.column(2)[0].as_py(), keys[0]
                    if todo is not None and chunk not in todo:
                        return
                    state, last = starts.get((chunk, first), []), first
                lo = _key_runs(keys)[-1][0]     # stretches that end inside the batch leave no state behind
                if keys[lo] != last:
                    state, last = [], keys[lo]
                state, _ = kernel(state, values[lo:])
            if chunk is not None:
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "first": first, "last": last, "state": state}],
                                                 schema=ends_schema)

        ends_schema = pa.schema([("chunk", pa.int32()), ("first", arrow_key), ("last", arrow_key),
                                 ("state", pa.list_(pa.int64()))])
        rows = base.select(key, value, "_chunk").mapInArrow(
            run, f"chunk int, first {key_type}, last {key_type}, state array<bigint>").collect()
        return {r["chunk"]: r for r in rows}

    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
    arrow_key = to_arrow_type(df.schema[key].dataType)
    ends = end_states({}, None)
    order_of = sorted(ends)
    follows = {c: p for p, c in zip(order_of, order_of[1:]) if ends[p]["last"] == ends[c]["first"]}
    passes_on = {c for c in follows if ends[c]["first"] == ends[c]["last"]}
    starts: dict = {}
    unsettled: list = []
    for turn in range(rounds + 1):
        wanted = {(c, ends[c]["first"]): list(ends[p]["state"]) for c, p in follows.items()}
        again = {c for c, k in wanted if c in passes_on and wanted[(c, k)] != starts.get((c, k), [])}
        starts = wanted
        if not again:
            break
        if turn == rounds:
            unsettled = list(dict.fromkeys(ends[c]["first"] for c in again))
            break
        ends.update(end_states(starts, again))

    schema = StructType(df.schema.fields + StructType.fromDDL(added).fields)
    out_schema = to_arrow_schema(schema)
    position, value_at, width = df.columns.index(key), df.columns.index(value), len(df.columns)

    def fold_from(known: dict) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, state, begun = None, [], False
            for b in batches:
                if not b.num_rows:
                    continue
                keys, values = b.column(position).to_pylist(), b.column(value_at).to_pylist()
                chunk = b.column(width)[0].as_py()
                new: list[list] = [[] for _ in range(len(out_schema) - width)]
                for lo, hi in _key_runs(keys):
                    if not begun or keys[lo] != last:
                        state, last, begun = known.get((chunk, keys[lo]), []), keys[lo], True
                    state, columns = kernel(state, values[lo:hi])
                    for whole, part in zip(new, columns):
                        whole.extend(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(width)] + [pa.array(c, out_schema.field(width + i).type)
                                                           for i, c in enumerate(new)], schema=out_schema)
        return run

    if not unsettled:
        return base.mapInArrow(fold_from(starts), schema)
    apart = F.lit(False)
    for k in unsettled:
        apart = apart | F.col(key).eqNullSafe(F.lit(k))
    alone = base.filter(apart).repartition(n, key).sortWithinPartitions(key, *order)
    return base.filter(~apart).mapInArrow(fold_from(starts), schema).unionByName(alone.mapInArrow(fold_from({}), schema))
