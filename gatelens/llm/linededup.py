"""Line dedup over levelled sorted runs of line hashes.

A run is a folder of Parquet files sorted by line hash: (h1, h2, n_docs), one row per distinct line of the batches in
it. New batches enter as level-0 runs; when a level holds ``fanout`` runs they are merged into one run of the next
level, so a line hash is rewritten once per level and a lookup reads few runs. All of it lives in the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.llm.common import slices
from gatelens.session import cut_lineage, ensure_checkpoint_dir

_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """Key of each line: ASCII white space stripped at both ends, A-Z lower-cased (bytes methods are ASCII-only)."""
    return [line.strip(_SPACE) for line in (text or "").encode().lower().split(b"\n")]


def _halves(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _is_line(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document and distinct line."""
        for b in slices(batches):
            found = [_halves(k) for t in b.column(0).to_pylist() for k in {*line_keys(t)} if _is_line(k, min_chars)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["h1", "h2"])
    return run


class LineRuns:
    """Levelled sorted runs under ``folder`` (a new one in the shared checkpoint folder by default)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame, level: int) -> str:
        path = f"{self.folder}/level{level}-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _merged(self, paths: list[str]) -> DataFrame:
        runs = self.spark.read.schema("h1 long, h2 long, n_docs long").parquet(*paths)
        return runs if len(paths) == 1 else runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def add(self, docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> None:
        """Add a batch of documents as a new run, then compact the levels that are full."""
        hashed = docs.select(F.col(text_col).cast("string")).mapInArrow(_hash_lines(min_chars), "h1 long, h2 long")
        self.levels[0].append(self._write(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")), 0))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(self.levels[level]), level + 1))
            self.levels[level] = []     # the merged runs stay on disk until the folder is cleaned: readers may use them
            level += 1

    def lines(self) -> DataFrame:
        """(h1, h2, n_docs) of every line seen."""
        paths = [p for level in self.levels for p in level]
        return self._merged(paths) if paths else self.spark.createDataFrame([], "h1 long, h2 long, n_docs long")

    def drop_seen(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 1,
                  min_chars: int = 1, name: str = "dropped_lines") -> DataFrame:
        """``docs`` with column ``name``: positions of the lines that the runs hold from ``min_docs`` documents or more.

        Every line's (hash, id, position) is semi-joined with the runs' frequent lines by hash; the positions found are
        gathered per document. Ids must not repeat with different texts; a row without id drops nothing.
        """
        # a table of its own, so that the join shuffles both sides itself and can split the rows of a hot line
        frequent = cut_lineage(self.lines().where(F.col("n_docs") >= min_docs).select("h1", "h2"))
        lines = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
            .where("id IS NOT NULL").mapInArrow(_positions(min_chars), "id long, h1 long, h2 long, at array<int>")
        drops = lines.join(frequent, ["h1", "h2"], "left_semi") \
            .groupBy(F.col("id").alias("__drop_id")).agg(F.flatten(F.collect_set("at")).alias(name))
        return docs.join(drops, docs[id_col].cast("long") == drops["__drop_id"], "left").drop("__drop_id")


def _positions(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, h1, h2, at = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places: dict[bytes, list[int]] = {}
                for n, key in enumerate(line_keys(text)):
                    if _is_line(key, min_chars):
                        places.setdefault(key, []).append(n)
                for key, where in places.items():
                    x, y = _halves(key)
                    ids.append(i), h1.append(x), h2.append(y), at.append(where)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (ids, h1, h2)), pa.array(at, pa.list_(pa.int32()))],
                                             names=["id", "h1", "h2", "at"])
    return run


def _kept(text: str | None, drop: list[int] | None) -> tuple[str, int]:
    lines = (text or "").split("\n")
    gone = set(drop or ())
    return "\n".join(x for n, x in enumerate(lines) if n not in gone), len(lines)


def count_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1,
               batches: int = 4, fanout: int = 4) -> LineRuns:
    """Runs of a whole table, added in ``batches`` hash-dealt batches."""
    runs = LineRuns(docs.sparkSession, fanout=fanout)
    for n in range(batches):
        part = docs if batches == 1 else docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)) == n)
        runs.add(part, text_col, min_chars)
    return runs


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
               batches: int = 4) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): lines whose key occurs in ``min_docs`` documents or more go everywhere.

    A null or empty text is one empty line. A line that repeats inside one document counts once for it. Repeated rows
    are documents of their own when lines are counted; rows of one id must hold the same text. A row without id keeps
    all its lines (they still count). Only the two named columns are read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = count_runs(docs, "doc_id", "text", min_chars, batches).drop_seen(docs, min_docs=min_docs, min_chars=min_chars)

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(bs):
            drops = b.column(2).to_pylist()
            kept = [_kept(t, d) for t, d in zip(b.column(1).to_pylist(), drops)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64()),
                 pa.array([len(d or ()) for d in drops], pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])
    return marked.select("doc_id", "text", "dropped_lines").mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                           min_chars: int = 1, batches: int = 4) -> DataFrame:
    """``docs`` with the frequent lines taken out of the text column; other columns stay, null texts stay null."""
    drop_col, schema = "__dropped_lines", docs.schema
    runs = count_runs(docs, id_col, text_col, min_chars, batches)
    marked = runs.drop_seen(docs, id_col, text_col, min_docs, min_chars, drop_col)
    at = docs.columns.index(text_col)

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(bs):
            texts, drops = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new = [_kept(t, d)[0] if d else t for t, d in zip(texts, drops)]
            columns = [pa.array(new, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])
    return marked.mapInArrow(run, T.StructType(schema.fields))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
