"""Sequence packing: shortest-pack-first over the length histogram.

Only the histogram of piece lengths (at most ``seq_len`` rows, however many documents) reaches the driver. It is
packed there into patterns with multiplicities; the patterns go back to the pieces by rank among equal lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.llm.common import slices
from gatelens.session import cut_lineage

END_ID = 2
_END = END_ID.to_bytes(4, "little")
_CACHE_WORDS = 1_000_000
_MARKS = bytes(c for c in range(33, 127) if not bytes([c]).isalnum() and c != ord(">"))   # ">" may end a special token


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class WordIds(dict):
    """Packed little-endian token ids of white-space separated words, remembered up to a bound.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are its words' ids in
    order. Nor does it join an ASCII letter with a run of ASCII marks that ends the word. Keys are lower-cased words,
    but words that may hold a special token's string, which counts in its own case only: they keep their case and take
    the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = t = Tokenizer.from_file(path)
        self.model, self.normalize, self.split = t.model, t.normalizer.normalize_str, t.pre_tokenizer.pre_tokenize_str

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(_MARKS)
        if b"<|" in word:
            packed = _packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        elif stem != word and stem[-1:].isalpha():
            packed = self[stem] + self[word[len(stem):]]
        else:
            text = word.decode()
            pieces = (text,) if word.isalpha() else (p for p, _ in self.split(self.normalize(text)))
            packed = _packed([t.id for p in pieces for t in self.model.tokenize(p)])
        if len(word) <= 64:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        if not text:
            return _END
        raw = text.encode()
        if b"<|" in raw:
            words = (w if b"<|" in w else w.lower() for w in raw.split())
        else:
            words = raw.lower().split()
        return b"".join(map(self.__getitem__, words)) + _END


_word_ids: dict[str, WordIds] = {}     # one per Python worker, kept between its tasks


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, seq_len: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _word_ids:
            _word_ids[path] = WordIds(path)
        words = _word_ids[path]
        for b in slices(batches):
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = words.encode(text)
                for at in range(0, len(ids), 4 * seq_len):
                    piece = ids[at:at + 4 * seq_len]
                    out.append((i, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                               + (np.frombuffer(piece, "<u4"),) * with_ids)
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
    return run


def pack_histogram(counts: dict[int, int], seq_len: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, how many per pack), ...] with their number of packs, covering the histogram exactly.

    Shortest pack first: lengths are placed longest first; each goes to the packs with most room left (the shortest
    ones) if it fits there, else it opens new packs of as many pieces as one holds. Packs with the same content are one
    pattern with a count, so a step updates counts, not packs. Any piece that fits somewhere fits the shortest pack.
    """
    by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(room: int, pattern: tuple, number: int) -> None:
        if number:
            by_room.setdefault(room, []).append((pattern, number))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max(by_room, default=0)
            if room < length:
                per = min(seq_len // length, left)
                number = left // per
                pattern, room = (), seq_len
            else:
                pattern, number = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                per = 1
            used = min(number, left)
            if pattern:
                put(room, pattern, number - used)
            grown = (pattern[:-1] + ((length, pattern[-1][1] + per),)) if pattern and pattern[-1][0] == length \
                else pattern + ((length, per),)
            put(room - length * per, grown, used)
            left -= used * per
    return [(list(p), n) for room in sorted(by_room) for p, n in by_room[room]]


def slot_rows(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, per pack, first sequence, first offset) for every length of every pattern."""
    rows, next_rank, sequence = [], {}, 0
    for pattern, number in patterns:
        offset = 0
        for length, per in pattern:
            first = next_rank.get(length, 0)
            next_rank[length] = first + per * number
            rows.append((length, first, first + per * number, per, sequence, offset))
            offset += length * per
        sequence += number
    return rows


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 4096,
         with_ids: bool = False) -> DataFrame:
    """Pack documents into sequences of at most ``seq_len`` tokens; one row per piece with its place.

    A document's ids end with id 2; longer documents are cut every ``seq_len`` ids and the remainder is packed with
    the other lengths. A null or empty text is the end id alone. Repeated rows are packed as pieces of their own; a
    null id stays null. Only the two named columns are read. ``with_ids`` adds the piece's ids.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _PIECES + ", ids array<int>" * with_ids
    pieces = cut_lineage(docs.mapInArrow(_cut(tokenizer_path, seq_len, with_ids), schema))

    # rank among equal lengths: counted per (length, chunk), so no length is ever sorted in one task
    chunks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.rdd.getNumPartitions())
    chunked = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", F.col("ids_crc32")), F.lit(chunks)))
    counts = cut_lineage(chunked.groupBy("length", "chunk").agg(F.count("*").alias("n")))
    before = counts.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))) \
        .select("length", "chunk", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = chunked.withColumn("nth", F.row_number().over(
        Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32")) - 1) \
        .join(before, ["length", "chunk"]).withColumn("rank", F.col("nth") + F.col("before"))

    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = docs.sparkSession.createDataFrame(
        slot_rows(pack_histogram(histogram, seq_len)),
        "length long, first_rank long, end_rank long, per long, first_sequence long, first_offset long")
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= first_rank AND rank < end_rank") \
        .withColumn("in_slot", F.col("rank") - F.col("first_rank"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                         (F.col("first_sequence") + F.floor(F.col("in_slot") / F.col("per"))).cast("long").alias("sequence_id"),
                         (F.col("first_offset") + (F.col("in_slot") % F.col("per")) * F.col("length")).cast("long").alias("offset"),
                         *(["ids"] * with_ids))
