"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often they do corpus-wide.

Inside a task, chunks of texts are Arrow tables. A text is a list of units: the stretches between single spaces that
stand between other characters. No token of either kind of tokenizer crosses such a space (the byte-level splitter starts
a new stretch there, and no piece holds a space after another character), so both have a token end there and each
distinct unit of a chunk is aligned once, and many of them are encoded in one call, with the space between them; a
tokenizer for which that cannot be told gets whole texts as units. Token lists
are flattened with their parent indices, byte ends are cumulative sums per unit, a hash join on (unit, end) gives the
offsets where tokens of both end, one on the group between two such offsets gives the linked ids, and those of a unit are
gathered for the texts that hold it. Units are aligned some thousand tokens at a time and texts are brought together some
at a time, so a task never holds the joins of a whole chunk. Spark merges the counts of all chunks' pairs and brings every
chunk the merged counts of its own pairs.

Texts are tokenized once: chunks are written to a table in the shared folder, with each text's pairs as positions in
its chunk's list of pairs. That list is all that is joined by pair, so a pair found in every document costs one row a
chunk, and no table of all pairs is broadcast. The texts of a chunk are one compressed value for Spark: their lists of
pairs are never rows or arrays of the JVM, whose readers would hold those of a whole file at once.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.llm.common import slices
from gatelens.session import ensure_checkpoint_dir

CHUNK_BYTES = 2 << 20        # bytes of text in a chunk (a longer text is a chunk of its own)
JOIN_ROWS = 100_000          # rows that one join gives at most, but for a single left row or text
BLOCK_TOKENS = 16_384        # tokens of one side that are aligned at a time, but for a single unit
BLOCK_UNITS = 200            # units that are given to a tokenizer as one text

# fixed value: how byte-level tokenizers of this family cut a text before merging
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """Byte-level entries write a printable byte as itself and the others as the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Ids of a byte-level BPE file (tokenizers JSON) for space + text; special tokens' strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        special = {t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes[i] = entry.encode() if i in special else bytes(alphabet[c] for c in entry)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self._path, self._whole, self._ranked = path, None, None
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") \
                and split.get("use_regex", True) and all(vocab.get("".join(m)) == 256 + k for k, m in enumerate(merges)):
            import tiktoken     # ids in the order of merges are ranks: the same ids, several times faster
            self._ranked = tiktoken.Encoding("ranks", pat_str=_CUT, special_tokens={}, mergeable_ranks={
                b: i for i, b in enumerate(self.bytes) if i not in special})

        self.units = self._ranked is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(self._one(" " + t), np.int32).tobytes() for t in texts]

    def _one(self, text: str) -> list[int] | np.ndarray:
        if self._ranked is not None:
            try:
                return self._ranked.encode_to_numpy(text, disallowed_special=())
            except (ValueError, RuntimeError):      # white space runs beyond what its splitter can backtrack over
                pass
        if self._whole is None:
            from tokenizers import Tokenizer
            self._whole = Tokenizer.from_file(self._path)
            self._whole.encode_special_tokens = True
        return self._whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a piece model (sentencepiece file), which puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self._model = m = SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.units = not any(re.search("[^▁]▁", p) for p in names) and m.normalize("\ufb01 \u2460") in ("\ufb01 \u2460", "▁\ufb01▁\u2460")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, np.int32).tobytes() for x in self._model.encode(texts, num_threads=1)]


_loaded: dict[str, ByteLevel | Pieces] = {}      # one per Python worker, kept between its tasks


def tokenizer(path: str) -> ByteLevel | Pieces:
    if path not in _loaded:
        _loaded[path] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return _loaded[path]


_BORDER = re.compile(r"(?<=\S) (?=\S)")


def _bytes(t: ByteLevel | Pieces, encoded: bytes) -> bytes:
    return b"".join(map(t.bytes.__getitem__, np.frombuffer(encoded, np.int32).tolist()))


def _ends(lists: pa.ListArray, sizes: np.ndarray) -> pa.Table:
    """(unit, end, at, id) of every token: its unit, its byte end in the unit, its row."""
    lists = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), lists.flatten())
    parent = pc.list_parent_indices(lists)
    end = pc.cumulative_sum(pa.array(sizes[lists.values.to_numpy()], pa.int64()))
    base = np.concatenate(([0], end.to_numpy()))[lists.offsets.to_numpy()[:-1]]
    return pa.table({"unit": parent, "end": pc.subtract(end, pa.array(base).take(parent)),
                     "at": pa.array(np.arange(len(end))), "id": pc.list_flatten(lists)})


def _joined(left: pa.Table, right: pa.Table, key: str) -> Iterator[pa.Table]:
    """Inner join in blocks of left rows, so that no result is larger than JOIN_ROWS but for a single left row's."""
    many = np.bincount(right[key].to_numpy(), minlength=int(pc.max(left[key]).as_py() or 0) + 1)[left[key].to_numpy()]
    total = np.cumsum(many)
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + JOIN_ROWS, "right")))
        yield left.slice(a, b - a).join(right, keys=key, join_type="inner", use_threads=False)
        a = b


def _summed(blocks: Iterable[pa.Table], x: str, y: str, keys: list[str]) -> pa.Table:
    """The blocks' rows by ``keys``, with the sum of x * y as ``times``."""
    parts = [b.select(keys).append_column("times", pc.multiply(b[x], b[y])).group_by(keys, use_threads=False).aggregate([("times", "sum")])
             .rename_columns([*keys, "times"]) for b in blocks]
    if len(parts) == 1:
        return parts[0]
    return pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([("times", "sum")]).rename_columns([*keys, "times"])


def _by_text(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int32()))


def _in_groups(ids: pa.Array, group: np.ndarray, groups: int, names: pa.Array) -> pa.Array:
    at = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=groups))))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), names.take(ids)), ",")


_TEXT = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups", pa.string()), ("pair", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
_CHUNK = "chunk long, texts binary, a array<int>, b array<int>, n array<int>"
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class _Aligner:
    def __init__(self, path_a: str, path_b: str, digest: bool):
        self.a, self.b, self.digest = tokenizer(path_a), tokenizer(path_b), digest
        self.sizes = [np.array([len(x) for x in t.bytes]) for t in (self.a, self.b)]
        self.names = [pa.array([str(i) for i in range(len(t.bytes))]) for t in (self.a, self.b)]

    def _split(self, texts: list[str]) -> tuple[list[str], list[bool], np.ndarray, np.ndarray]:
        """The distinct units of the texts, whether each may stand between spaces, the units of all texts as positions in
        them, and how many each text has."""
        units = self.a.units and self.b.units
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ") if units else pa.array([[t] for t in texts], pa.list_(pa.string()))
        found = lists.flatten().dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        plain = [units and u != "" and u == u.strip() for u in distinct]
        if units and not all(plain):        # spaces beside other white space: no border there
            odd = ~np.logical_and.reduceat(np.array(plain)[found.indices.to_numpy()], lists.offsets.to_numpy()[:-1])
            again = pa.array([_BORDER.split(texts[k]) for k in np.flatnonzero(odd).tolist()], pa.list_(pa.string()))
            lists = pa.concat_arrays([lists.filter(pa.array(~odd)), again]).take(pa.array(np.argsort(np.argsort(odd, kind="stable"))))
            found = lists.flatten().dictionary_encode()
            distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            plain = [u != "" and u == u.strip() for u in distinct]
        return distinct, plain, found.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy()

    def _ids(self, units: list[str], plain: list[bool]) -> tuple[list[pa.ListArray], np.ndarray]:
        """Each side's ids of each unit, and whether both give it back byte by byte. Plain units are encoded many at a time,
        with a space between them as in a text; a block that is not given back is encoded unit by unit, as are the others."""
        joint = [k for k, ok in enumerate(plain) if ok and "  " not in units[k] and "▁" not in units[k]]
        single = np.ones(len(units), bool)
        single[joint] = False
        single = np.flatnonzero(single).tolist()
        blocks = [joint[k:k + BLOCK_UNITS] for k in range(0, len(joint), BLOCK_UNITS)]
        texts = [" ".join([units[k] for k in block]) for block in blocks]
        width = pc.binary_length(pa.array(units, pa.string())).to_numpy() + 1
        ends = [np.cumsum(width[block]) for block in blocks]
        lists, good = [], np.ones(len(units), bool)
        for t, sizes in zip((self.a, self.b), self.sizes):
            ids, many, order, alone = [], [], [], list(single)
            for block, text, last, encoded in zip(blocks, texts, ends, t.encode(texts)):
                cut = np.cumsum(sizes[np.frombuffer(encoded, np.int32)])
                at = np.searchsorted(cut, last)
                if _bytes(t, encoded) == (" " + text).encode() and (cut[at] == last).all():
                    ids.append(encoded)
                    many.append(np.diff(at, prepend=-1))
                    order += block
                else:
                    alone += block
            encoded = t.encode([units[k] for k in alone])
            good[[k for k, x in zip(alone, encoded) if _bytes(t, x) != (" " + units[k]).encode()]] = False
            many.append(np.array([len(x) // 4 for x in encoded], np.int64))
            at = pa.array(np.cumsum(np.concatenate(([0], *many))), pa.int32())
            lists.append(pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(ids + encoded), np.int32)))
                         .take(pa.array(np.argsort(order + alone))))
        return lists, good

    def chunk(self, number: int, ids: list, texts: list[str | None]) -> pa.RecordBatch:
        given = [k for k, t in enumerate(texts) if t]
        rows = {name: np.zeros(0, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        groups = pa.array([], pa.string())
        found = {c: np.zeros(0, np.int64) for c in ("text", "pair", "times")}
        pairs = pa.table({c: pa.array([], pa.int32()) for c in ("a", "b")})
        if given:
            units, plain, unit, many = self._split([texts[k] for k in given])
            encoded, back = self._ids(units, plain)
            good = np.logical_and.reduceat(back[unit], np.cumsum(many) - many)
            given = [k for k, ok in zip(given, good.tolist()) if ok]
            if given:
                unit, many = unit[np.repeat(good, many)], many[good]
                used, unit = np.unique(unit, return_inverse=True)
                rows, groups, found, pairs = self._texts(unit, many, *(e.take(pa.array(used)) for e in encoded))
        n = len(given)
        held = np.bincount(found["pair"], minlength=len(pairs))
        lengths = np.bincount(found["text"], minlength=n)
        lists = {c: _by_text(found[c], lengths) for c in ("pair", "times")}

        # texts without tokens come last, with zeros
        rest = sorted(set(range(len(texts))) - set(given))
        m = len(rest)
        fields = [pa.array([ids[k] for k in given + rest], pa.int64())]
        fields += [pa.array(np.concatenate((rows[c], np.zeros(m, np.int64)))) for c in ("n_a", "n_b", "n_groups", "n_links")]
        fields.append(pa.concat_arrays([groups, pa.array([""] * m, pa.string())]))
        fields += [pa.concat_arrays([lists[c], _by_text(np.zeros(0), np.zeros(m, np.int64))]) for c in ("pair", "times")]
        table = pa.StructArray.from_arrays(fields, fields=list(_TEXT))
        columns = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table)]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x, pa.int32()))
                    for x in (pairs["a"].to_numpy(), pairs["b"].to_numpy(), held)]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "texts", "a", "b", "n"])

    def _texts(self, unit: np.ndarray, many: np.ndarray, a: pa.ListArray,
               b: pa.ListArray) -> tuple[dict[str, np.ndarray], pa.Array, dict[str, np.ndarray], pa.Table]:
        """Counts, groups and pairs of texts, given as ``many`` units each, from the ids of the distinct units."""
        per_unit, written, linked = self._units(a, b)
        at = np.concatenate(([0], np.cumsum(many)))
        rows = {name: np.add.reduceat(value[unit], at[:-1]) for name, value in per_unit.items()}
        pairs = linked.group_by(["a", "b"], use_threads=False).aggregate([])
        pairs = pairs.append_column("pair", pa.array(np.arange(len(pairs))))
        linked = linked.join(pairs, keys=["a", "b"], join_type="inner", use_threads=False).select(["unit", "pair", "times"]).sort_by("unit")
        links = np.bincount(linked["unit"].to_numpy(), minlength=len(a))
        first, pair, times = np.cumsum(links) - links, linked["pair"].to_numpy(), linked["times"].to_numpy()

        groups, found = [], []
        total = np.cumsum(np.add.reduceat(links[unit], at[:-1]))
        k = 0
        while k < len(many):
            last = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + JOIN_ROWS, "right")))
            here = unit[at[k]:at[last]]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at[k:last + 1] - at[k], pa.int32()), written.take(pa.array(here))), ";")
            groups.append(pa.array([hashlib.sha256(g.as_buffer()).hexdigest() for g in joined], pa.string()) if self.digest else joined)
            uses, count = np.unique(np.repeat(np.arange(k, last), many[k:last]) * len(a) + here, return_counts=True)
            text, here = np.divmod(uses, len(a))
            n = links[here]
            row = np.arange(n.sum()) + np.repeat(first[here] - (np.cumsum(n) - n), n)
            key = np.repeat(text, n) * len(pairs) + pair[row]
            order = np.argsort(key)
            key = key[order]
            edge = np.flatnonzero(np.diff(key, prepend=-1))
            found.append((key[edge], np.add.reduceat((times[row] * np.repeat(count, n))[order], edge)))
            k = last
        text, pair = np.divmod(np.concatenate([x for x, _ in found]), len(pairs))
        return rows, pa.concat_arrays(groups), {"text": text, "pair": pair, "times": np.concatenate([x for _, x in found])}, pairs

    def _units(self, a: pa.ListArray, b: pa.ListArray) -> tuple[dict[str, np.ndarray], pa.Array, pa.Table]:
        """``_align`` of all units, in blocks of at most BLOCK_TOKENS tokens of either side but for a single unit."""
        ends = [x.offsets.to_numpy()[1:] for x in (a, b)]
        rows, written, linked = [], [], []
        k = 0
        while k < len(a):
            last = max(k + 1, min(int(np.searchsorted(e, (e[k - 1] if k else 0) + BLOCK_TOKENS, "right")) for e in ends))
            r, w, links = self._align(*(_ends(x.slice(k, last - k), s) for x, s in zip((a, b), self.sizes)), last - k)
            rows.append(r)
            written.append(w)
            linked.append(links.set_column(0, "unit", pc.add(links["unit"], k)))
            k = last
        return {c: np.concatenate([r[c] for r in rows]) for c in rows[0]}, pa.concat_arrays(written), pa.concat_tables(linked)

    def _align(self, a: pa.Table, b: pa.Table, n: int) -> tuple[dict[str, np.ndarray], pa.Array, pa.Table]:
        """Of each of n units: counts, its groups as a string, its linked pairs with how often."""
        both = a.select(["unit", "end", "at"]).join(b.select(["unit", "end", "at"]), keys=["unit", "end"], join_type="inner",
                                                    right_suffix="_b", use_threads=False)
        group, unit = [], np.sort(both["unit"].to_numpy())
        for side, column in ((a, "at"), (b, "at_b")):
            cut = np.zeros(len(side), np.int64)
            cut[both[column].to_numpy()] = 1
            group.append(np.cumsum(cut) - cut)       # cuts come in the same order on both sides: one number for a group
        total = len(both)
        in_group = [np.bincount(g, minlength=total) for g in group]
        links = np.zeros(n, np.int64)
        np.add.at(links, unit, in_group[0] * in_group[1])
        rows = {"n_a": np.bincount(a["unit"].to_numpy(), minlength=n), "n_b": np.bincount(b["unit"].to_numpy(), minlength=n),
                "n_groups": np.bincount(unit, minlength=n), "n_links": links}

        written = pc.binary_join_element_wise(*(_in_groups(side["id"].combine_chunks(), g, total, names)
                                                for side, g, names in zip((a, b), group, self.names)), "|")
        at = np.concatenate(([0], np.cumsum(rows["n_groups"])))
        written = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), written), ";")

        # equal ids of a group once, with how often: a group's links are the products of both sides
        left, right = (pa.table({"unit": side["unit"], "group": pa.array(g), name: side["id"]})
                       .group_by(["unit", "group", name], use_threads=False).aggregate([([], "count_all")])
                       .rename_columns(["unit", "group", name, f"n_{name}"]) for side, g, name in ((a, group[0], "a"), (b, group[1], "b")))
        return rows, written, _summed(_joined(left, right.drop_columns(["unit"]), "group"), "n_a", "n_b", ["unit", "a", "b"])


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    ids, texts, size = [], [], 0
    for b in slices(batches):
        for i, text, width in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.binary_length(b.column(1)).to_pylist()):
            if texts and size + (width or 0) > CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text)
            size += (width or 0) + 16
    if texts:
        yield ids, texts


def _encode(path_a: str, path_b: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(path_a, path_b, digest)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        for k, (ids, texts) in enumerate(_chunks(batches)):
            yield _packed(aligner.chunk(base + k, ids, texts))
            pa.default_memory_pool().release_unused()       # else the worker keeps what its largest join took
    return run


def _packed(chunk: pa.RecordBatch) -> pa.RecordBatch:
    """The chunk with its texts as one value, a compressed Arrow stream."""
    texts = pa.RecordBatch.from_struct_array(chunk["texts"].values)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(texts)
    return chunk.set_column(1, "texts", pa.array([sink.getvalue().to_pybytes()], pa.binary()))


def _with_counts(chunk: pa.Table, known: pa.Table) -> pa.Table:
    """The rows of a chunk's texts, from the chunk and the merged counts (at, n_docs, is_best) of its pairs."""
    count, best = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
    at = known["at"].to_numpy()
    count[at], best[at] = known["n_docs"].to_numpy(), known["is_best"].to_numpy()
    texts = pa.ipc.open_stream(chunk["texts"][0].as_buffer()).read_all().combine_chunks()
    pair, times = (texts[c].combine_chunks() for c in ("pair", "times"))
    offsets, pair, times = pair.offsets.to_numpy(), pair.values.to_numpy(), times.values.to_numpy().astype(np.int64)

    def total(value):
        return pa.array(np.diff(np.concatenate(([0], np.cumsum(value)))[offsets]))

    return texts.drop_columns(["pair", "times", "groups"]).append_column("n_best", total(times * best[pair])) \
        .append_column("count_sum", total(times * count[pair])).append_column("groups", texts["groups"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Alignment of each row's text under two tokenizers, and the counts of linked id pairs.

    First table: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row per row of ``docs``; groups is
    ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its SHA-256. Second table: (a, b, n_docs, is_best), one row per linked pair
    of ids; n_docs counts rows of ``docs`` that hold it, is_best marks the pairs with their ``a``'s highest count.

    A text that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens: zeros and an empty
    string. Very long texts are handled whole, as a chunk of their own (memory grows with the longest text; links of a
    long group are joined in blocks). Repeated rows count as documents of their own; a null id stays null. Only the two
    named columns are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_encode(path_a, path_b, digest), _CHUNK).write.option("parquet.page.size.row.check.min", "1").parquet(folder)
    chunks = spark.read.schema(_CHUNK).parquet(folder)
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "pair")).select("chunk", "at", "pair.*")
    merged = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
    # at most one row per id of the second vocabulary meets in a window
    counts = merged.withColumn("is_best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))
    known = pairs.select(F.col("chunk").alias("of"), "at", "a", "b").join(counts, ["a", "b"]).select("of", "at", "n_docs", "is_best")
    rows = chunks.select("chunk", "texts").groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_with_counts, _ROWS)
    return rows, counts
