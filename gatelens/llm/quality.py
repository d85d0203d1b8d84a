"""Quality rules: a linear-chain conditional random field labels the lines of a text content or boilerplate.

The field is fitted on a bounded sample of labelled documents (every line takes its document's label, so the chain
weights learn how labels stick together); Viterbi decoding labels the lines of every document, and the share of words
in content lines decides whether it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import hashed_words, shingles, slices

# bounds of the training sample
SAMPLE_DOCS = 3000
SAMPLE_LINES = 60          # lines of one document that are used for fitting (all lines are used for decoding)

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20   # fixed values of the base rules
MIN_CONTENT_SHARE = 0.5

_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = b"!?;:\"'()[]{}/\\~^_=+@"
_CLOSERS = (b".", b"!", b"?", b":", b'"', b")")
FEATURES = 14


def line_features(lines: list[bytes]) -> np.ndarray:
    """Features of the lines of one text: each is a yes/no test, so weights need no scaling."""
    out = np.zeros((len(lines), FEATURES), np.float32)
    seen: set[bytes] = set()
    for row, line in zip(out, lines):
        body = line.strip(_SPACE)
        row[0] = 1
        if not body:
            row[1] = 1
            continue
        size = len(body)
        n = len(body.split())
        symbols = size - len(body.translate(None, _SYMBOLS))
        upper = size - len(body.translate(None, _UPPER))
        digits = size - len(body.translate(None, _DIGITS))
        marks = size - len(body.translate(None, _MARKS))
        row[2] = n <= 2
        row[3] = n >= 8
        row[4] = symbols * 50 >= size
        row[5] = symbols * 10 >= size
        row[6] = b"|" in body
        row[7] = upper * 5 >= size
        row[8] = upper * 2 >= size
        row[9] = digits * 5 >= size
        row[10] = marks * 12 >= size
        row[11] = body.endswith(_CLOSERS)
        row[12] = body in seen
        row[13] = size > 12 * n
        seen.add(body)
    return out


@dataclass
class LineField:
    """Weights of the field; label 0 is boilerplate, 1 content. The default calls every line content."""

    emit: np.ndarray = field(default_factory=lambda: np.array([[0.0, 1.0]] + [[0.0, 0.0]] * (FEATURES - 1)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the most likely label sequence (ties go to content)."""
        scores = (features @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        boil, good = scores[0]
        back = []
        for e0, e1 in scores[1:]:
            b0, b1 = boil + m00 <= good + m10, boil + m01 <= good + m11     # come from content?
            boil, good = (good + m10 if b0 else boil + m00) + e0, (good + m11 if b1 else boil + m01) + e1
            back.append((b0, b1))
        label = good >= boil
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return np.array(labels[::-1], bool)


def fit(sequences: list[np.ndarray], labels: list[int], steps: int = 120, rate: float = 0.5, l2: float = 1e-3) -> LineField:
    """Maximum likelihood by gradient steps; forward-backward runs over all sequences at once, line by line."""
    if len(set(labels)) < 2:
        return LineField()
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    length = np.array([len(sequences[i]) for i in order])
    d, t = len(order), int(length[0])
    x, y = np.zeros((t, d, FEATURES)), np.array([labels[i] for i in order])
    for col, i in enumerate(order):
        x[:len(sequences[i]), col] = sequences[i]
    live = [int((length > k).sum()) for k in range(t)]        # sequences are sorted: those still running come first
    mask = np.arange(t)[:, None] < length
    weight = np.where(y == 1, 0.5 / max(1, length[y == 1].sum()), 0.5 / max(1, length[y == 0].sum()))   # balanced classes
    model = LineField(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    grown_e, grown_m = np.full((FEATURES, 2), 1e-8), np.full((2, 2), 1e-8)
    truth = np.eye(2)[y]
    for _ in range(steps):
        e, m = x @ model.emit, model.move
        fwd, bwd = np.zeros((t, d, 2)), np.zeros((t, d, 2))
        fwd[0] = e[0]
        for k in range(1, t):
            n = live[k]
            fwd[k, :n] = e[k, :n] + np.logaddexp(fwd[k - 1, :n, :1] + m[0], fwd[k - 1, :n, 1:] + m[1])
        for k in range(t - 2, -1, -1):
            n = live[k + 1]
            ahead = e[k + 1, :n] + bwd[k + 1, :n]
            bwd[k, :n] = np.logaddexp(ahead[:, :1] + m[:, 0], ahead[:, 1:] + m[:, 1])
        z = np.logaddexp(*(fwd[0] + bwd[0]).T)
        p = np.exp(fwd + bwd - z[:, None]) * mask[:, :, None]
        gap = (truth * mask[:, :, None] - p) * weight[:, None]
        g_emit = np.einsum("tdf,tdl->fl", x, gap) - l2 * model.emit
        g_move = -l2 * m
        for k in range(1, t):
            n = live[k]
            pair = np.exp(fwd[k - 1, :n, :, None] + m + (e[k, :n] + bwd[k, :n])[:, None, :] - z[:n, None, None])
            g_move = g_move + ((truth[:n, :, None] * truth[:n, None, :] - pair) * weight[:n, None, None]).sum(axis=0)
        grown_e, grown_m = grown_e + g_emit ** 2, grown_m + g_move ** 2
        model = LineField(model.emit + rate * g_emit / np.sqrt(grown_e), m + rate * g_move / np.sqrt(grown_m))
    return model


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> LineField:
    """Fit on at most ``sample_docs`` labelled documents of each label, chosen by a hash of the id, and at most
    SAMPLE_LINES lines of each. Only line features reach the driver. Without labels of both kinds, the default field."""
    picks = [labels.where(F.col(label_col) == y).select(F.col(id_col).alias("id"), F.lit(y).alias("y"))
             .where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(picks[0].union(picks[1]), "id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = [line_features(t.encode().split(b"\n")[:SAMPLE_LINES]).astype(np.uint8) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in f], pa.binary())], names=["y", "f"])
    # rows of one id with several texts could exceed the bound: keep it
    got = rows.mapInArrow(run, "y int, f binary").limit(4 * sample_docs).toPandas()
    got = got.sort_values(["y", "f"])       # the sum of gradients must not depend on the order of arrival
    return fit([np.frombuffer(f, np.uint8).reshape(-1, FEATURES).astype(float) for f in got["f"]], got["y"].tolist())


def _verdicts(texts: pa.Array, model: LineField, min_share: float) -> dict[str, list]:
    hashes, first, end = hashed_words(texts, lower=False)
    windows = shingles(hashes, REPEAT_WINDOW) if len(hashes) >= REPEAT_WINDOW else hashes[:0]
    out: dict[str, list] = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                            "base_failed", "kept", "content_share")}
    for text, a, b in zip(texts.to_pylist(), first.tolist(), end.tolist()):
        text, n = text or "", b - a
        data = text.encode()
        lines = data.split(b"\n")
        seen: set[bytes] = set()
        dups = 0
        for line in lines:
            if line in seen:
                dups += bool(line.strip(_SPACE))
            seen.add(line)
        repeated = 0
        if n > REPEAT_WINDOW:
            w = windows[a:b - REPEAT_WINDOW + 1]
            order = np.argsort(w, kind="stable")
            same = w[order][1:] == w[order][:-1]
            if same.any():
                again = np.zeros(len(w), bool)
                again[order[1:][same]] = again[order[:-1][same]] = True
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.flatnonzero(again), 1)
                np.add.at(edge, np.flatnonzero(again) + REPEAT_WINDOW, -1)
                repeated = int((np.cumsum(edge[:-1]) > 0).sum())
        failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
        counts = np.array([len(line.split()) for line in lines])
        good = model.decode(line_features(lines))
        share = float(counts[good].sum() / n) if n else 0.0
        row = (n, len(text) - (len(data) - len(data.translate(None, _SPACE))),
               len(data) - len(data.translate(None, _SYMBOLS)), dups, repeated, failed,
               not failed and share >= min_share, share)
        for column, value in zip(out.values(), row):
            column.append(value)
    return out


def quality(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text",
            min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """Counts and verdict per row: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, content_share).

    A null or empty text has no words and fails the base rules. Repeated rows get equal rows; a null id stays null.
    Only the two named columns are read, so other columns cannot clash.
    """
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, content_share double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            v = _verdicts(b.column(1), model, min_share)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(x, k) for x, k in zip(v.values(), kinds)],
                                             names=["doc_id", *v])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: LineField, text_col: str = "text", min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, columns unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(_verdicts(b.column(at).cast(pa.string()), model, min_share)["kept"], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
