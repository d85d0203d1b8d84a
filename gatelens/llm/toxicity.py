"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

A word enters as the sum of what two tables say: a vector of the word itself (lower-cased, without marks around it) and
the mean vector of its byte trigrams (marks and unknown words included). Both directions of the network read a
window, attention weighs its words, and a text's score comes from its highest window. The label is the text's, so
training takes the window that scores highest at the time as the one that the label speaks of.

Everything is numpy. The network is fitted by one task (one thread, so its numbers repeat) on a bounded sample of labelled
windows; scoring runs in tasks over all windows of all texts.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.llm.common import slices

WINDOW, STRIDE = 32, 16               # words of a window, words between windows
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 12, 12, 12, 8
TRIGRAMS = 4096                       # rows of the trigram table (trigrams are hashed)
# bounds of the training sample
SAMPLE_DOCS = 1500                    # labelled texts of each label
SAMPLE_WINDOWS = 64                   # windows of one text (chosen by hash among all)
VOCABULARY = 20_000                   # words with a vector of their own, the most frequent of the sample
STEPS, ROUND, BATCH, RATE = 400, 40, 128, 0.01
TABLE_RATE, DROPPED = 0.1, 0.1        # slower steps for the tables of words and trigrams; share of words left out
BATCH_WINDOWS = 2048                  # windows scored at a time
KEPT_WORDS = 200_000                  # words whose inputs a worker remembers

_EDGE = b"".join(bytes([c]) for c in range(33, 127) if not bytes([c]).isalnum())


def window_starts(n_words: int) -> range:
    """Starts of the windows that cover n words: every STRIDE words until one reaches the end; none without words."""
    return range(0, max(1, n_words - WINDOW + STRIDE), STRIDE) if n_words else range(0)


def _stem(word: bytes) -> bytes:
    return word.strip(_EDGE).lower()


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of ^word$ (A-Z as a-z), word after word, and how many each word has (as many as bytes)."""
    data = np.frombuffer(b"".join([b"^%b$" % w.lower() for w in words]), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(2 * np.arange(len(words)), sizes) + np.arange(int(sizes.sum()))
    return ((data[at] << 16 | data[at + 1] << 8 | data[at + 2]) * 2654435761 >> 16) % TRIGRAMS, sizes


def _add_rows(out: np.ndarray, index: np.ndarray, values: np.ndarray) -> None:
    """out[index] += values, rows of one index summed first."""
    if len(index):
        order = np.argsort(index, kind="stable")
        ordered = index[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        out[ordered[first]] += np.add.reduceat(values[order], first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights; arrays with a leading axis of 2 hold the forward and the backward direction."""

    vocabulary: dict[bytes, int]      # row of the word table; row 0 is any other word
    word: np.ndarray
    char: np.ndarray
    enter: np.ndarray                 # (2, WORD_DIM + CHAR_DIM, 3 HIDDEN): update, reset and candidate gates
    enter_bias: np.ndarray
    recur: np.ndarray                 # (2, HIDDEN, 3 HIDDEN)
    recur_bias: np.ndarray            # (2, 1, HIDDEN), of the candidate
    attend: np.ndarray                # (2 HIDDEN, ATTEND)
    attend_bias: np.ndarray
    weigh: np.ndarray                 # (ATTEND,)
    out: np.ndarray                   # (2 HIDDEN,)
    out_bias: np.ndarray
    scale: float = 1.0                # from the highest window's logit to the text's
    shift: float = 0.0

    TABLES = ("word", "char", "enter", "enter_bias", "recur", "recur_bias", "attend", "attend_bias", "weigh", "out", "out_bias")

    @staticmethod
    def fresh(vocabulary: dict[bytes, int], rng: np.random.Generator) -> Network:
        def r(*shape: int, by: float) -> np.ndarray:
            return rng.normal(0, by, shape).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        return Network(vocabulary, r(len(vocabulary) + 1, WORD_DIM, by=0.1), r(TRIGRAMS, CHAR_DIM, by=0.1),
                       r(2, d, 3 * h, by=d ** -0.5), np.zeros((2, 1, 3 * h), np.float32), r(2, h, 3 * h, by=h ** -0.5),
                       np.zeros((2, 1, h), np.float32), r(2 * h, ATTEND, by=(2 * h) ** -0.5), np.zeros(ATTEND, np.float32),
                       r(ATTEND, by=0.5), r(2 * h, by=0.5), np.zeros(1, np.float32))

    def vectors(self, rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Input vectors of words from their table row and trigrams."""
        chars = np.add.reduceat(self.char[grams], np.cumsum(sizes) - sizes) / sizes[:, None]
        return np.concatenate((self.word[rows], chars.astype(np.float32)), axis=1)

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.enter + self.enter_bias

    def forward(self, gates: np.ndarray, index: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: ``index`` (windows, WINDOW) names rows of ``gates`` (2, words, 3 HIDDEN)."""
        n, h = len(index), HIDDEN
        width = int(lengths.max(initial=0))
        state = np.zeros((2, n, h), np.float32)
        states = np.zeros((2, n, width, h), np.float32)
        x = np.empty((2, n, 3 * h), np.float32)
        for t in range(width):
            back = width - 1 - t
            x[0], x[1] = gates[0][index[:, t]], gates[1][index[:, back]]
            live = np.stack((lengths > t, lengths > back))[:, :, None]
            u = state @ self.recur
            zr = _sigmoid(x[:, :, :2 * h] + u[:, :, :2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            inner = u[:, :, 2 * h:] + self.recur_bias
            c = np.tanh(x[:, :, 2 * h:] + r * inner)
            after = np.where(live, c + z * (state - c), state)
            if keep is not None:
                keep.append((state, z, r, inner, c, live))
            state = after
            states[0, :, t], states[1, :, back] = state[0], state[1]
        both = np.concatenate((states[0], states[1]), axis=2)
        look = np.tanh(both @ self.attend + self.attend_bias)
        weight = look @ self.weigh
        weight[np.arange(width) >= lengths[:, None]] = -np.inf
        weight = np.exp(weight - np.maximum(weight.max(axis=1, initial=-1e30), -1e30)[:, None])
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-30)
        pooled = np.einsum("nt,ntk->nk", weight, both)
        if keep is not None:
            keep.append((both, look, weight, pooled))
        return pooled @ self.out + self.out_bias

    def gradients(self, vectors: np.ndarray, index: np.ndarray, lengths: np.ndarray, target: np.ndarray,
                  weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted logistic loss, and with respect to the input vectors."""
        h, keep = HIDDEN, []
        gates = self.gates(vectors)
        logit = self.forward(gates, index, lengths, keep)
        both, look, alpha, pooled = keep.pop()
        width = len(keep)
        d_logit = ((_sigmoid(logit) - target) * weight).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.out
        d_alpha = np.einsum("nk,ntk->nt", d_pooled, both)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
        g["weigh"] = np.einsum("nt,nta->a", d_score, look)
        d_look = d_score[:, :, None] * self.weigh * (1 - look ** 2)
        g["attend"], g["attend_bias"] = np.einsum("ntk,nta->ka", both, d_look), d_look.sum(axis=(0, 1))
        d_both = alpha[:, :, None] * d_pooled[:, None] + d_look @ self.attend.T
        d_states = (d_both[:, :, :h], d_both[:, :, h:])
        d_gates = np.zeros_like(gates)
        d_steps = np.zeros((2, width, len(index), 3 * h), np.float32)
        g["recur"], g["recur_bias"] = np.zeros_like(self.recur), np.zeros_like(self.recur_bias)
        d_state = np.zeros((2, len(index), h), np.float32)
        for t in range(width - 1, -1, -1):
            back = width - 1 - t
            before, z, r, inner, c, live = keep[t]
            d_state = d_state + np.stack((d_states[0][:, t], d_states[1][:, back]))
            d = np.where(live, d_state, 0)
            d_c = d * (1 - z) * (1 - c ** 2)
            d_z = d * (before - c) * z * (1 - z)
            d_r = d_c * inner * r * (1 - r)
            d_inner = d_c * r
            d_u = np.concatenate((d_z, d_r, d_inner), axis=2)
            g["recur"] += before.transpose(0, 2, 1) @ d_u
            g["recur_bias"] += d_inner.sum(axis=1, keepdims=True)
            d_x = np.concatenate((d_z, d_r, d_c), axis=2)
            d_steps[0, t], d_steps[1, back] = d_x[0], d_x[1]
            d_state = np.where(live, d * z + d_u @ self.recur.transpose(0, 2, 1), d_state)
        for side in (0, 1):
            _add_rows(d_gates[side], index[:, :width].T.ravel(), d_steps[side].reshape(-1, 3 * h))
        g["enter"], g["enter_bias"] = vectors.T @ d_gates, d_gates.sum(axis=1, keepdims=True)
        return g, (d_gates @ self.enter.transpose(0, 2, 1)).sum(axis=0)


class _Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.mean = {k: np.zeros_like(getattr(net, k)) for k in net.TABLES}
        self.square = {k: np.zeros_like(getattr(net, k)) for k in net.TABLES}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = float(np.sqrt(sum(float((g.astype(float) ** 2).sum()) for g in gradients.values())))
        for k, g in gradients.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g ** 2 - self.square[k])
            fair = self.mean[k] / (1 - 0.9 ** self.step)
            rate = self.rate * (TABLE_RATE if k in ("word", "char") else 1)
            setattr(self.net, k, getattr(self.net, k) - rate * fair / (np.sqrt(self.square[k] / (1 - 0.99 ** self.step)) + 1e-6))


def fit(texts: list[list[list[bytes]]], labels: list[int], class_share: tuple[float, float] = (0.5, 0.5), seed: int = 7) -> Network:
    """Fit on texts, given as windows of words, with label 0 or 1; ``class_share`` is how common the labels really are.

    Vectors of words start from how surely texts of one label hold them more often. Every ROUND steps the windows are
    scored and each text's highest is trained on (and a random one of each text of label 0). Words are left out at random.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    texts = [t or [[]] for t in texts]
    raw = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for window in t for w in window))}
    stems = [_stem(w) for w in raw]
    docs_of: dict[bytes, np.ndarray] = {}
    for t, label in zip(texts, labels):
        for s in {stems[raw[w]] for window in t for w in window}:
            docs_of.setdefault(s, np.zeros(2))[label] += 1
    common = sorted((s for s, n in docs_of.items() if s and n.sum() >= 2), key=lambda s: (-docs_of[s].sum(), s))[:VOCABULARY]
    net = Network.fresh({s: k + 1 for k, s in enumerate(common)}, rng)
    if not raw or len(set(labels)) < 2:
        rate = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        net.scale, net.shift = 0.0, float(np.log(rate / (1 - rate)))
        return net
    # signed root of the likelihood ratio against the labels' own rate, less what chance gives the best of so many words
    seen = np.array([docs_of[s] for s in common]).reshape(-1, 2)
    n, rate = seen.sum(axis=1), y.mean()
    ratio = 2 * (seen[:, 1] * np.log(np.maximum(seen[:, 1], 0.1) / (n * rate)) + seen[:, 0] * np.log(np.maximum(seen[:, 0], 0.1) / (n * (1 - rate))))
    root = np.sqrt(np.maximum(ratio, 0)) - np.sqrt(2 * np.log(len(common) + 1))
    net.word[:, 0] = 0
    net.word[1:, 0] = np.sign(seen[:, 1] - n * rate) * np.clip(root, 0, 4) / 2

    rows = np.array([net.vocabulary.get(s, 0) for s in stems])
    grams, sizes = _trigrams(list(raw))
    gram_at = np.cumsum(sizes) - sizes
    windows = [window for t in texts for window in t]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    lengths = np.array([len(w) for w in windows])
    index = np.zeros((len(windows), WINDOW), np.int64)
    for k, window in enumerate(windows):
        index[k, :len(window)] = [raw[w] for w in window]
    first = np.searchsorted(owner, np.arange(len(texts)))
    many = np.bincount(owner)

    def highest(value: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, owner))
        return order[first + many - 1]

    def logits() -> np.ndarray:
        gates = net.gates(net.vectors(rows, grams, sizes))
        return np.concatenate([net.forward(gates, index[a:a + BATCH_WINDOWS], lengths[a:a + BATCH_WINDOWS])
                               for a in range(0, len(index), BATCH_WINDOWS)])

    share = np.array([(y == 0).mean(), (y == 1).mean()])
    adam = _Adam(net, RATE)
    strength = np.where(np.arange(WINDOW) < lengths[:, None], net.word[rows[index], 0], -9).max(axis=1)
    top = highest(strength)
    for step in range(STEPS):
        if step and step % ROUND == 0:
            top = highest(logits())
        half = BATCH // 2
        ones, zeros = rng.choice(np.flatnonzero(y == 1), half), rng.choice(np.flatnonzero(y == 0), half)
        other = first[zeros[:half // 2]] + rng.integers(0, many[zeros[:half // 2]])
        pick = np.concatenate((top[ones], top[zeros], other))
        target = (np.arange(len(pick)) < half).astype(np.float32)
        used, where = np.unique(index[pick], return_inverse=True)
        take = np.repeat(gram_at[used] - (np.cumsum(sizes[used]) - sizes[used]), sizes[used]) + np.arange(int(sizes[used].sum()))
        shown = (rng.random((len(used), 1)) >= DROPPED).astype(np.float32)
        vectors = net.vectors(rows[used], grams[take], sizes[used]) * shown
        g, d = net.gradients(vectors, where.reshape(len(pick), WINDOW), lengths[pick], target,
                             np.full(len(pick), 1 / len(pick), np.float32))
        d = d * shown
        g["word"], g["char"] = np.zeros_like(net.word), np.zeros_like(net.char)
        _add_rows(g["word"], rows[used], d[:, :WORD_DIM])
        _add_rows(g["char"], grams[take], np.repeat(d[:, WORD_DIM:] / sizes[used][:, None], sizes[used], axis=0))
        adam.rate = RATE * (1 - step / STEPS) + 1e-4
        adam.update(g)

    # a text's logit is scale * highest + shift, by Newton steps with a weak pull to scale 1
    best = np.maximum.reduceat(logits(), first).astype(float)
    weight = np.where(y == 1, class_share[1] / share[1], class_share[0] / share[0])
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * best + b, -30, 30)))
        slope = weight * p * (1 - p)
        grad = np.array([(weight * (y - p) * best).sum() - (a - 1), (weight * (y - p)).sum()])
        curve = np.array([[(slope * best * best).sum() + 1, (slope * best).sum()], [(slope * best).sum(), slope.sum() + 1e-3]])
        da, db = np.linalg.solve(curve, grad)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -2, 2))
    net.scale, net.shift = max(a, 0.05), b
    return net


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                  sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Network:
    """Fit on at most ``sample_docs`` labelled ids of each label and ``sample_windows`` windows of each text, both chosen by
    hashes. An id with several labels takes the highest, with several texts one by hash; ids or labels that are null are
    left out. Without labels of both kinds the network gives one constant score."""
    given = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")) \
        .agg(F.max(F.col(label_col).cast("int")).alias("y")).where("id IS NOT NULL")
    counts = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picks = [given.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_docs) for y in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(picks[0].unionByName(picks[1]), "id")
    one = Window.partitionBy("id").orderBy(F.xxhash64("text"), "text")
    rows = rows.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                words = text.encode().split()
                starts = sorted(sorted(window_starts(len(words)), key=lambda s: (zlib.crc32(b"%d %d" % (i, s)), s))[:sample_windows])
                out.append([b" ".join(words[s:s + WINDOW]) for s in starts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.binary()))], names=["id", "y", "windows"])
    total = max(1, sum(counts.values()))
    share = (counts.get(0, 0) / total, counts.get(1, 0) / total)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        net = fit([[w.split() for w in windows] for _, _, windows in sample], [y for _, y, _ in sample], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])
    sample = rows.mapInArrow(run, "id long, y int, windows array<binary>").repartition(1).sortWithinPartitions("id")
    got = sample.mapInArrow(train, "net binary").collect()
    return pickle.loads(bytes(got[0]["net"])) if got else fit([], [], share)


class _Inputs:
    """Gate inputs of words, remembered up to a bound."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.table = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.at))
        if len(self.at) + len(new) > KEPT_WORDS:
            self.clear()
            new = list(set(words))
        if new:
            n = len(self.at)
            self.at.update(zip(new, range(n, n + len(new))))
            while len(self.at) > self.table.shape[1]:
                self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
            grams, sizes = _trigrams(new)
            ids = np.array([self.net.vocabulary.get(_stem(w), 0) for w in new])
            self.table[:, n:n + len(new)] = self.net.gates(self.net.vectors(ids, grams, sizes))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


def _score(net: Network):
    def text_logits(inputs: _Inputs, texts: list[list[bytes]]) -> list[tuple[float, int, int]]:
        """(highest logit, its window's first word, number of windows) of each text."""
        rows = inputs.rows([w for t in texts for w in t])
        sizes = np.array([len(t) for t in texts])
        base = np.cumsum(sizes) - sizes
        starts = [window_starts(n) for n in sizes.tolist()]
        many = np.array([len(s) for s in starts])
        start = np.concatenate([np.arange(s.start, s.stop, s.step) for s in starts]) if many.sum() else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), many)
        length = np.minimum(WINDOW, sizes[owner] - start)
        padded = np.concatenate((rows, np.zeros(WINDOW, np.int64)))
        logit = np.empty(len(start))
        order = np.argsort(-length, kind="stable")         # windows of one length together: short ones cost less
        for a in range(0, len(order), BATCH_WINDOWS):
            pick = order[a:a + BATCH_WINDOWS]
            index = padded[(base[owner[pick]] + start[pick])[:, None] + np.arange(WINDOW)]
            logit[pick] = net.forward(inputs.table, index, length[pick])
        out, at = [], 0
        for n in many.tolist():
            best = at + int(np.argmax(logit[at:at + n])) if n else -1
            out.append((float(logit[best]), int(start[best]), n) if n else (float(net.out_bias[0]), 0, 0))
            at += n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = _Inputs(net)
        for b in slices(batches):
            found = text_logits(inputs, [t.encode().split() if t else [] for t in b.column(1).to_pylist()])
            logit, start, windows = (np.array(x) for x in zip(*found))
            score = 1 / (1 + np.exp(-np.clip(net.scale * logit + net.shift, -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                                              pa.array(start.astype(np.int64)), pa.array(windows.astype(np.int64))],
                                             names=["doc_id", "score", "predicted", "window_start", "n_windows"])
    return run


def toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score per row: (doc_id, score, predicted, window_start, n_windows); window_start is the first word of the window
    that scores highest (ties: the earliest).

    A null or empty text has no windows and gets the score of the network's bias. Very long texts are scored whole, all
    their windows, some thousand at a time. Equal rows get equal scores; a null id stays null. Only the two named columns
    are read, so other columns cannot clash.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_score(net), "doc_id long, score double, predicted int, window_start long, n_windows long")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether a row is kept from training: checksum of the decimal id, modulo ``folds``, is 0 (false without an id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))
