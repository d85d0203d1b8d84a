"""Word, hash and batch helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_ROWS = 256          # rows handled at a time inside a task; bounds Python memory whatever the Arrow batch size

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 (bytes methods are ASCII-only by definition)."""
    return text.encode().lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BYTES = np.arange(256)
_IS_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_BYTE_VALUE = mix(np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + _GOLDEN)   # A-Z as a-z
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts as 64-bit hashes (A-Z lower-cased if asked): hashes, and first and
    end index of each text's words. A null text has none. A word's hash is a polynomial over its bytes, read off one
    running sum over all bytes.
    """
    strings = texts.to_pylist()
    raw = [(t or "").encode() for t in strings]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    value = _BYTE_VALUE if lower else mix(_BYTES.astype(np.uint64) + _GOLDEN)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * _odd_powers(_BASE, len(data)), out=total[1:])
    hashes = mix((total[end] - total[start]) * _odd_powers(_BASE_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    at = np.searchsorted(start, bounds)
    return hashes, at[:-1], at[1:]


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles by position; with fewer than k words, the whole sequence is the one shingle."""
    k = min(k, len(word_hashes))
    n = len(word_hashes) - k + 1
    if k == 0:
        return word_hashes
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * _M1 + word_hashes[i:i + n]
    return mix(out + _GOLDEN)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct k-word shingle hashes of each text, sorted; empty without words."""
    hashes, first, end = hashed_words(texts)
    every = shingles(hashes, k) if len(hashes) >= k else hashes[:0]
    out = []
    for a, b in zip(first.tolist(), end.tolist()):
        s = np.sort(every[a:b - k + 1] if b - a >= k else shingles(hashes[a:b], k))
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    return out


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
