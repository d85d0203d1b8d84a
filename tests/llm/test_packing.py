import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from paths import SF_SMALL
from tokenizers import Tokenizer

from gatelens.llm import packing
from gatelens.llm.queries import tokenizer_path
from gatelens.sources.tables import table


whole = Tokenizer.from_file(tokenizer_path())


def ids(text):
    return whole.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, pieces, seq_len=4096):
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(ids(t))
    for i, several in want.items():
        own = sorted(((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces if p["doc_id"] == i))
        cut = sorted((at, len(x[at:at + seq_len]), zlib.crc32(np.array(x[at:at + seq_len], "<u4").tobytes()), len(x))
                     for x in several for at in range(0, len(x), seq_len))
        assert own == cut
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= seq_len
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence


def test_small_table(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    packs = check(rows, packing.pack(docs, tokenizer_path()).collect())
    total = sum(n for places in packs.values() for _, n in places)
    assert len(packs) <= total / 4096 * 1.05 + 2


def test_special_strings_count_in_their_own_case_only():
    words = packing.WordIds(tokenizer_path())
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "Foo", "foo", "|>", " ", "\n", "É", "'S", "!!", "12"]
    texts = ["<|ENDOFTEXT|>"] + ["".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids + [2]
    assert np.frombuffer(words.encode(texts[0]), "<u4").tolist() == [27, 347, 40786, 4160, 91, 285, 2]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "word " * 3000), (3, "word " * 3000), (4, "Don't it's, 'S. É́. \x1c a,b.c <|endoftext|>. 3.14 ﬁ"), (None, "x")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    pieces = packing.pack(docs, tokenizer_path(), seq_len=1024, with_ids=True).collect()
    check(rows, pieces, 1024)
    assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_cover_the_histogram(counts):
    patterns = packing.pack_histogram(dict(counts), 64)
    covered = {}
    for pattern, number in patterns:
        assert sum(length * per for length, per in pattern) <= 64
        for length, per in pattern:
            covered[length] = covered.get(length, 0) + per * number
    assert covered == counts
    ranks = {}
    for length, first, end, *_ in packing.slot_rows(patterns):
        assert first == ranks.get(length, 0)
        ranks[length] = end
    assert ranks == counts


def padding(counts, seq_len=4096):
    patterns = packing.pack_histogram(dict(counts), seq_len)
    assert packing_covers(patterns, counts)
    return 1 - sum(n * k for n, k in counts.items()) / seq_len / sum(number for _, number in patterns)


def packing_covers(patterns, counts):
    covered = {}
    for pattern, number in patterns:
        for length, per in pattern:
            covered[length] = covered.get(length, 0) + per * number
    return covered == counts


def test_a_third_of_the_rows_of_one_short_length():
    rng = np.random.default_rng(1)
    for hot in (1, 30, 200, 300, 1000):
        lengths = np.concatenate([np.clip(rng.lognormal(5.5, 1, 20_000).astype(int), 1, 4096), np.full(10_000, hot)])
        counts = {int(n): int(k) for n, k in zip(*np.unique(lengths, return_counts=True))}
        assert padding(counts) < 0.01, hot
    assert padding({200: 100_000}) < 0.025
    assert padding({30: 7}) == 1 - 210 / 4096


def test_copies_of_one_short_text(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(10**6 + n, "copies of one short text, all of them alike") for n in range(len(rows) // 2)]
    packs = check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect())
    total = sum(n for places in packs.values() for _, n in places)
    assert len(packs) <= total / 4096 * 1.05 + 2
