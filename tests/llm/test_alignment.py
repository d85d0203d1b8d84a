"""Alignment against a plain restatement with the tokenizers themselves, and rows of odd kinds."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gatelens.llm import alignment
from gatelens.llm.queries import op12_tokenizer_alignment, tokenizer_path
from gatelens.sources.tables import table

from paths import SF_SMALL

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    m = SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    with open(A, encoding="utf-8") as f:
        entry = {i: bytes(byte_of[c] for c in e) for e, i in json.load(f)["model"]["vocab"].items() if i != 50256}

    def piece(i):
        p = m.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
        return [(i, entry[i]) for i in a], [(i, piece(i)) for i in b]
    return tokens


def restated(plain, texts):
    docs = []
    for text in texts:
        a, b = plain(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            docs.append((0, 0, []))
            continue
        ends = [np.cumsum([len(x) for _, x in side]) for side in (a, b)]
        cuts = [0, *sorted(set(ends[0]) & set(ends[1]))]
        docs.append((len(a), len(b), [tuple([i for (i, _), e in zip(side, end) if low < e <= high] for side, end in zip((a, b), ends))
                                      for low, high in zip(cuts, cuts[1:])]))
    count = Counter(p for _, _, groups in docs for p in {(x, y) for ga, gb in groups for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for n_a, n_b, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join("|".join(",".join(map(str, g)) for g in pair) for pair in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), text))
    return out, {(x, y, n, n == best[x]) for (x, y), n in count.items()}


ODD = [None, "", " ", "a", "  two  spaces ", "\n\n\t x", "<|endoftext|> hi </s><unk>", "▁under", "日本語テキスト😀😀 日本", "x\x00y", "é" * 300,
       "\x1c a　 b", "Hello world", "Hello world", "naïve café — “q”", "a" * 2000, "ab" * 700 + " " * 90 + "!?" * 500, "́ ﬁ ①"]


@pytest.mark.parametrize("chunk_bytes, join_rows", [(1 << 22, 2_000_000), (300, 50)])
def test_equals_the_tokenizers(spark, plain, monkeypatch, chunk_bytes, join_rows):
    texts = ODD + [r.text for r in table(spark, SF_SMALL, "documents").where("length(text) < 3000").orderBy("doc_id").limit(40).collect()]
    aligner = alignment._Aligner(A, B, False)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(alignment, "JOIN_ROWS", join_rows)
    want, _ = restated(plain, texts)
    batch = aligner.chunk(5, list(range(len(texts))), texts)
    got = {t["doc_id"]: t for t in batch["texts"][0].as_py()}
    assert [(got[k]["n_a"], got[k]["n_b"], got[k]["n_groups"], got[k]["n_links"], got[k]["groups"]) for k in range(len(texts))] \
        == [(*w[:4], w[6]) for w in want]


def test_counts_over_the_corpus(spark, plain):
    texts = ODD + [r.text for r in table(spark, SF_SMALL, "documents").where("length(text) < 3000").orderBy("doc_id").limit(60).collect()]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(4)
    rows, counts = alignment.align(docs, A, B)
    want, want_counts = restated(plain, texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in rows.collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert {tuple(r) for r in counts.collect()} == want_counts


def test_units_give_the_ids_of_whole_texts():
    rng = random.Random(6)
    pieces = ["a", "b", "the", " ", "  ", " ", "\n", "\t", "　", "\x1c", "é", "'s", "'t", "1", "23", "!", "...", "日", "😀", "​", "\xa0", "<"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    ids = [e.ids for e in whole.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    a, b = alignment.tokenizer(A), alignment.tokenizer(B)
    assert a.units and b.units
    assert [np.frombuffer(x, np.int32).tolist() for x in a.encode(texts)] == ids
    for t in (a, b):
        assert [b"".join(t.encode(alignment._BORDER.split(x))) for x in texts] == t.encode(texts)


def test_units_are_encoded_many_in_a_call(plain, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé日1'.,\n") for _ in range(rng.randint(1, 9))).strip() or "x" for _ in range(5000)]
    texts = [" ".join(words[k:k + 500]) for k in range(0, 5000, 500)] + ["a  b", " lead and trail ", "new \n lines", "▁ under ▁score", "tab\t end"]
    given = []
    for side in (alignment.ByteLevel, alignment.Pieces):
        def counted(self, some, encode=side.encode):
            given.append(len(some))
            return encode(self, some)
        monkeypatch.setattr(side, "encode", counted)
    rows = [t for t in alignment._Aligner(A, B, False).chunk(0, list(range(len(texts))), texts)["texts"][0].as_py()]
    assert sum(given) < 1000 < len(set(words))
    want, _ = restated(plain, texts)
    assert {t["doc_id"]: (t["n_a"], t["n_b"], t["n_groups"], t["n_links"], t["groups"]) for t in rows} \
        == {k: (*w[:4], w[6]) for k, w in enumerate(want)}


def test_odd_tables(spark, plain):
    docs = spark.createDataFrame([(None, "x y"), (1, "x y"), (1, "x y"), (2, None)], "doc_id long, text string")
    rows = sorted(map(tuple, alignment.align(docs, A, B, digest=True)[0].collect()), key=str)
    (want,), _ = restated(plain, ["x y"])
    digest = hashlib.sha256(want[6].encode()).hexdigest()
    full = (*want[:4], want[3], 3 * want[3], digest)
    assert rows == sorted([(None, *full), (1, *full), (1, *full), (2, 0, 0, 0, 0, 0, 0, "")], key=str)
    rows, counts = alignment.align(docs.where("doc_id > 5"), A, B)
    assert rows.collect() == [] and counts.collect() == []


def test_query_returns_every_document(spark):
    rows = op12_tokenizer_alignment(spark, SF_SMALL)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows.count() == table(spark, SF_SMALL, "documents").count()


@pytest.mark.parametrize("tokens, join_rows", [(1, 1), (40, 300)])
def test_blocks_give_what_the_whole_chunk_gives(spark, plain, monkeypatch, tokens, join_rows):
    texts = ODD + ["x \n y z", "one two one\ttwo one"] * 3 + [r.text for r in table(spark, SF_SMALL, "documents").where("length(text) < 2000").orderBy("doc_id").limit(30).collect()]
    monkeypatch.setattr(alignment, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(alignment, "JOIN_ROWS", join_rows)
    batch = alignment._Aligner(A, B, False).chunk(0, list(range(len(texts))), texts)
    want, want_counts = restated(plain, texts)
    a, b, n = (batch[c][0].as_py() for c in "abn")
    assert {(x, y, k) for x, y, k in zip(a, b, n)} == {x[:3] for x in want_counts} and len(a) == len(want_counts)
    count, best = {x[:2]: x[2] for x in want_counts}, {x[:2] for x in want_counts if x[3]}
    for t in batch["texts"][0].as_py():
        pairs = [((a[p], b[p]), k) for p, k in zip(t["pair"], t["times"])]
        got = (t["n_a"], t["n_b"], t["n_groups"], t["n_links"], sum(k for p, k in pairs if p in best), sum(k * count[p] for p, k in pairs), t["groups"])
        assert got == want[t["doc_id"]]


def test_a_chunk_takes_little_memory():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij1.é") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(700)]       # a chunk of 2 MB
    aligner, given = alignment._Aligner(A, B, True), pa.default_memory_pool()
    pa.set_memory_pool(pool := pa.proxy_memory_pool(given))
    try:
        aligner.chunk(0, list(range(len(texts))), texts)
    finally:
        pa.set_memory_pool(given)
    assert pool.max_memory() < 20 << 20


def test_texts_of_a_chunk_are_one_value_for_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "ensure_checkpoint_dir", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(50)], "doc_id long, text string").coalesce(1)
    rows, _ = alignment.align(docs, A, B)
    assert dict(spark.read.parquet(str(next(tmp_path.glob("alignment-*")))).dtypes)["texts"] == "binary"
    assert rows.count() == 50
