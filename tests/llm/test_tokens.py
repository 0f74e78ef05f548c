import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe, packing, token_counts
from lodestone.llm.tokenizer import default_path

LIBRARY = Tokenizer.from_file(default_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinstblmou") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return [*words, " ".join(words), "a" * 3000, " " * 500 + "x", "!!<|endoftext|>  a", "日本語 テキスト", "\x00\x01", "don't we'll 123 4567 ...", "é" * 300, "😀" * 50, "\n\n \t x", ""]


def test_backtracking_equals_library():
    codec = bpe.codec(default_path())
    for text in odd_texts():
        ids = codec.encode(text)
        assert ids.tolist() == ids_of(text)
        assert codec.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


def test_decode_of_broken_bytes_equals_library():
    codec = bpe.codec(default_path())
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, 50257, 20)
        assert codec.decode(ids.astype(np.uint32)) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_round_trip_cases(docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((d, len(ids_of(t)), hashlib.sha256(",".join(map(str, ids_of(t))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert Counter(tuple(r) for r in bpe.round_trip(docs).collect()) == want
    assert bpe.round_trip(no_docs).collect() == []
    decoded = bpe.decode(bpe.encode(docs)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in decoded) == Counter((d, t or "") for d, t in rows)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    codec = bpe.Codec(default_path())
    assert all(codec.encode(t).tolist() == ids_of(t) for t in odd_texts())


@pytest.mark.parametrize("table", [0, 10, 1 << 16])
def test_counts(docs, no_docs, monkeypatch, table):
    monkeypatch.setattr(token_counts, "TABLE", table)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((d, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 512) for d, t in rows)
    assert Counter(tuple(r) for r in token_counts.token_counts(docs).collect()) == want
    assert token_counts.token_counts(no_docs).collect() == []


def test_counts_with_other_files(spark):
    import public_tokenizers
    import sentencepiece

    df = spark.createDataFrame([(1, "Hello there, über world"), (2, None)], "doc_id bigint, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, model).collect()} == {1: len(processor.encode("Hello there, über world")), 2: 0}
    word = public_tokenizers.path("word_bpe_49k.json")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, word).collect()}[1] == len(Tokenizer.from_file(word).encode("Hello there, über world", add_special_tokens=False).ids)


def check_pieces(rows, texts):
    """Every id in exactly one piece, sequences gapless, at most 1024 long. texts: list of (doc_id, text)."""
    want = Counter()
    for d, t in texts:
        want[d, len(ids_of(t)) + 1] += len(ids_of(t)) + 1
    have = Counter()
    sequences = defaultdict(list)
    for r in rows:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    waste = 0
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces[:-1]]]).tolist()
        used = sum(n for _, n in pieces)
        assert used <= 1024
        waste += 0 if used & (used - 1) == 0 else 1024 - used
    return waste / max(1, sum(want.values()))


def test_packing(docs, no_docs):
    rows = packing.pack(docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check_pieces(rows, texts) < 0.05
    assert packing.pack(no_docs).collect() == []
    long = dict(texts)[12]
    ids = np.array([*ids_of(long), 0], "<u4")
    pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 12)
    assert sum(n for _, n, _ in pieces) == len(ids)
    assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for s, n, crc in pieces)


def test_packing_little_padding(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["the", "ring", "of", "nine", "sleeping"]) for _ in range(rng.randint(0, 1500)))) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    assert check_pieces(packing.pack(df).collect(), texts) < 0.02


@pytest.mark.parametrize("rest", [1, 2, 511, 512, 513, 700, 1000, 1023])
def test_cut_loses_nothing(rest):
    pieces = packing.cut(rest)
    assert sum(pieces) == rest and all((1024 // p) * p >= 0.97 * 1024 or p == 1024 // (1024 // p) for p in pieces)
