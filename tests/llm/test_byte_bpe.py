"""Byte-level BPE against the public library, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from helixlake.llm import byte_bpe

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    None, "", " ", "\n\n  x", "Hello world's  end", "<|endoftext|>", "naïve café — 你好, ไทย 😀\u200d👩", "a\u00a0b\u2028c\x1cd\x85e", "1234567890" * 30,
    "don't DON'T we'll", "\t\tif x:\r\n    y = z  \r\n", "e\u0301" * 40, "=" * 1_001, " " * 700, "ab" * 500, "Hello world's  end", "\U0010ffff\ufffe",
]


def of(flat, starts):
    return [flat[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


@pytest.fixture(scope="module")
def using():
    return byte_bpe.tokenizer()


@pytest.mark.parametrize("long_bytes", [1, 64, 10**9])
def test_encoding_equals_the_library(using, monkeypatch, long_bytes):
    """One pair a round and many pairs a round give the same tokens."""
    monkeypatch.setattr(byte_bpe, "LONG_BYTES", long_bytes)
    using._open()
    using._forget()
    rng = random.Random(7)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for letters in ("ACGT", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "éèaß", "=-_ ") for _ in range(60)]
    texts = TEXTS + words + [" ".join(words)]
    assert of(*using.encode(texts)) == [LIBRARY.encode_ordinary(t or "") for t in texts]


def test_long_words_take_several_queries(using, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ROWS_KEPT", 5_000)
    using._open()
    using._forget()
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(4_000)), "x" * 20_000, " " * 9_000 + "y"]
    assert of(*using.encode(texts)) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_texts_are_cut_anywhere_without_a_trace(using, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "B", "1", " ", "  ", "\n", "'s", ".", "é"]) for _ in range(400)) for _ in range(30)]
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(byte_bpe, "CHARS_AT_ONCE", size)
        assert of(*using.encode(texts)) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_other_vocabularies_with_odd_merges():
    """A made-up vocabulary whose tokens aren't in the order of their parts: equal to contraction pair by pair."""
    rng = random.Random(10)
    extra = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(2, 5))).encode() for _ in range(40)}, key=lambda _: rng.random())
    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(extra)}

    def plain(word: bytes) -> list[int]:
        if word in ranks:
            return [ranks[word]]
        parts = [bytes([b]) for b in word]
        while True:
            pairs = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    own = byte_bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    assert of(*own.encode(words)) == [plain(w.encode()) for w in words]
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.Tokenizer({b"a": 0}, "x")


def test_columns_nulls_and_round_trip(spark):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] + [(None, "again", None), (None, "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string").repartition(3)
    both = byte_bpe.decode(byte_bpe.encode(docs))
    assert both.columns == ["doc_id", "text", "IDS", "token_ids", "decoded"]
    got = both.collect()
    assert sorted(map(str, [(r.doc_id, r.text, r.IDS) for r in got])) == sorted(map(str, rows))
    for r in got:
        assert r.token_ids == LIBRARY.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    again = byte_bpe.encode(docs.withColumnRenamed("text", "Token_Ids"), "Token_Ids")
    assert again.columns == ["doc_id", "IDS", "token_ids"] and again.count() == len(rows)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0


def test_decoding_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TOKENS_AT_ONCE", 4)
    ids = [(1, [15496, 11, 995] * 5), (2, []), (3, None), (4, [50256]), (5, [15496, None]), (6, [220, -1, 220]), (7, [19526])]
    got = {r.k: r.decoded for r in byte_bpe.decode(spark.createDataFrame(ids, "k int, token_ids array<int>").coalesce(1)).collect()}
    assert bytes(got[1]) == b"Hello, world" * 5 and got[2] == b"" and bytes(got[7]) == LIBRARY.decode_bytes([19526])
    assert [got[i] for i in (3, 4, 5, 6)] == [None] * 4


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = byte_bpe.op12_byte_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = LIBRARY.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_packed_and_decoded_at_once(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 40)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, back string").coalesce(2)
    got = byte_bpe.encode(docs, packed=True, name="ids", decoded="back")
    assert got.columns == ["doc_id", "text", "ids", "back"]
    for r in got.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == LIBRARY.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
