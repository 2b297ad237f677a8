import random

import pytest
from tokenizers import Tokenizer, models

from helixlake.llm import token_count, unigram

PIECES = unigram.load_pieces()
TIES = [("▁a", -1.0), ("▁ab", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0), ("bc", -2.0), ("▁", -1.0), ("▁▁", -2.0)]


def texts():
    rng = random.Random(4)
    words = ["the", "of", "naïve", "漢字", "🙂", "  ", "x" * 70, "▁", "\n", "\t", "Straße", "abcabcab", "1234.5"]
    return ["", " ", "a", " a ", "the  cat", "▁", *(" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300)), *("".join(rng.choices("abc ▁é", k=rng.randint(0, 40))) for _ in range(1500))]


@pytest.mark.parametrize("pieces", [PIECES, TIES])
def test_counts_are_the_tokenizers(pieces):
    real = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    mine = token_count.Counter(pieces, byte_fallback=False)
    for t in texts():
        marked = unigram.MARK + t.replace(" ", unigram.MARK) if t else ""
        assert mine.count(t) == (len(real.encode(marked).ids) if marked else 0), repr(t)


def test_byte_fallback_counts_bytes():
    ids = [("<unk>", 0.0), *[(f"<0x{i:02X}>", -1e6) for i in range(256)], *TIES]
    real, mine = Tokenizer(models.Unigram(ids, unk_id=0, byte_fallback=True)), token_count.Counter(TIES, byte_fallback=True)
    for t in ("é", "aé漢b", "ab 🙂🙂 c", "ééé"):
        assert mine.count(t) == len(real.encode(unigram.MARK + t.replace(" ", unigram.MARK)).ids)


def test_operator_on_awkward_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "the " * 50_000, 9), (3, "the " * 50_000, 9), (None, "of", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    real = Tokenizer(models.Unigram([("<unk>", 0.0), *PIECES], unk_id=0, byte_fallback=False))
    long = len(real.encode("▁the" * 50_000 + "▁").ids)
    got = [(r.doc_id, r.n_tokens) for r in token_count.count_tokens(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (3, long), (3, long), (None, 1)], key=str)
    assert token_count.count_tokens(df.limit(0)).count() == 0
