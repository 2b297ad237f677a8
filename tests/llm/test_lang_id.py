import math
import pickle
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixlake.llm import lang_id as L

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["eau", "tion", "lle", "oi"]}


def brute(word, pieces, probabilities, unknown):
    """The sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        if word[:n] in probabilities:
            total += probabilities[word[:n]] * brute(word[n:], pieces, probabilities, unknown)
        elif n == 1:
            total += unknown * brute(word[1:], pieces, probabilities, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aab", "▁ab"]
    rng = np.random.default_rng(0)
    table = rng.random((len(pieces) + 1, 2)) / 10
    model = pickle.loads(pickle.dumps(L.Model(pieces, ["x", "y"], table)))
    words = ["a", "ab", "aabab", "bbaab", "éa", "abéab", "c"]
    many = model.many(words)
    for w, row in zip(words, many, strict=True):
        for k in range(2):
            want = math.log(brute("▁" + w, pieces, dict(zip(pieces, table[:, k], strict=False)), table[-1, k]))
            assert abs(model.log_probabilities(w)[k] - want) < 1e-9 and abs(row[k] - want) < 1e-9
    assert np.isfinite(model.log_probabilities("ab" * 40_000)).all()


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(rng.integers(2, 30)))
        rows.append((i, text, lang))
    return rows


def test_held_out_accuracy_and_awkward_rows(spark):
    rows = corpus(np.random.default_rng(3), 400)
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !? x".replace("x", "²½"), "cc"), (1003, "kalo" * 20_000, None), (None, "scheinung", None), (1004, "x", None)]
    df = spark.createDataFrame([(*r, 5.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(4)
    got = {r.doc_id: r for r in L.identify(df, sample_docs=60).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[k].lang_pred == lang for k, _, lang in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "aa", "bb"]


def test_without_anything_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(df).collect()] == ["und"]
    assert L.identify(df.limit(0)).count() == 0


def test_one_model_after_another_predicts_the_same(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnop")[k % 11 : k % 11 + 4], 5)) for _ in range(12)), f"l{k:02}") for i, k in enumerate(list(range(30)) * 8)]
    df = spark.createDataFrame([*rows, (9000, None, None), (9001, "?!", "l01")], "doc_id long, text string, lang string").repartition(3)
    one = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(df).collect()}
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(df, languages_at_once=7).collect()} == one
    assert len({lang for lang, _ in one.values()}) > 20


def test_samples_are_bounded_under_ties_and_take_long_words(spark):
    rows = [(None, f"text {i}", "aa") for i in range(300)] + [(i, "word", "bb") for i in range(40)] + [(None, "same", "cc")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    sizes = {r.lang: r["count"] for r in L.training_rows(df, "text", "lang", "doc_id", F.lit(False), 25).groupBy("lang").count().collect()}
    assert sizes == {"aa": 25, "bb": 25, "cc": 25}
    long = [(i, "".join(SYLLABLES["aa" if i % 2 else "bb"] * 40), "aa" if i % 2 else "bb") for i in range(20)]
    got = L.identify(spark.createDataFrame([*long, (99, "kalo", None), (98, "schein", None)], "doc_id long, text string, lang string")).filter("doc_id > 90").collect()
    assert {r.doc_id: r.lang_pred for r in got} == {99: "aa", 98: "bb"}


def test_expected_counts_sum_over_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab"]
    table = np.random.default_rng(1).random((len(pieces) + 1, 1)) / 5
    model = pickle.loads(pickle.dumps(L.Model(pieces, ["x"], table)))
    p = dict(zip(pieces, table[:, 0], strict=False))

    def ways(word):
        if not word:
            yield 1.0, ()
        for n in range(1, len(word) + 1):
            if word[:n] in p:
                for share, rest in ways(word[n:]):
                    yield p[word[:n]] * share, (word[:n], *rest)

    every = list(ways("▁abab"))
    total = sum(x for x, _ in every)
    want = {q: sum(x * w.count(q) for x, w in every) / total for q in pieces}
    got = dict.fromkeys(pieces, 0.0)
    for i, share in model.expected("abab", 0):
        got[pieces[i]] += share
    assert all(abs(want[q] - got[q]) < 1e-9 for q in pieces)
    assert math.isfinite(sum(x for _, x in model.expected("ab" * 20_000, 0)))
