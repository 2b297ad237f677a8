import math
import re
from collections import Counter

import numpy as np
import pytest

from helixlake.llm import search


def brute(rows, queries, k):
    words = {i: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t in rows}
    n, average = len(rows), sum(map(len, words.values())) / len(rows)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q in queries:
        scores = Counter()
        for w in set(words[q]):
            idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
            for i, ws in words.items():
                tf = ws.count(w)
                if tf:
                    scores[i] += round(1e6 * idf * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(ws) / average))))
        best = sorted((-s, i) for i, s in scores.items() if s)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(2)
    vocab, p = [f"w{i}" for i in range(900)], 1 / np.arange(1, 901)
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(3, 120), p=p / p.sum()))) for i in range(1500)]
    rows[7] = (7, rows[4][1].upper())
    rows[100], rows[200], rows[300] = (100, None), (200, ""), (300, "... !")
    rows[400] = (400, "é Ünïcode w1 " * 3)
    rows[500] = (500, "w3 w5 " * 40_000)
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rank int, term string").repartition(3)
    queries = [i for i, _ in rows if i % 100 == 0] + [7]
    monkeypatch.setattr(search, "QUERIES_PER_BLOCK", 6)
    got = search.top_k(df, df.filter("doc_id % 100 = 0 or doc_id = 7"), k=7, shard_docs=400).collect()
    assert sorted((r.query_id, r.rank, r.doc_id, round(r.score * 1e6)) for r in got) == brute(rows, queries, 7)


def test_pruning_skips_work_and_stays_exact(spark):
    rows = corpus()
    index = search.index_row([i for i, _ in rows], [search.text_words(t) for _, t in rows])
    df = Counter()
    for _, t in rows:
        df.update(set(search.text_words(t).view(np.int64).tolist()))
    terms = sorted(set(search.text_words(rows[4][1]).view(np.int64).tolist()))
    block = search.Queries([(4, terms, [df[t] for t in terms])], len(rows))
    shard = search.Shard(index, block, index["n_words"] / len(rows))
    top = search.Top(3)
    seen = []
    monkey = search.Shard._sum
    try:
        search.Shard._sum = lambda self, postings: (seen.append(len(postings)), monkey(self, postings))[1]
        shard.search(shard.row[block.number], top)
    finally:
        search.Shard._sum = monkey
    assert sum(seen) < sum(shard.size[shard.row[shard.row >= 0]])
    assert top.docs[:2].tolist() == [4, 7]


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, "alpha beta"), (1, "alpha beta"), (2, "alpha beta"), (None, "alpha"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, search.top_k(df, df, k=2).select("query_id", "rank", "doc_id").collect()))
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1)]
    assert search.top_k(df.limit(0), df.limit(0)).count() == 0
    assert search.top_k(df, df.filter("doc_id = 3")).count() == 0


@pytest.mark.parametrize("at_once", [1, 64])
def test_pivots_in_any_number_find_the_same(monkeypatch, at_once):
    monkeypatch.setattr(search, "PIVOTS_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    words = [np.minimum(rng.zipf(1.3, rng.integers(1, 60)), 500).astype(np.uint64) for _ in range(3000)]
    df = np.bincount(np.concatenate([np.unique(w) for w in words]).astype(int), minlength=501)
    average = np.mean([len(w) for w in words])
    asked = [(i, np.unique(words[i]).view(np.int64).tolist(), df[np.unique(words[i]).astype(int)].tolist()) for i in range(0, 3000, 100)]
    queries = search.Queries(asked, len(words))
    shard = search.Shard(search.index_row(list(range(3000)), words), queries, average)
    every = np.zeros((len(asked), 3000), np.int64)
    for q in range(len(asked)):
        terms = shard.row[queries.number[queries.offsets[q] : queries.offsets[q + 1]]]
        for t in terms:
            own = slice(shard.start[t], shard.start[t] + shard.size[t])
            every[q, shard.doc[own]] += shard.add[own]
        top = search.Top(10)
        shard.search(terms, top)
        best = np.lexsort((np.arange(3000), -every[q]))[:10]
        assert top.docs.tolist() == best.tolist() and top.scores.tolist() == every[q][best].tolist()


def test_frequent_terms_are_summed_at_once():
    """Their postings aren't listed for each query, and the bound of their sums is no less than the sums."""
    rng = np.random.default_rng(4)
    words = [np.concatenate([rng.choice(np.arange(1, 41), rng.integers(5, 30)), rng.integers(100, 40_000, 10)]).astype(np.uint64) for _ in range(2_000)]
    found, df = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    asked = [(i, np.unique(words[i]).view(np.int64).tolist(), df[np.searchsorted(found, np.unique(words[i]))].tolist()) for i in range(0, 2_000, 40)]
    queries = search.Queries(asked, len(words))
    shard = search.Shard(search.index_row(list(range(2_000)), words), queries, np.mean([len(w) for w in words]))
    seen, monkey, every = [], search.Shard._sum, 0
    lists = np.split(shard.row[queries.number], queries.offsets[1:-1])
    lifts = shard.lifts(lists)
    try:
        search.Shard._sum = lambda self, postings: (seen.append(len(postings)), monkey(self, postings))[1]
        for terms, lift in zip(lists, lifts, strict=True):
            assert (lift >= shard.dense[shard.dense_of[terms][shard.dense_of[terms] >= 0]].sum(axis=0)).all()
            top = search.Top(10)
            shard.search(terms, top, lift)
            sums = np.zeros(2_000, np.int64)
            for t in terms:
                own = slice(shard.start[t], shard.start[t] + shard.size[t])
                sums[shard.doc[own]] += shard.add[own]
            best = np.lexsort((np.arange(2_000), -sums))[:10]
            assert top.docs.tolist() == best.tolist() and top.scores.tolist() == sums[best].tolist()
            every += shard.size[terms].sum()
    finally:
        search.Shard._sum = monkey
    assert sum(seen) < every / 50
