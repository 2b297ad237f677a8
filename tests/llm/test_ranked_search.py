"""Ranked search against scoring everything."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from helixlake.llm import ranked_search
from helixlake.llm.search import Top, _terms_of, index_row


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n_docs, n_words, df = len(docs), sum(n for *_, n in docs), Counter()
    for _, c, _ in docs:
        df.update(c.keys())
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = set()
    for item, query in asked.items():
        scores = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in query.items() if c[t])
            if s > 0:
                scores.append((-s, i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def made(n=400, seed=5):
    rng = random.Random(seed)
    common, rare = ["the", "of", "And", "to", "in", "é", "漢"], [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        docs.append((i * 7 % 1_000, rng.choice([" ", ", ", "\n"]).join(rng.choices(common, k=rng.randint(0, 60)) + rng.choices(rare, k=rng.randint(0, 25)))))
    return docs + [(5, "the the the"), (5, "the the the"), (2_000, None), (2_001, ""), (2_002, "..."), (None, "w1 w2"), (2_003, "W1 " * 20_000)]


@pytest.mark.parametrize(("pair_terms", "blocks"), [(128, 1), (3, 1), (0, 1), (128, 3)])
def test_hits_are_all_the_best(spark, monkeypatch, pair_terms, blocks):
    if blocks > 1:
        monkeypatch.setattr(ranked_search, "QUERIES_PER_BLOCK", 20)
        monkeypatch.setattr(ranked_search, "BLOCK_BITS", 3)
    docs, rng = made(), random.Random(6)
    items = [(i, " ".join(t for _, x in rng.sample(docs[:400], 2) for t in x.split()[:20])) for i in range(50)]
    items += [(900, None), (901, ""), (902, "nowhere"), (903, "the the of THE"), (None, "the"), (904, "w1"), (904, "w2 w1")]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, score int, rank string").repartition(4)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = ranked_search.rank(d, q, pair_terms=pair_terms, shard_docs=150)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in got.collect()]
    want = plain(docs, items)
    assert {(a, c, s) for a, _, c, s in rows} == {(a, c, s) for a, _, c, s in want}
    assert sorted((a, b, s) for a, b, _, s in rows) == sorted((a, b, s) for a, b, _, s in want)
    assert set(rows) == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.rank(d.limit(0), q).collect() == []
    assert ranked_search.rank(d, q.limit(0)).collect() == []
    assert [tuple(r) for r in ranked_search.rank(d, q).collect()] == [(1, 1, 1, r) for r in [plain([(1, "a b")], [(1, "a")]).pop()[3]]]


def test_pair_lists_save_postings(monkeypatch):
    """Frequent terms of different documents: with joint maxima fewer postings are read, hits stay the same."""
    monkeypatch.setattr(ranked_search, "BLOCK_BITS", 3)
    rng = random.Random(11)
    words = [f"c{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words[(i % 4) * 3 : (i % 4) * 3 + 3], k=rng.randint(3, 40)) + rng.choices([f"r{j}" for j in range(200)], k=5)) for i in range(4_000)]
    split = [_terms_of_text(t) for t in texts]
    lengths = [len(w) for w in split]
    df = Counter(int(t) for w in split for t in np.unique(w))
    hot = np.array([t for t, _ in df.most_common(16)], np.uint64)
    weights = np.array([ranked_search.weight(len(texts), df[int(t)]) for t in hot], np.int64)
    row = ranked_search.with_impacts(index_row(list(range(len(texts))), split), len(texts), sum(lengths), hot, weights)
    rows = []
    for i in range(40):
        found, times = np.unique(_terms_of_text(" ".join([*rng.sample(words, 8), f"r{i}", f"r{i + 100}"])), return_counts=True)
        rows.append((i, found.view(np.int64).tolist(), times.tolist(), [df[int(t)] for t in found]))
    queries, read, hits = ranked_search.Queries(rows, len(texts), hot), {}, {}
    for pairs in (True, False):
        shard = ranked_search.Shard(row, queries, len(hot), pairs)
        hits[pairs] = []
        for q in range(len(rows)):
            own, top = slice(queries.offsets[q], queries.offsets[q + 1]), Top(20)
            shard.search(queries.number[own], queries.times[own], top)
            hits[pairs].append((top.scores.tolist(), top.docs.tolist()))
        read[pairs] = shard.scored
    every = sum(d for r in rows for d in r[3])
    assert hits[True] == hits[False]
    assert read[True] < 0.6 * min(read[False], every), (read, every)


def _terms_of_text(text):
    import pyarrow as pa

    return _terms_of(pa.scalar(text))


def test_shards_are_row_groups(spark):
    """A task holds one shard, however many its files have."""
    d = spark.createDataFrame([x for x in made() if x[0] is not None], "doc_id long, text string").coalesce(1)
    index, *_ = ranked_search.impact_index(d, shard_docs=50)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert len(files) < len(groups) == index.count() and set(groups) == {1}


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    want = con.sql(ranked_search.ORACLE)
    got = ranked_search.op13_ranked_search(spark, d).select(*want.columns).collect()
    assert {tuple(r) for r in got} == set(want.fetchall()) and len(got) > 500
