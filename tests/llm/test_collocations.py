"""Collocations against a plain count of everything."""

import random
import re
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from helixlake.llm import collocations


def plain(rows, min_count, contained, top):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    kept = {p: a for p, a in counts.items() if a >= min_count and len(p[1]) > 1}
    around = Counter()
    for (lang, p), a in kept.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    around[lang, p[i:j]] = max(around[lang, p[i:j]], a)
    out = {}
    for (lang, p), a in kept.items():
        if 100 * around[lang, p] >= contained * a:
            continue
        score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, le, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)}


def made(n=300):
    rng = random.Random(3)
    words = ["the", "The", "of", "a", "new", "york", "city", "é", "\x01", "b\x1c", "x y", "漢字"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts.append(rng.choice(["new york city hall", "san fran cisco", *words, *words]))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), ("new york city hall " * 5_000, "xx"), ("aa " * 9_000, "xx")]


def test_chunks_are_row_groups(spark):
    """A task holds one chunk, however many its files have."""
    long = "a b c d " * (collocations.CHUNK_WORDS // 4)
    docs = spark.createDataFrame([(long, "en")] * 3, "text string, lang string").coalesce(1)
    parts = collocations.chunks(docs, "text", "lang", 4)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in parts.inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert len(files) < len(groups) == parts.count() and set(groups) == {1}


@pytest.mark.parametrize("small", [False, True])
def test_everything_counts(spark, monkeypatch, small):
    """Small chunks, slices, ranges and bitmaps change nothing."""
    if small:
        for name, value in (("CHUNK_WORDS", 700), ("SLICE_BYTES", 50), ("RANGE_ROWS", 9), ("MOST_BITS", 15)):
            monkeypatch.setattr(collocations, name, value)
    rows = made()
    docs = spark.createDataFrame([(t, lang, "p", 1) for t, lang in rows], "Text string, lang string, phrase string, W1 int").repartition(3)
    got = collocations.collocations(docs, min_count=5).collect()
    assert {tuple(r) for r in got} == plain(rows, 5, 80, 2_000) and len(got) > 100


def test_top_and_ties(spark):
    rows = [("a b. c d. e f g. " * 40, "en"), ("é z. " * 40, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {tuple(r) for r in collocations.collocations(docs, top=3).collect()}
    assert got == plain(rows, 30, 80, 3) and len(got) == 3


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []
    few = spark.createDataFrame([(None, None), ("", "en"), ("one two", "en")], "text string, lang string")
    assert collocations.collocations(few).collect() == []
    alone = spark.createDataFrame([("word. " * 50, "en")], "text string, lang string")
    assert collocations.collocations(alone).collect() == []


def test_counts_beyond_64_bits(spark):
    """A million million million of a phrase: scores stay exact."""
    rows = spark.createDataFrame([("en", "a", 1, 4 * 10**18, "a", None), ("en", "b", 1, 3 * 10**18, "b", None), ("en", "a b", 2, 3 * 10**18, "a", "b")], "lang string, phrase string, n int, a long, w1 string, w2 string")
    got = {r.phrase: (list(r.heads), r.more) for r in collocations.lockstep(rows, ["lang", "w1", "w2"], "heads", "more").collect()}
    assert got == {"a": ([], 3 * 10**18), "b": ([], 0), "a b": ([4 * 10**18], 0)}
    assert collocations.scored(spark.createDataFrame([("en", "a b", 2, 3 * 10**18, [4 * 10**18], [8 * 10**18])], "lang string, phrase string, n int, a long, heads array<long>, tails array<long>")).first().score == 2_000_000 * 3 * 10**18 // (12 * 10**18)


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{d}/documents.parquet'")
    want = con.sql(collocations.ORACLE)
    got = collocations.op11_collocations(spark, d).select(*want.columns).collect()
    assert {tuple(r) for r in got} == set(want.fetchall()) and len(got) > 200
