import hashlib
from collections import defaultdict

import numpy as np
import pytest

from helixlake.llm import line_dedup, mph


def brute(rows, min_docs=3, min_chars=20):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and k is not None:
                held[key(line)].add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and k != max(held[key(x)]))]
        out.append((-1 if k is None else k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


A, B, E20 = "a line that many documents share", "  ANOTHER Line which is repeated\t", "é" * 20
ROWS = [(1, f"{A}\nown one\n{A}"), (2, f"{A.upper()}\n\n{B}"), (3, f"{A}\n{B.lower()}\n{E20}"), (4, f"{B}\n{E20}\nshort"), (5, f"{E20}\n{E20[:-1]}"), (5, f"{E20}\n{E20[:-1]}"), (6, f"{E20[:-1]}\n{E20[:-1]}"), (7, f"{E20[:-1]}"), (8, None), (9, ""), (10, "\n"), (None, f"{A}\nnobody's"), (None, A), (11, "only\n" * 20_000 + A), (12, "A line held twice only, in two rows"), (12, "A line held twice only, in two rows"), (13, "A line held twice only, in two rows")]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_matches_brute_force_in_both_ways(spark, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "PROBE_ROWS", 3)
    df = spark.createDataFrame([(k, t, 7, "x") for k, t in ROWS], "doc_id long, text string, N_LINES int, extra string").repartition(3)
    out = line_dedup.dedup_lines(df, broadcast_bytes=broadcast_bytes)
    assert out.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect())
    assert got == brute(ROWS)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_names_in_another_case_and_clashing_columns(spark, broadcast_bytes):
    df = spark.createDataFrame([(i, A, 1, 2, 3) for i in range(3)], "Doc_ID long, Text string, __k int, __gone int, __cut int")
    out = line_dedup.dedup_lines(df, broadcast_bytes=broadcast_bytes)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted((r.Doc_ID, r.Text, r.n_dropped, r["__k"]) for r in out.collect()) == [(0, "", 1, 1), (1, "", 1, 1), (2, A, 0, 1)]


def test_one_index_serves_other_thresholds(spark):
    df = spark.createDataFrame([(k, t) for k, t in ROWS], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(df, min_docs=2).collect())
    assert got == [(k, d) for k, _, d, _ in brute(ROWS, min_docs=2)]


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_perfect_hash_is_minimal_and_rejects_by_fingerprint():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        h = mph.PerfectHash(*mph.build(keys))
        assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        mph.build(np.array([5, 5], np.uint64))
