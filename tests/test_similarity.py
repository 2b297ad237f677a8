"""The similarity join against all pairs, for lengths and alphabets of all kinds."""

import random

import duckdb
import pyarrow as pa
import pytest

from helixlake.operators import sequences


def family(rng, letters, low, high, n, copies, share):
    """Sequences and near copies of them, up to `share` of their letters edited."""
    out = set()
    for _ in range(n):
        s = "".join(rng.choices(letters, k=rng.randint(low, high)))
        out.add(s)
        for _ in range(copies):
            t = list(s)
            for _ in range(rng.randint(0, max(1, int(len(s) * share)))):
                i, way = rng.randrange(len(t) + 1), rng.random()
                if way < 0.34:
                    t.insert(i, rng.choice(letters))
                elif i < len(t) and way < 0.67:
                    del t[i]
                elif i < len(t):
                    t[i] = rng.choice(letters)
            out.add("".join(t))
    # edits at even distances, which leave no long run of letters whole
    s = "".join(rng.choices(letters, k=high))
    out |= {s, "".join(c if i % 6 else rng.choice(letters) for i, c in enumerate(s)), "".join(c for i, c in enumerate(s) if i % 7)}
    return out - {""}


def all_pairs(texts, identity):
    con, plain = duckdb.connect(), {c: chr(97 + i) for i, c in enumerate(sorted({c for s in texts for c in s}))}  # its edits are those of bytes
    spelled = {"".join(plain[c] for c in s): s for s in texts}
    con.register("t", pa.table({"s": sorted(spelled)}))
    return ((*sorted((spelled[a], spelled[b])), d) for a, b, d in con.sql(f"""SELECT a.s, b.s, levenshtein(a.s, b.s) FROM t a JOIN t b ON a.s < b.s AND abs(length(a.s) - length(b.s)) <= (1 - {identity} + 1e-12) * greatest(length(a.s), length(b.s))
                           WHERE levenshtein(a.s, b.s) <= floor((1 - {identity} + 1e-12) * greatest(length(a.s), length(b.s)))""").fetchall())


@pytest.mark.parametrize(
    ("letters", "low", "high", "n", "identity", "common", "block"),
    [("ACGU", 10, 60, 60, 0.8, 200, 1_000), ("ACGU", 10, 60, 60, 0.8, 6, 20), ("ACGU", 100, 2_000, 12, 0.8, 200, 1_000), ("ACGU", 300, 900, 15, 0.95, 5, 7),
     ("abcdefghijklmnopqrstuvwxyz ", 5, 200, 60, 0.8, 200, 1_000), ("ab", 1, 12, 80, 0.5, 10, 50), ("éß漢😀", 1, 9, 60, 0.7, 200, 1_000), ("ACGU", 1, 30, 40, 1.0, 9, 9)],
)
def test_equal_to_all_pairs(spark, monkeypatch, letters, low, high, n, identity, common, block):
    monkeypatch.setattr(sequences, "COMMON", common)
    monkeypatch.setattr(sequences, "BLOCK", block)
    texts = family(random.Random(high), letters, low, high, n, 3, 1 - identity)
    df = spark.createDataFrame([(s, 1) for s in [*texts, *list(texts)[:5]]] + [(None, 1), ("", 1)], "s string, n int")
    got = {(r.a, r.b, r.distance) for r in sequences.similar_pairs(df, "s", identity).collect()}
    assert got == set(all_pairs(texts, identity))
    few = {(r.a, r.b, r.distance) for r in sequences.similar_pairs(df, "s", identity, short=20).collect()}
    assert few == {p for p in got if min(len(p[0]), len(p[1])) < 20}


def test_rows_grow_with_the_length(spark):
    rng, rows = random.Random(2), {}
    for n in (100, 400, 1_600):
        df = spark.createDataFrame([("".join(rng.choices("ACGU", k=n)),) for _ in range(20)], "s string")
        rows[n] = sequences.prefix_grams(sequences.numbered(df, "s"), 0.9).count() / 20
        assert rows[n] <= 2 * n  # grams of one length or two
    assert sequences.similar_pairs(df.limit(0), "s", 0.8).count() == 0
