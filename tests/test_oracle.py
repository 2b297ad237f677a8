"""Every query that has SQL gives DuckDB's rows on the driver's smallest tables."""

import math
import os

import duckdb
import pytest

from helixlake.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ").replace("+00:00", "")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    res = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


def names_of_parts():
    rows = duckdb.sql(f"SELECT p_partkey, upper(replace(p_name, ' ', '')) FROM '{SF}/part.parquet'").fetchall()
    at = dict(rows)
    return {k: (s, at[k + 1]) for k, s in rows if k + 1 in at}


def aligned(a, b):
    """Cell by cell: the best (score, matches, -columns) of every two prefixes, and the way back."""
    best = {(0, 0): (0, 0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = []
            if i and j:
                s, m, c = best[i - 1, j - 1]
                ways.append((s + (1 if a[i - 1] == b[j - 1] else -1), m + (a[i - 1] == b[j - 1]), c - 1))
            ways += [(s - 1, m, c - 1) for s, m, c in ([best[i - 1, j]] if i else []) + ([best[i, j - 1]] if j else [])]
            if ways:
                best[i, j] = max(ways)
    i, j, pairs = len(a), len(b), []
    while i and j:
        same = a[i - 1] == b[j - 1]
        s, m, c = best[i - 1, j - 1]
        if best[i, j] == (s + (1 if same else -1), m + same, c - 1):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i, j] == (best[i - 1, j][0] - 1, best[i - 1, j][1], best[i - 1, j][2] - 1):
            i -= 1
        else:
            j -= 1
    score = best[len(a), len(b)]
    return (score[1] / -score[2] if score[2] else 1.0), pairs[::-1]


def test_alignments_of_parts(spark):
    want = {k: aligned(a, b) for k, (a, b) in names_of_parts().items()}
    got = {r.p_partkey: r.identity for r in catalog.QUERIES["seq_identity"](spark, SF).collect()}
    assert got == {k: round(i, 6) for k, (i, _) in want.items()}


def test_every_query_is_checked():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
