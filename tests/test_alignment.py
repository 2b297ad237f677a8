"""Affine alignment against a cell-by-cell table."""

import random

import pytest

from helixlake.operators import alignment


def plain(a, b):
    """The three tables of scores, and the way back: both, then a gap in b, then one in a."""
    if not a or not b:
        return []
    score = {(i, j): [-(10**9)] * 3 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    score[0, 0][0] = 0
    for (i, j), cell in score.items():
        if i and j:
            cell[0] = max(score[i - 1, j - 1]) + (2 if a[i - 1] == b[j - 1] else -1)
        if i:
            cell[1] = max(s - c for s, c in zip(score[i - 1, j], (3, 1, 3), strict=True))
        if j:
            cell[2] = max(s - c for s, c in zip(score[i, j - 1], (3, 3, 1), strict=True))
    i, j = len(a), len(b)
    state, out = score[i, j].index(max(score[i, j])), []
    while i or j:
        value = score[i, j][state]
        i, j, costs = (i - 1, j - 1, (0, 0, 0)) if state == 0 else (i - 1, j, (3, 1, 3)) if state == 1 else (i, j - 1, (3, 3, 1))
        if state == 0:
            out.append((i, j))
            value = max(score[i, j])
        state = [s - c for s, c in zip(score[i, j], costs, strict=True)].index(value)
    return out[::-1]


def gapped(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        a = "".join(rng.choice("ACGU") for _ in range(rng.randint(1, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            k, way = rng.randint(0, len(b)), rng.random()
            if way < 0.4:
                b[k:k] = [rng.choice("ACGU") for _ in range(rng.randint(1, 5))]
            elif way < 0.8:
                del b[k : k + rng.randint(1, 5)]
            elif k < len(b):
                b[k] = rng.choice("ACGU")
        yield a, "".join(b)


@pytest.mark.parametrize("cells", [3_000, 8_000_000])
def test_a_thousand_gapped_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(alignment, "CELLS_AT_ONCE", cells)
    rows = [(i, a, b) for i, (a, b) in enumerate(gapped(1_000))]
    pairs = spark.createDataFrame(rows, "k int, truth string, predicted string")
    maps = {}
    for r in alignment.residue_maps(pairs, "k", "truth", "predicted").collect():
        maps.setdefault(r.k, []).append((r.gt_idx, r.pred_idx))
    want = {k: plain(a, b) for k, a, b in rows}
    assert {k: sorted(m) for k, m in maps.items()} == {k: m for k, m in want.items() if m}
    got = {r.k: (r.identity, r.aligned) for r in alignment.report_identity(pairs, "truth", "predicted").collect()}
    assert got == {k: (sum(a[i] == b[j] for i, j in want[k]) / max(len(a), len(b), 1), len(want[k])) for k, a, b in rows}


def test_two_rules_differ():
    pair, i, j, same = alignment.align(["AG"], ["GA"])
    assert list(zip(i, j, strict=True)) == [(0, 0), (1, 1)] and not same.any()


def test_awkward_rows(spark):
    rows = [(1, None, "A"), (1, None, "A"), (2, "", ""), (3, "A", None), (4, "ACGU", "ACGU"), (5, "É漢😀A", "漢😀A"), (None, "AC", "C"), (6, "A" * 900, "A" * 600 + "C" * 10)]
    pairs = spark.createDataFrame([(*r, 7, "x") for r in rows], "k int, a string, b string, ALIGNED int, residues string")
    got = alignment.report_identity(pairs, "a", "b")
    assert got.columns == ["k", "a", "b", "residues", "identity", "aligned"]
    found = {r.k: (round(r.identity, 4), r.aligned) for r in got.collect()}
    assert found == {1: (0.0, 0), 2: (0.0, 0), 3: (0.0, 0), 4: (1.0, 4), 5: (0.75, 3), None: (0.5, 1), 6: (round(600 / 900, 4), 610)} and got.count() == len(rows)
    maps = alignment.residue_maps(pairs, "k", "a", "b")
    assert sorted((r.gt_idx, r.pred_idx) for r in maps.filter("k = 5").collect()) == [(1, 0), (2, 1), (3, 2)]
    assert maps.filter("k IN (1, 2, 3)").count() == 0 and alignment.report_identity(pairs.limit(0), "a", "b").count() == 0
