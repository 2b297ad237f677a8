"""Batches and bins against one pass over all items."""

import random

import pytest

from helixlake.operators import packing


def one_pass(sizes, special, max_tokens, max_items):
    out, longest, held = [], 0, 0
    for n in sizes:
        n = (n or 0) + special
        if not held or max(longest, n) * (held + 1) > max_tokens or held >= max_items:
            longest, held = 0, 0
        out.append((out[-1] if out else -1) + (held == 0))
        longest, held = max(longest, n), held + 1
    return out


@pytest.mark.parametrize(("stretch", "max_tokens", "max_items"), [(65_536, 1_000, 6), (13, 1_000, 6), (7, 400, 7), (8, 10**9, 3), (5, 1, 5), (64, 5_000, 64)])
def test_batches(spark, monkeypatch, stretch, max_tokens, max_items):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    rng = random.Random(stretch)
    sizes = [rng.choice((0, None, 5, 40, 90, 300, 700)) for _ in range(400)]
    items = spark.createDataFrame([(i // 7, i, n, "x") for i, n in enumerate(sizes)], "part int, i int, n int, size string").repartition(5)
    got = packing.pack_batches(items, "part", "i", "n", special=2, max_tokens=max_tokens, max_items=max_items)
    assert got.columns == ["part", "i", "n", "size", "batch_no"]
    assert [r.batch_no for r in got.orderBy("i").collect()] == one_pass(sizes, 2, max_tokens, max_items)


def test_small_batches(spark):
    items = spark.createDataFrame([(0, i, n) for i, n in enumerate((100, 200, 300, 900, 10))], "shard int, i int, n int")
    got = packing.pack_batches(items, "shard", "i", "n", special=2, max_tokens=500, max_items=8).orderBy("i").collect()
    assert [r.batch_no for r in got] == [0, 0, 1, 2, 3]
    assert packing.pack_batches(items.limit(0), "shard", "i", "n").count() == 0
    assert [r.batch_no for r in packing.pack_batches(items.limit(1), "shard", "i", "n").collect()] == [0]


def heap(weights, bins):
    loads, out = [0] * bins, []
    for w in weights:
        b = loads.index(min(loads))
        loads[b] += max(0, w or 0)
        out.append(b)
    return out


@pytest.mark.parametrize(("stretch", "values", "bins"), [(65_536, [1, 2, 3], 4), (17, [0, 5, 7], 3), (50, [None, -3, 10], 5), (11, range(1, 90), 7), (65_536, [4], 3), (9, [10**15, 1], 1)])
def test_least_loaded(spark, monkeypatch, stretch, values, bins):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    monkeypatch.setattr(packing, "SEGMENTS_AT_ONCE", 10)
    rng = random.Random(bins)
    weights = [rng.choice(list(values)) for _ in range(300)]
    for ordered in (True, False):
        rows = sorted(weights, key=lambda w: -10 if w is None else w) if ordered else weights
        items = spark.createDataFrame([(i, w, 0) for i, w in enumerate(rows)], "i int, w long, t int").repartition(4)
        got = packing.least_loaded(items, ["w", "i"] if ordered else ["i"], "w", bins)
        assert got.columns == ["i", "w", "t", "bin"]
        assert [r.bin for r in got.orderBy("i").collect()] == heap(rows, bins)


def test_filling_is_the_heap():
    rng = random.Random(1)
    for _ in range(500):
        loads = [rng.randint(0, 40) for _ in range(rng.randint(1, 6))]
        w, n, mine = rng.randint(0, 9), rng.randint(1, 60), list(loads)
        want = []
        for _ in range(n):
            b = loads.index(min(loads))
            loads[b] += w
            want.append(b)
        got = [turns[k % len(turns)] for size, turns in packing.fill(mine, w, n) for k in range(size)]
        assert got == want and mine == loads


def test_nothing_to_load(spark):
    assert packing.least_loaded(spark.createDataFrame([], "i int, w int"), ["i"], "w", 3).count() == 0
