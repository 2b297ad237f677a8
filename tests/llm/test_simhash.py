import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from helixlake.llm import simhash
from helixlake.operators.graph import component_roots


def brute_roots(points, radius):
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in range(i):
            if bin(int(points[i]) ^ int(points[j])).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_points(rng, groups=40):
    out = list(rng.integers(0, 2**63, 150, dtype=np.uint64))
    for base in list(out[:groups]):
        for _ in range(rng.integers(1, 12)):
            x = base
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= np.uint64(1) << np.uint64(k)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_local_and_routed_search_match_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(3):
        points = near_points(rng)
        want = brute_roots(points, 4)
        assert simhash.local_roots(points, np.ones(len(points), bool), 4, leaf=8).tolist() == want
        tree, forest = simhash.TopTree(points[::3], 4), simhash._Forest(len(points))
        for _, home, guest in tree.route(points, 4):
            at = np.sort(np.concatenate([home, guest]))
            for i, r in zip(at, simhash.local_roots(points[at], np.isin(at, home), 4, leaf=8), strict=True):
                forest.join(np.array([i, at[r]]))
        assert forest.roots(np.arange(len(points))).tolist() == want


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab, 300)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(60):
        words = texts[i % 20].split()
        for at in rng.integers(0, len(words), i % 4):
            words[at] = "X"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one"), (205, "é " * 30_000), (205, "é " * 30_000), (None, texts[3])]
    df = spark.createDataFrame([(k, t, "x", 7) for k, t in rows], "doc_id long, text string, fingerprint string, n int").repartition(5)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    points = np.unique(fps)
    root = dict(zip(points.tolist(), brute_roots(points, 4), strict=True))
    least = {}
    for (k, _), f in zip(rows, fps.tolist(), strict=True):
        if k is not None:
            least[root[f]] = min(k, least.get(root[f], k))
    want = sorted((-1 if k is None else k, f"{f:016x}", least[root[f]]) for (k, _), f in zip(rows, fps.tolist(), strict=True))
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in got) == want
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {w[2] for w in want} | {None}


def test_empty_table_and_long_chain(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = {r.node: r.root for r in component_roots(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_similar_texts_match_exact_jaccard(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocab, int(rng.integers(60, 400))))
        rows.append((i, " ".join(words)))
        for at in np.linspace(5, len(words) - 5, max(1, round(len(words) * (0.01, 0.018, 0.035)[i % 3]))).astype(int):
            words[at] = "X"
        rows.append((100 + i, " ".join(words)))
    base = list(rng.choice(vocab, 200))
    for i in range(40):  # a group with more near copies than `most`
        words = list(base)
        words[5 * i] = "Y"
        rows.append((300 + i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "One two"), (503, "one  TWO"), (None, rows[0][1])]
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for k, t in rows for w in [(t or "").lower().split()] if k is not None}
    keys = sorted(sets)
    same = {(a, b) for a in keys for b in keys if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))}
    least = {k: k for k in keys}
    for _ in keys:
        for a, b in same:
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs, nearest=4).collect()}
    assert sum(1 for i in range(60) if (i, 100 + i) in same) >= 30
    assert got == least
    assert sorted(map(str, (r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))) == sorted(map(str, [*set(least.values()), None]))


def test_cells_are_bounded_and_lose_no_pair(spark):
    rng = np.random.default_rng(4)
    points = np.unique(np.concatenate([near_points(rng, 100), rng.integers(0, 2**63, 3000, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(3)
    found = simhash.links(frame, 4, shard_points=100).collect()
    at = {int(x): i for i, x in enumerate(points.view(np.int64))}
    forest = simhash._Forest(len(points))
    for a, b in found:
        forest.join(np.array([at[a], at[b]]))
    assert forest.roots(np.arange(len(points))).tolist() == brute_roots(points, 4)
    dealt = spark.createDataFrame([(s, i, i % 10 == 0) for s in (0, 1) for i in range(2000)] + [(2, 5, True), (3, 6, False)], "shard int, fp long, home boolean")
    cells = simhash._cells(dealt, 50).groupBy("shard", "a", "k").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g")).collect()
    assert max(max(r.h, r.g) for r in cells) < 100 and max(r.a for r in cells) == 3


@pytest.mark.parametrize(("shard_texts", "cell_texts"), [(4096, 16384), (40, 30)])
def test_shards_of_near_copies_lose_no_link(spark, shard_texts, cell_texts):
    """A third of the texts are near copies of one, others stand near some of these, and shards are small."""
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(4000)]
    rows, base = [], list(rng.choice(vocab, 150))
    for i in range(200):
        words = list(base)
        words[int(rng.integers(0, 150))] = f"x{i}"
        rows.append((i, " ".join(words)))
    for i in range(200):
        words = list(rng.choice(vocab, 150))
        rows.append((1000 + 2 * i, " ".join(words)))
        if i % 4 == 0:
            words[3] = "Y"
            rows.append((1001 + 2 * i, " ".join(words)))
    far = list(base)  # alike to few of the copies only
    for at in (20, 60, 100):
        far[at] = "Z"
    rows.append((5000, " ".join(far)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs, shard_texts=shard_texts, cell_texts=cell_texts, nearest=4).collect()}
    want = {k: 0 if k < 200 or k == 5000 else k - k % 2 for k, _ in rows}
    wrong = sum(got[k] != c for k, c in want.items())
    assert wrong <= 1 if shard_texts < 4096 else wrong == 0  # repetitions find a pair with probability 0.995 at least


def test_similar_texts_of_an_empty_table(spark):
    assert simhash.similar_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sampled_bits_meet_as_often_as_planned():
    rng = np.random.default_rng(2)
    p, met, n = simhash.differing_bits(0.8), 0, 400
    for _ in range(n):
        common, a, b = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (160, 20, 20))
        both = np.concatenate([common, a, common, b])
        lanes = [simhash._majority(simhash.mix64(both, i), np.array([180, 180])) for i in range(simhash.LANES)]
        met += sum(int(np.bitwise_count(x[0] ^ x[1])) for x in lanes)
    assert abs(met / (n * 64 * simhash.LANES) - p) < 0.01


def test_forest_of_vantage_points_meets_similar_points():
    """Leaves come from distances to vantage points, are of like sizes, and pairs at the least similarity meet."""
    rng = np.random.default_rng(9)
    points = rng.integers(0, 2**64, (8_000, simhash.LANES), dtype=np.uint64)
    turned = rng.random((8_000, 64 * simhash.LANES)) < simhash.differing_bits(0.8)
    partners = points ^ np.packbits(turned, axis=1).view(np.uint64)
    trees = simhash.forest(points[:1_024], 4, 0.8, 5)
    met = np.zeros(len(points), bool)
    for tree in trees:
        leaves = tree.leaves(points)
        met |= leaves == tree.leaves(partners)
        for at in range(20):  # the way by hand
            node = 0
            while tree.side[node, 0] != node:
                d = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(points[at], tree.vantage[node], strict=True))
                node = tree.side[node, int(d > tree.cut[node])]
            assert node == leaves[at]
        assert len(np.unique(leaves)) == 16 and np.unique(leaves, return_counts=True)[1].max() < 2 * 8_000 / 16
    assert met.mean() > 0.99 and len(trees) < 34


def test_forest_of_points_closer_than_partners():
    """Points of which all pairs are nearer than the least similarity: less deep trees, or one leaf for all."""
    rng = np.random.default_rng(9)
    points = np.zeros((500, simhash.LANES), np.uint64)
    points[:, 0] = np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    trees = simhash.forest(points, 8, 0.8, 5)
    partners = points ^ np.packbits(rng.random((500, 64 * simhash.LANES)) < simhash.differing_bits(0.8), axis=1).view(np.uint64)
    assert np.any([tree.leaves(points) == tree.leaves(partners) for tree in trees], axis=0).mean() > 0.97
    assert len(simhash.forest(points[:1].repeat(9, axis=0), 3, 0.8, 5)) == 1


def test_marks_rule_out_no_similar_pair():
    rng = np.random.default_rng(6)
    sets = []
    for n in (1, 5, 9, 60, 146, 150, 1000, 1100):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for share in (0, 0.05, 0.1, 0.2, 0.4):
            some = base.copy()
            some[: round(share * n)] = rng.integers(0, 2**64, round(share * n), dtype=np.uint64)
            sets.append(np.unique(some))
    marks = simhash.Marks([simhash.marks_of(x) for x in sets], np.array([len(x) for x in sets]))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = marks.possible(a, b, 0.8)
    like = np.array([len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert got[like >= 0.8].all() and got[like < 0.6].mean() < 0.02


def test_many_near_copies_of_less_similarity(spark):
    """Copies of one text with few to many edits: most pairs are near by their bits, and few are alike."""
    rng = np.random.default_rng(10)
    vocab = [f"w{i}" for i in range(3000)]
    base, rows = list(rng.choice(vocab, 150)), []
    for i in range(150):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    sets = [simhash._shingle_set(t, 5, 42) for _, t in rows]
    least = list(range(len(rows)))
    for _ in range(6):
        for i in range(len(rows)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                    least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(docs, nearest=2).collect()} == dict(enumerate(least))
    assert len(set(least)) > 5
