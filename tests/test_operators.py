import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixlake.functions import scalars
from helixlake.operators import assignment, coordinates, graph, joins, ranking, sequences, stats

NAN = float("nan")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_rank1_is_strict(spark):
    c = spark.createDataFrame([("a", 1, 0, 0.9, NAN), ("a", 0, 0, 0.5, 2.0), ("a", 2, 0, NAN, 1.0), ("b", 1, 1, NAN, 1.0), ("b", 0, 3, None, 2.0), ("c", 1, 0, 0.7, 1.0), ("c", 0, 1, 0.7, 3.0), ("c", 0, 0, float("inf"), 9.0)], "pdb_id string, seed int, sample int, ranking_score double, rmsd double")
    got = {r.pdb_id: (r.seed, r.sample, r.selection_status) for r in ranking.rank1(c).collect()}
    assert got == {"a": (1, 0, "OK"), "b": (0, 3, "NO_FINITE_SCORE"), "c": (0, 1, "OK")}
    n = {r.pdb_id: (r.candidate_count, r.evaluated_count, r.oracle_best, r.tie_count) for r in ranking.rank1_companions(c).collect()}
    assert n == {"a": (3, 2, 1.0, 1), "b": (2, 2, 1.0, 0), "c": (3, 3, 1.0, 2)}


def test_missing_values_stay_in_the_denominator(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (11.0,)], "v double")
    r = stats.describe(df, F.col("v")).first()
    assert (r.n_total, r.n_with, r.p50, round(r.pct_le_2, 4)) == (4, 3, 3.0, 33.3333)
    empty = stats.summary_counters(df.limit(0), ok=F.col("v") > 0).first()
    assert (empty.n, empty.all_pass) == (0, False)


def test_final_summary_and_empty_bins(spark):
    df = spark.createDataFrame([(1.0, False, "1-20"), (-2.0, False, "1-20"), (4.0, True, ">200"), (3.0, False, ">200")], "v double, ex boolean, g string")
    r, = stats.main_table(df.withColumn("t", F.lit(None).cast("string")), "v", "ex", "t", "g", "g").filter("section = 'overall'").collect()
    assert (r.n_total, r.n_valid, r.median, r.iqr) == (4, 2, 2.0, 1.0)
    bins = stats.describe_bins(df, F.col("v"), "g", ["1-20", "21-50", ">200"]).orderBy("bin_order").collect()
    assert [(b.g, b.n_total) for b in bins] == [("1-20", 2), ("21-50", 0), (">200", 2)]


def test_ecdf_keeps_ties(spark):
    df = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, None, 2.0)], "v double")
    assert rows(stats.ecdf(df, "v"), "y") == [(1.0, 0.25), (2.0, 0.5), (3.0, 0.75), (3.0, 1.0)]


def test_validated_join_refuses_duplicates(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (1, "z")], "k int, w string")
    with pytest.raises(joins.DuplicateKey):
        joins.one_to_one(a, b, "k")
    joins.assert_counts(b, two=(F.col("k") == 1, 2))
    with pytest.raises(AssertionError):
        joins.assert_counts(b, one=(F.col("w") == "y", 2))


def test_pairing_of_copies_and_residuals(spark):
    a = spark.createDataFrame([("t", "A", "ACGU"), ("t", "B", "ACGU"), ("t", "C", "GG"), ("t", "D", "CC")], "pdb string, chain string, seq string")
    b = spark.createDataFrame([("t", "X", "ACGU"), ("t", "Y", "ACGU"), ("t", "Z", "GG"), ("t", "W", "CA")], "pdb string, chain string, seq string")
    pairs = joins.pair_equal_sequences(a, b, "pdb", "seq", "chain")
    got = {(r.chain_a, r.chain_b): r.status for r in pairs.collect()}
    assert got == {("A", "X"): "ORDER_ASSUMED", ("B", "Y"): "ORDER_ASSUMED", ("C", "Z"): "EXACT_UNIQUE", ("D", None): "NO_MATCH", (None, "W"): "NO_MATCH"}
    assert rows(joins.pair_residual(pairs, "pdb")) == [("t", "D", "W")]


def test_masking_end_to_end(spark):
    entities = spark.createDataFrame([("3AAA#1", None, dt.date(2025, 1, 1)), ("3AAA#2", 2.0, dt.date(2025, 1, 1)), ("4AAA#1", 3.0, dt.date(2025, 2, 1)), ("5AAA#1", None, dt.date(2025, 1, 1))], "key string, resolution double, day date")
    hit = "query string, target string, identity double, qcov double, tcov double"
    ref = spark.createDataFrame([("3AAA#1", "1AAA#1", 1.0, 1.0, 1.0), ("3AAA#1", "0AAA#1", 1.0, 1.0, 1.0)], hit)
    inner = spark.createDataFrame([("3AAA#2", "4AAA#1", 0.9, 0.9, 0.9), ("3AAA#1", "5AAA#1", 0.9, 0.9, 0.9)], hit)
    got = {r.key: (r.status, r.match, r.cluster_id) for r in graph.mask_redundant(entities, ref, inner, "key", "resolution", "day").collect()}
    assert got == {"3AAA#1": ("MASK_REFERENCE", "0AAA#1", None), "3AAA#2": ("EVALUATE", None, "cluster_0001"), "4AAA#1": ("MASK_INTERNAL", "3AAA#2", "cluster_0001"), "5AAA#1": ("EVALUATE", None, "cluster_0002")}
    chains = spark.createDataFrame([("3AAA", "A", False), ("3AAA", "B", True), ("4AAA", "A", False)], "pdb string, chain string, ev boolean")
    assert {r.pdb: r.status for r in graph.entry_status(chains, "pdb", "chain", "ev").collect()} == {"3AAA": "KEEP_PARTIAL", "4AAA": "DROP"}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(120)] + [(600, 600 + i) for i in range(1, 90)]
    parent = list(range(1000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(1000).select(F.col("id").alias("k"))
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.k: r.component for r in graph.components(nodes, frame, "k").collect()}
    assert got == {i: find(i) for i in range(1000)}
    roots = {r.node: r.root for r in graph.component_roots(frame, chunk_edges=50).collect()}  # many chunks
    assert roots == {i: c for i, c in got.items() if i != c}
    names = frame.select(*[F.format_string("n%04d", c).alias(c) for c in "ab"])
    assert {r.node: r.root for r in graph.component_roots(names).collect()} == {f"n{i:04}": f"n{c:04}" for i, c in roots.items()}
    assert graph.component_roots(frame.limit(0)).isEmpty()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(("low", "high", "identity"), [(1, 14, 0.75), (10, 30, 0.8), (30, 60, 0.9)])
def test_similar_pairs_match_all_pairs(spark, low, high, identity):
    rng = random.Random(low)
    base = ["".join(rng.choices("ACGU", k=rng.randint(low, high))) for _ in range(25)]
    every = set(base)
    for s in base:
        for _ in range(3):
            t = list(s)
            for _ in range(rng.randint(0, max(1, len(t) // 5))):
                op, i = rng.random(), rng.randrange(len(t)) if t else 0
                if op < 0.4 and t:
                    t[i] = rng.choice("ACGU")
                elif op < 0.7 and len(t) > 1:
                    del t[i]
                else:
                    t.insert(i, rng.choice("ACGU"))
            every.add("".join(t))
    want = {(a, b): edits(a, b) for a, b in itertools.combinations(sorted(every), 2) if edits(a, b) <= math.floor((1 - identity + 1e-12) * max(len(a), len(b)))}
    df = spark.createDataFrame([(s,) for s in every] + [(None,), ("",)], "s string").repartition(3)
    assert {(r.a, r.b): r.distance for r in sequences.similar_pairs(df, "s", identity).collect()} == want


def test_identity_and_residue_map(spark):
    assert sequences.global_identity("ACGU", "ACU") == 0.75
    assert sequences.global_identity("", "") == 1.0 and sequences.global_identity("A", "") == 0.0
    assert sequences.global_identity("A(PSU)G", "A(PSU)G") == 1.0
    assert sequences.aligned_residues("ACGU", "ACU") == [(0, 0), (1, 1), (3, 2)]

    def brute(a, b):
        row = [(-j, 0, -j) for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [(-i, 0, -i)]
            for j, y in enumerate(b, 1):
                d, u, l = row[j - 1], row[j], new[j - 1]
                new.append(max((d[0] + (1 if x == y else -1), d[1] + (x == y), d[2] - 1), (u[0] - 1, u[1], u[2] - 1), (l[0] - 1, l[1], l[2] - 1)))
            row = new
        return row[-1][1] / -row[-1][2]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("ACGU", k=rng.randint(1, 12))) for _ in range(2))
        assert abs(sequences.global_identity(a, b) - brute(a, b)) < 1e-12


def points(n, seed=0):
    return np.random.default_rng(seed).normal(size=(n, 3)) * 10


def turn(seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def test_superposition(spark):
    data = []
    for s in range(6):
        p = points(20, s)
        q = p @ turn(s).T + [5, -2, 7] + (np.random.default_rng(s).normal(size=p.shape) if s > 2 else 0)
        if s == 2:
            q = p * [1, 1, -1]
        data += [(s, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, q, strict=True))]
    data += [(9, i, 0.0, 0.0, float(i), 1.0, 1.0, float(i)) for i in range(2)]
    df = spark.createDataFrame(data, "s int, i int, x double, y double, z double, x_pred double, y_pred double, z_pred double").repartition(5)
    got = {r.s: r.rmsd for r in coordinates.superposition(df, "s").collect()}
    assert got[0] < 1e-6 and got[1] < 1e-6 and got[2] > 1 and got[9] is None
    after = {r.s: r.rmsd for r in coordinates.rmsd(coordinates.superpose(df, "s"), "s").collect()}
    assert set(after) == set(range(6)) and all(abs(after[s] - got[s]) < 1e-6 for s in after)
    before = {r.s: r.rmsd for r in coordinates.rmsd(df, "s").collect()}
    assert all(before[s] >= got[s] - 1e-9 for s in after)


def test_radius_graph_matches_all_pairs(spark):
    p = points(60, 4)
    df = spark.createDataFrame([("s", i, *map(float, x)) for i, x in enumerate(p)], "s string, a int, x double, y double, z double")
    want = {(i, j) for i in range(60) for j in range(60) if i != j and np.linalg.norm(p[i] - p[j]) < 6.5}
    assert {(r.src, r.dst) for r in coordinates.radius_graph(df, "s", "a", 6.5).collect()} == want


def atoms_of(target, sample, chain, sequence, p):
    out = [(target, sample, chain, sequence, i, *map(float, x)) for i, x in enumerate(p)]
    return out if sample else [(r[0], *r[2:]) for r in out]


def test_symmetric_copies_are_told_apart(spark):
    p = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0], [0, 0, 3.0]])
    q = p + [9, 3, 1]
    r = turn(5)
    pred, true = [], []
    pred += atoms_of("t", "1", "A", "ACGU", q @ r.T + [100, -20, 4]) + atoms_of("t", "1", "B", "ACGU", p @ r.T + [100, -20, 4])
    true += atoms_of("t", None, "X", "ACGU", p) + atoms_of("t", None, "Y", "ACGU", q)
    pred += atoms_of("u", "1", "A", "ACGU", p) + atoms_of("v", "1", "A", "ACGU", p)
    true += atoms_of("u", None, "X", "ACGG", p) + atoms_of("v", None, "X", "ACGU", p) + atoms_of("v", None, "Y", "GG", p)
    side = "chain string, sequence string, seq_id int, x double, y double, z double"
    got = {r.target: r for r in assignment.mapping_options(spark.createDataFrame(pred, f"target string, sample string, {side}"), spark.createDataFrame(true, f"target string, {side}")).collect()}
    assert got["t"].mapping_key == "A:Y,B:X" and got["t"].rmsd < 1e-6
    assert got["u"].issue == "sequences differ" and got["v"].issue == "chain counts differ"


def test_cheapest_matches_all_permutations():
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 6):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        dealt = assignment.cheapest(cost)
        assert sorted(dealt) == list(range(n)) and abs(sum(cost[i, j] for i, j in enumerate(dealt)) - best) < 1e-9


def permuted_errors(pred, true):
    """The error of every mapping of equal sequences after the best motion, chain by chain."""
    out = {}
    names = sorted(pred)
    for order in itertools.permutations(sorted(true)):
        mapping = dict(zip(names, order, strict=True))
        if any(pred[a][0] != true[b][0] for a, b in mapping.items()):
            continue
        both = [(pred[a][1][i], true[b][1][i]) for a, b in mapping.items() for i in range(len(pred[a][1]))]
        p, q = (np.array(x) for x in zip(*both, strict=True))
        p, q = p - p.mean(axis=0), q - q.mean(axis=0)
        u, s, vt = np.linalg.svd(p.T @ q)
        s[2] *= np.sign(np.linalg.det(u @ vt))
        out[",".join(f"{a}:{b}" for a, b in sorted(mapping.items()))] = math.sqrt(max(0, ((p**2).sum() + (q**2).sum() - 2 * s.sum()) / len(p)))
    return out


def test_mappings_match_all_permutations(spark):
    rng = np.random.default_rng(12)
    side, pred_rows, true_rows, want = "chain string, sequence string, seq_id int, x double, y double, z double", [], [], {}
    for k in range(12):
        sequences_ = ["ACGU", "ACGU", "ACGU"] + (["GGCC", "GGCC"] if k % 2 else ["UUUU"])
        base = [rng.normal(size=(8, 3)) * 5 + rng.normal(size=3) * 20 for _ in sequences_]
        order, pred, true = rng.permutation(len(base)), {}, {}
        for i, (s, x) in enumerate(zip(sequences_, base, strict=True)):
            true[f"T{i}"] = (s, x)
        for i, j in enumerate(order):
            pred[f"P{i}"] = (sequences_[j], base[j] @ turn(k).T + [40, -9, 3] + rng.normal(size=(8, 3)) * (k % 3))
        for c, (s, x) in pred.items():
            pred_rows += [(f"t{k}", "1", c, s, i, *map(float, v)) for i, v in enumerate(x)]
        for c, (s, x) in true.items():
            true_rows += [(f"t{k}", c, s, i, *map(float, v)) for i, v in enumerate(x)]
        want[f"t{k}"] = permuted_errors(pred, true)
    got = assignment.mapping_options(spark.createDataFrame(pred_rows, f"target string, sample string, {side}").repartition(3), spark.createDataFrame(true_rows, f"target string, {side}"))
    for r in got.collect():
        best = min(want[r.target], key=want[r.target].get)
        assert (r.mapping_key, r.exact, r.issue) == (best, True, "") and abs(r.rmsd - want[r.target][best]) < 1e-6


def test_unlike_sequences_are_mapped_for_inspection(spark):
    p = points(6, 3)
    side = "chain string, sequence string, seq_id int, x double, y double, z double"
    pred = atoms_of("t", "1", "A", "ACGUAC", p) + atoms_of("t", "1", "B", "GGGGGG", p + [50, 0, 0])
    true = atoms_of("t", None, "X", "GGGGGC", p + [50, 0, 0]) + atoms_of("t", None, "Y", "ACGUAA", p)
    r, = assignment.mapping_options(spark.createDataFrame(pred, f"target string, sample string, {side}"), spark.createDataFrame(true, f"target string, {side}")).collect()
    assert (r.mapping_key, r.exact, r.issue) == ("A:Y,B:X", False, "sequences differ") and r.rmsd < 1e-6
    i = spark.createDataFrame([("t", "A", "X", 0.9), ("t", "A", "Y", 0.8), ("t", "B", "X", 0.85), ("u", "A", "X", 1.0), ("u", "B", "X", 1.0)], "target string, pred string, truth string, identity double")
    assert sorted((r.target, r.pred, r.truth, round(r.identity, 6), r.exact) for r in assignment.unequal_assignment(i).collect()) == [("t", "A", "Y", 0.8, False), ("t", "B", "X", 0.85, False)]


def test_percentiles_by_ranges_are_exact(spark, monkeypatch):
    rng = random.Random(4)
    rows_ = [(rng.choice("ab"), rng.choice([rng.random() * 1000, 7.0, NAN, None])) for _ in range(700)] + [(None, 1.0), (None, 2.0), ("c", None)]
    df = spark.createDataFrame(rows_, "k string, v double").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.k: r.percentiles for r in stats.percentiles(df, "v", ["k"], shares).collect()}
    want = {r.k: r.p for r in df.filter("v IS NOT NULL AND NOT isnan(v)").groupBy("k").agg(F.percentile("v", shares).alias("p")).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k], strict=True))
    one, = stats.percentiles(df, "v", [], shares).collect()
    all_, = df.filter("NOT isnan(v)").agg(F.percentile("v", shares).alias("p")).collect()
    assert all(abs(a - b) < 1e-9 for a, b in zip(one.percentiles, all_.p, strict=True))
    r = stats.describe(df, F.col("v"), "k").filter("k = 'c'").first()
    assert (r.n_total, r.n_with, r.p50) == (1, 0, None)
    every = lambda: [sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x.select(sorted(x.columns)).collect()) for x in (stats.describe(df, F.col("v"), "k"), stats.describe(df, F.col("v")), stats.distribution(df, F.col("v"), by="k"), stats.before_after(df, F.col("v"), F.col("v") + 1))]
    small = every()
    monkeypatch.setattr(stats, "IN_TASK_ROWS", 0)
    assert every() == small


def test_labels_follow_the_order_of_keys(spark):
    keys = [f"k{i:03}" for i in random.Random(1).sample(range(1000), 200)]
    got = {r.c: r.cluster_id for r in ranking.number_components(spark.createDataFrame([(k,) for k in keys * 2], "c string").repartition(7), "c").distinct().collect()}
    assert got == {k: f"cluster_{i:04}" for i, k in enumerate(sorted(keys), 1)}


def test_documents_are_compared_whole(spark):
    cases = [('{"a":1,"path":"x"}', '{"path":"y","a":1}', True), ('{"a":1,"b":2}', '{"a":1}', False), ("{bad", "{bad", None), ('{"a":[{"path":"1"},{"b":null}]}', '{"a":[{},{"b":null}]}', True), ('{"a":"\\"path\\":\\"x\\""}', '{"a":""}', False), ("[]", None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert [r.s for r in df.select("i", scalars.same_document(F.col("a"), F.col("b"), ["path"]).alias("s")).orderBy("i").collect()] == [c for *_, c in cases]


def test_three_failures_stop(spark):
    e = spark.createDataFrame([("w", i, f) for i, f in enumerate("fofffoff")] + [("v", i, f) for i, f in enumerate("ffo")], "w string, t int, s string")
    got = rows(ranking.until_failures(e, ["w"], ["t"], F.col("s") == "f").select("w", "t"), "w", "t")
    assert got == [("v", 0), ("v", 1), ("v", 2)] + [("w", i) for i in range(5)]


def test_consensus_breaks_ties(spark):
    o = spark.createDataFrame([("t", c, "k1", 1.0) for c in "abc"] + [("t", "d", "k2", 0.5), ("t", "d", "k1", 0.5)], "target string, cand string, key string, rmsd double")
    got = {r.cand: (r.key, r.tie_break) for r in ranking.consensus(o, "cand", "target", "key", "rmsd").collect()}
    assert got["d"] == ("k1", True) and got["a"] == ("k1", False)


def test_window_mean(spark):
    w = spark.createDataFrame([("s", 0, [[1.0, 2.0], [3.0, 4.0]]), ("s", 1, [[5.0, 6.0], [7.0, 8.0]])], "k string, start int, v array<array<double>>")
    got = rows(coordinates.window_mean(w, "k", "start", "v").select("place", "mean", "coverage"), "place")
    assert got == [(0, [1.0, 2.0], 1), (1, [4.0, 5.0], 2), (2, [7.0, 8.0], 1)]
    odd = spark.createDataFrame([(None, 3, [[1.0], None, [2.0]]), (None, 3, []), ("a", None, [[1.0]]), ("a", 0, None), ("b", 5, [[None]])], w.schema)
    got = {(r.k, r.place): (r["mean"], r.coverage) for r in coordinates.window_mean(odd, "k", "start", "v").collect()}
    assert got[None, 3] == ([1.0], 1) and got[None, 5] == ([2.0], 1) and math.isnan(got["b", 5][0][0]) and len(got) == 3
    with pytest.raises(Exception, match="unlike lengths"):
        coordinates.window_mean(spark.createDataFrame([("s", 0, [[1.0, 2.0], [3.0]])], w.schema).coalesce(1), "k", "start", "v").collect()
    assert coordinates.window_mean(w.limit(0), "k", "start", "v").count() == 0


def test_window_mean_shuffles_places(spark, monkeypatch):
    """Many batches: rows of a place meet over batches, and no more of them than places and batches are shuffled."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4, 8))
    w = spark.createDataFrame([(i % 3, int(i % 7), x[i].tolist()) for i in range(300)], "k int, start int, v array<array<double>>").repartition(3)
    want = {}
    for i in range(300):
        for j in range(4):
            want.setdefault((i % 3, i % 7 + j), []).append(x[i, j])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        got = {(r.k, r.place): (r["mean"], r.coverage) for r in coordinates.window_mean(w, "k", "start", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want) and all(n == len(want[k]) and np.allclose(m, np.mean(want[k], axis=0)) for k, (m, n) in got.items())


def test_dense_cells_are_split(spark, monkeypatch):
    """Half of the atoms in one cell: the same pairs, and no task's share of a cell much over CELL_ATOMS."""
    monkeypatch.setattr(coordinates, "CELL_ATOMS", 20)
    p = np.concatenate([np.random.default_rng(5).uniform(0, 1, size=(150, 3)), points(150, 6)])
    df = spark.createDataFrame([("s", i, *map(float, x)) for i, x in enumerate(p)] + [("s", 999, None, 1.0, 1.0)], "s string, a int, x double, y double, z double").repartition(4)
    want = {(i, j) for i in range(300) for j in range(300) if i != j and np.linalg.norm(p[i] - p[j]) < 1.1}
    got = coordinates.radius_graph(df, "s", "a", 1.1).collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want)
    home, away, keys = coordinates.gridded(df.dropna(), "s", "a", 1.1)
    shares = [r["count"] for r in home.groupBy(*keys).count().collect()]
    assert max(shares) < 3 * 20 and sum(shares) == 300


def test_ecdf_of_many_ties(spark, monkeypatch):
    monkeypatch.setattr(stats, "TIES", 7)
    values = [1.0] * 50 + [2.0] * 7 + [3.0, float("nan"), None] + [4.0] * 8
    df = spark.createDataFrame([(v,) for v in values], "v double")
    clean = sorted(v for v in values if v is not None and v == v)
    assert rows(stats.ecdf(df, "v"), "y") == [(v, (i + 1) / len(clean)) for i, v in enumerate(clean)]
    # three billion of one value: runs of ranks, no row with an array of all
    monkeypatch.undo()
    runs = spark.sql("SELECT 3000000000 AS n").select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / stats.TIES))).alias("run"))
    assert runs.count() == 30_000


def test_paths_by_order(spark):
    e = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("b", 1, None), ("c", 0, "q")], "k string, place int, path string")
    f = spark.createDataFrame([("a", "x", None), ("a", "m", None), ("b", "n", 0), ("c", None, 1)], "k string, path string, folder int")
    got = {(r.k, r.place): (r.resolved, r.status) for r in joins.resolve_paths_in_order(e, f, "k").collect()}
    assert got == {("a", 0): ("x", "DIRECT"), ("a", 1): ("x", "REBASED"), ("b", 0): ("n", "REBASED"), ("b", 1): (None, "MISSING"), ("c", 0): (None, "MISSING")}


def test_results_dont_depend_on_partitions(spark):
    pdf = pd.DataFrame({"pdb_id": [f"t{i % 17}" for i in range(500)], "seed": [i % 5 for i in range(500)], "sample": range(500), "ranking_score": [round((i * 37 % 101) / 7, 2) for i in range(500)], "rmsd": [float(i % 13) for i in range(500)]})
    one, many = (rows(ranking.rank1(spark.createDataFrame(pdf.sample(frac=1, random_state=n)).repartition(n)), "pdb_id") for n in (1, 9))
    assert one == many
