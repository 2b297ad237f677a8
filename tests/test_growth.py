"""What doesn't grow with the tables: files, batches, passes."""

import os

from helixlake.plans import catalog
from helixlake.sources import structures

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_blocks_leave_one_by_one():
    blocks = structures._Reader(frozenset({"struct"})).read("data_a\n_struct.title x\ndata_b\nloop_\n_struct.title\n'1 2'\n3\n#\nloop_\n_q.a\n_q.b\n1\n")
    assert next(blocks) == ("a", {"struct": {"title": ["x"]}}, [])
    assert list(blocks) == [("b", {"struct": {"title": ["1 2", "3"]}}, [("q", "1 values in a loop of 2 columns")])]


def files_of(monkeypatch, spark, tmp_path, name, **limits):
    from helixlake.plans import q_sources

    for limit, value in limits.items():
        monkeypatch.setattr(q_sources, limit, value, raising=False)
    monkeypatch.setattr(q_sources, "_folder", lambda _spark, _name: f"file://{tmp_path}/{name}")
    n = catalog.QUERIES[name](spark, SF).count()
    files = [x for x in os.listdir(tmp_path / name) if x.startswith("part-")]
    return n, len(files), [open(tmp_path / name / x).read().count("data_") for x in files]


def test_structure_files_are_bounded(spark, monkeypatch, tmp_path):
    n, files, blocks = files_of(monkeypatch, spark, tmp_path, "structure_files", FILE_BLOCKS=100)
    assert n > 1_000 and files > 10 and max(blocks) <= 100


def test_structure_issues_reads_no_atoms(spark):
    plan = catalog.QUERIES["structure_issues"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "atom_site#" not in plan and "entry#" in plan


def test_structure_manifest_reads_texts_once(spark):
    plan = catalog.QUERIES["structure_manifest"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1


def test_structure_splits_writes_in_parallel(spark, monkeypatch, tmp_path):
    n, files, blocks = files_of(monkeypatch, spark, tmp_path, "structure_splits", SPLIT_FILE_BLOCKS=500)
    assert n > 1_000 and files == 3 and sum(blocks) == 1_473


def test_unequal_assignment_by_batches(spark):
    import itertools
    import random

    from helixlake.operators import assignment

    rng = random.Random(5)
    best = {(f"t{k}", f"p{i}", f"q{j}"): rng.random() for k in range(60) for i in range(k % 4 + 1) for j in range(k % 4 + (1 if k % 5 else 2))}
    df = assignment.unequal_assignment(spark.createDataFrame([(*k, v) for k, v in best.items()] + [("t1", "p0", "q0", 0.0)], "target string, pred string, truth string, identity double"))
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().analyzed().toString()
    want = set()
    for k in range(60):
        n = k % 4 + 1
        if k % 5:
            way = max(itertools.permutations(range(n)), key=lambda m: sum(best[f"t{k}", f"p{i}", f"q{j}"] for i, j in enumerate(m)))
            want |= {(f"t{k}", f"p{i}", f"q{j}", round(best[f"t{k}", f"p{i}", f"q{j}"], 9)) for i, j in enumerate(way)}
    assert {(r.target, r.pred, r.truth, round(r.identity, 9)) for r in df.collect()} == want


def test_chain_assignment_takes_the_nearer_of_close_mappings(spark, tmp_path):
    """Of two mappings whose errors differ by less than a millionth the lesser wins, as in SQL."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    def error(p, t):
        p, t = p - p.mean(0), t - t.mean(0)
        u, s, vt = np.linalg.svd(p.T @ t / len(p))
        s[2] *= np.sign(np.linalg.det(u @ vt))
        return np.sqrt(max(0, (p * p).sum() / len(p) + (t * t).sum() / len(p) - 2 * s.sum()))

    rng = np.random.default_rng(3)
    ref = rng.normal(size=64).astype(np.float32)
    points = lambda v: 10 * v[:63].astype(float).reshape(21, 3)
    swapped = np.concatenate([ref[30:60], ref[:30], ref[60:]]) + rng.normal(size=64).astype(np.float32) / 10
    gap = lambda v: error(points(v), points(ref)) - error(points(v)[:20], np.roll(points(ref)[:20], 10, axis=0))
    low, high, close = 0.0, 1.0, []
    for _ in range(60):
        t = (low + high) / 2
        v = ((1 - t) * ref + t * swapped).astype(np.float32)
        low, high = (low, t) if gap(v) > 0 else (t, high)
        close += [v] if 1e-8 < abs(gap(v)) < 9e-7 else []
    assert close
    rows = [ref, ref + np.float32(0.01), swapped, *close]
    pq.write_table(pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array([v.tolist() for v in rows], pa.list_(pa.float32())), "label": pa.array([1] * len(rows), pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    columns = ["target", "sample", "mapping_key", "rmsd", "support", "tie_break"]
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES['chain_assignment']})").fetchall())
    assert sorted(map(tuple, catalog.QUERIES["chain_assignment"](spark, str(tmp_path)).select(*columns).collect())) == want


def test_main_table_counts_values_before_it_deals_them_to_sections(spark, monkeypatch):
    from helixlake.operators import stats

    df = spark.range(6000).selectExpr("CAST(id % 7 AS DOUBLE) AS v", "id % 11 = 0 AS x", "IF(id % 3 = 0, 'post_cutoff', 'pre') AS t", "CAST(id % 2 AS STRING) AS l", "IF(id % 5 = 0, NULL, CAST(id % 5 AS STRING)) AS c")
    written, write = [], stats.write_shared
    monkeypatch.setattr(stats, "write_shared", lambda rows, name: written.append(write(rows, name)) or written[-1])
    once = {(r.section, r.group): r for r in stats.main_table(df, "v", "x", "t", "l", "c").collect()}
    assert written[0].count() <= 9 * 8  # nine groups, seven values and null
    monkeypatch.setattr(stats, "IN_TASK_ROWS", 10)
    assert {(r.section, r.group): r for r in stats.main_table(df, "v", "x", "t", "l", "c").collect()} == once
    rows = [r for r in df.collect() if r.c is None]
    good = sorted(r.v for r in rows if not r.x)
    got = once["chains", "missing"]
    assert (got.n_total, got.n_valid, got["median"], got["max"]) == (len(rows), len(good), (good[(len(good) - 1) // 2] + good[len(good) // 2]) / 2, 6.0)
    assert abs(got.mean - sum(good) / len(good)) < 1e-9 and abs(got.pct_le_2 - 100 * sum(v <= 2 for v in good) / len(good)) < 1e-9


def test_chain_map_reads_each_table_once(spark):
    from helixlake.plans import audits

    a = spark.createDataFrame([("p", "A", "ACGU"), ("p", "B", "AC"), ("q", "A", "AC"), ("q", "B", "G"), ("r", "A", "C"), (None, "A", "C")], "pdb_id string, chain_id string, sequence string")
    b = spark.createDataFrame([("p", "X", "ACGU"), ("p", "Y", "AG"), ("q", "X", "AC"), ("r", "X", "U"), ("r", "Y", "UU"), (None, "X", "G")], "pdb_id string, chain_id string, sequence string")
    got = audits.base_chain_map(a, b, spark.createDataFrame([(x, True) for x in "pqr"], "pdb_id string, consistent boolean"))
    rows = {(r.pdb_id, r.chain_a, r.chain_b, r.status, r.identity) for r in got["map"].collect()}
    want = {("p", "A", "X", "EXACT_UNIQUE", 1.0), ("p", "B", "Y", "RESIDUAL", 0.5), ("q", "A", "X", "EXACT_UNIQUE", 1.0), ("q", "B", None, "NO_MATCH", None)}
    want |= {("r", "A", None, "NO_MATCH", None), ("r", None, "X", "NO_MATCH", None), ("r", None, "Y", "NO_MATCH", None), (None, "A", None, "NO_MATCH", None), (None, None, "X", "NO_MATCH", None)}
    assert rows == want
    assert {r.pdb_id: r.reasons for r in got["targets"].collect()} == {"p": "unique_sequences", "q": "unique_sequences;complete", "r": "unique_sequences;complete", None: "unique_sequences;complete;consistent"}
    assert got["targets"]._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3


def test_atoms_of_small_samples_go_out_once(spark):
    from helixlake.operators import coordinates

    xyz = [((7 * i) % 5 / 2, (3 * i) % 4 / 2, i % 7 / 2) for i in range(70)]
    df = spark.createDataFrame([(s, i, *xyz[i]) for s, n in ((1, 20), (2, 64), (3, 70)) for i in range(n)], "s int, a int, x double, y double, z double")
    home, away, _ = coordinates.gridded(df, "s", "a", 1.1)
    count = lambda rows: {r["sample"]: r["count"] for r in rows.groupBy("sample").count().collect()}
    assert count(home) == {1: 20, 2: 64, 3: 70} and count(away) == {1: 20, 2: 64, 3: 14 * 70}
    near = lambda p, q: sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) < 1.1 * 1.1
    want = sorted((s, i, j) for s, n in ((1, 20), (2, 64), (3, 70)) for i in range(n) for j in range(n) if i != j and near(xyz[i], xyz[j]))
    assert sorted(map(tuple, coordinates.radius_graph(df, "s", "a", 1.1).collect())) == want


def test_an_entity_meets_its_best_hit_only(spark, monkeypatch):
    from datetime import date

    from helixlake.operators import graph
    from helixlake.plans import audits

    known = [("p", str(i), ["A"], "ACGTACGTAC"[:9] + c, date(2020, 1, 1), 1.0) for i, c in enumerate("ACGTN")]
    copies = [("q", str(i), ["A"], "ACGTACGTAC", date(2024, 1, 1), 1.0) for i in range(6)]
    df = spark.createDataFrame(known + copies, "pdb_id string, entity_id string, chain_ids array<string>, sequence string, release_date date, resolution double")
    hits, mask = [], graph.mask_redundant
    monkeypatch.setattr(graph, "mask_redundant", lambda rows, reference, *rest: hits.append(reference) or mask(rows, reference, *rest))
    got = audits.split_and_mask(df, date(2021, 1, 1), date(2022, 1, 1))["entities"].collect()
    assert hits[0].count() == 6
    assert {(r.key, r.status, r.match) for r in got} == {(f"q#{i}", "MASK_REFERENCE", "p#1") for i in range(6)}


def test_last_events_of_pieces(spark, monkeypatch):
    from helixlake.streaming import progress

    df = spark.createDataFrame([(w, i, f"s{i}") for i in (3, 9, 1, 7) for w in ("a", None, "b")], "w string, t long, s string").coalesce(1).selectExpr("w", "timestamp_seconds(t) AS t", "s")
    assert {(r.w, r.s) for r in progress.last_of_pieces(df, "w", "t", "s").collect()} == {(w, "s9") for w in ("a", None, "b")}
    assert progress.last_of_pieces(df, "w", "t", "s").count() == 3
