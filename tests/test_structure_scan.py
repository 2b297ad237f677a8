"""Files read by splits against the parser of whole files."""

import random

import pytest

from helixlake.sources import structure_scan, structures


def made(rng, atoms):
    """A block with all that can lie on a cut: texts of many lines, rows over several lines, comments, items,
    and categories that nobody wants."""
    out = [f"data_{rng.randrange(10**6)}", "_entry.id X1", "_struct.title", ";a title", "of lines", "_not.a name", "loop_ and data_none", ";"]
    out += ["loop_", "_entity.id", "_entity.pdbx_description"]
    for i in range(rng.randint(0, 30)):
        out += rng.choice([[f"{i} 'it''s'"], [f"{i}", ";text", f"line {i}", "", ";"], [f"{i} ?"], [str(i), '"a b" # said']])
    out += ["loop_", "_other.a", "_other.b", "1 2", "3 4", "#"]
    out += ["loop_", *[f"_atom_site.{c}" for c in ("group_PDB", "Cartn_x", "unknown", "label_atom_id")]]
    for i in range(atoms):
        row = ["ATOM", f"{i}.5", rng.choice([".", "'x y'"]), rng.choice(["C1'", '"O5\'"', "?"])]
        if rng.random() < 0.05:
            k = rng.randint(1, 3)
            out += [" ".join(row[:k]), " ".join(row[k:])]
        elif rng.random() < 0.03:
            out += [" ".join(row[:3]), ";P", "Q\r", ";"]
        else:
            out.append(" ".join(row))
    if rng.random() < 0.2:
        out.append("ATOM 1.0")
    out += ["_exptl.method", rng.choice(["'X-RAY DIFFRACTION'", "NMR", "\n;text\r\nof two\n;"]), rng.choice(["save_x", "#", ""])]
    return rng.choice(["\n", "\n", "\r\n"]).join(out)


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_equal_to_whole_files(spark, tmp_path, split):
    rng = random.Random(split)
    for name, blocks in (("a", 1), ("b", 6), ("c", 3), ("d", 0)):
        text = "\n".join(made(rng, rng.choice([3, 60])) for _ in range(blocks))
        (tmp_path / f"{name}.cif").write_bytes((text + rng.choice(["", "\n", "\n_entry.id Z\n;open"])).encode())
    (tmp_path / "e.txt").write_text("data_no\n_entry.id no\n")
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    blocks = structures.read_items(spark, str(tmp_path))
    want = {c: sorted(map(str, structures.table_of(blocks, c).collect())) for c in ("atom_site", "entity", "struct", "exptl", "entry")}
    bad = sorted(map(str, (r for r in structures.issues(blocks).collect() if r.category == "atom_site")))
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        for category in want:
            rows, issues = structure_scan.scan(spark, str(tmp_path), category)
            got = rows.select("path", "block", "row_no", *structures.TABLES[category]).withColumn("row_no", rows.row_no.cast("int"))
            plain = sorted(str(r).replace("file:///", "file:/") for r in got.collect())
            assert plain == [w.replace("file:///", "file:/") for w in want[category]], category
            if category == "atom_site":
                assert sorted(str(r).replace("file:///", "file:/") for r in issues.collect()) == [b.replace("file:///", "file:/") for b in bad]
    finally:
        for c in conf:
            spark.conf.unset(c)


def test_one_loop_by_several_tasks(spark, tmp_path):
    """A million atoms in one loop: many tasks have a share of its rows."""
    names = "\n".join(f"_atom_site.{i}" for i in structures.TABLES["atom_site"])
    n = 1_000_000
    with open(tmp_path / "big.cif", "w") as f:
        f.write(f"data_BIG\nloop_\n{names}\n")
        f.writelines(f"ATOM C C1' . A A {i} A {i % 100}.25 0.5 0.125 1.00 1\n" for i in range(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows, issues = structure_scan.scan(spark, str(tmp_path), "atom_site")
        got = rows.selectExpr("count(*)", "count(DISTINCT row_no)", "max(row_no)", "sum(CAST(Cartn_x AS double))", "count_if(row_no <> CAST(label_seq_id AS long))").first()
        assert tuple(got) == (n, n, n - 1, sum(i % 100 + 0.25 for i in range(n)), 0) and issues.isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
