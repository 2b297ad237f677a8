import datetime as dt
import os
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixlake.operators import joins
from helixlake.plans import q_streaming
from helixlake.sources import readers, sinks, structures
from helixlake.sources.shared import shared_folder
from helixlake.streaming import progress as P

CIF = """data_1ABC
# a comment
_struct.title 'O5'x pairs "here"'
_exptl.method
;X-RAY
DIFFRACTION
;
loop_
_entity_poly.entity_id
_entity_poly.type
_entity_poly.pdbx_strand_id
1 polyribonucleotide 'A,B'
2 . ?
loop_
_atom_site.label_atom_id
_atom_site.Cartn_x
"O5'" 1.5
P -2.0
C
"""


def test_structure_tokens_and_tables(spark):
    long = structures.items(spark.createDataFrame([("f", CIF), ("g", ""), ("h", None)], "path string, text string"))
    assert structures.table_of(long, "struct").first().title == "O5'x pairs \"here\""
    assert structures.table_of(long, "exptl").first().method == "X-RAY\nDIFFRACTION"
    assert [(r.entity_id, r.type, r.pdbx_strand_id) for r in structures.table_of(long, "entity_poly").orderBy("row_no").collect()] == [("1", "polyribonucleotide", "A,B"), ("2", None, None)]
    assert [tuple(r) for r in structures.issues(long).collect()] == [("f", "1ABC", "atom_site", "5 values in a loop of 2 columns")]


def test_structure_files_are_read(spark):
    d = tempfile.mkdtemp()
    open(f"{d}/a.cif", "w").write("data_A\r\nloop_\n_entity.id\n_entity.pdbx_description\n1 'x y' 2\n;two\nlines\n; 3 a#b # no\ndata_B\n_entry.id B\n;open\n")
    open(f"{d}/b.txt", "w").write("data_C\n_entry.id C\n")
    blocks = structures.read_items(spark, d)
    assert [(r.block, r.id, r.pdbx_description) for r in structures.table_of(blocks, "entity").orderBy("row_no").collect()] == [("A", "1", "x y"), ("A", "2", "two\nlines"), ("A", "3", "a#b")]
    assert [(r.block, r.id) for r in structures.table_of(blocks, "entry").collect()] == [("B", "B")] and structures.issues(blocks).isEmpty()


def test_id_and_exclusion_lists(spark):
    d = tempfile.mkdtemp()
    open(f"{d}/ids.csv", "w").write("PDB_ID,x\n1abc,1\n\n2ABC,1\n1ABC,2\n")
    got = [(r.pdb_id, r.n) for r in readers.id_list(spark, f"{d}/ids.csv").orderBy("ord").collect()]
    assert got == [("1ABC", 2), ("2ABC", 1)]
    open(f"{d}/ex.txt", "w").write("# frozen\n1abc # why\nbad id\n")
    with pytest.raises(ValueError):
        readers.exclusion_list(spark, f"{d}/ex.txt")
    assert [r[0] for r in readers.exclusion_list(spark, f"{d}/ex.txt", strict=False).collect()] == ["1ABC"]
    open(f"{d}/meta.tsv", "w").write("pdb_ID\tdate\n1abc\t2024-02-03\n")
    m = readers.metadata(readers.delimited(spark, f"{d}/meta.tsv"), "PDB_ID", "DATE", F.try_to_date)
    assert tuple(m.first()) == ("1ABC", dt.date(2024, 2, 3))


def test_inventory(spark):
    d = tempfile.mkdtemp()
    import os

    os.makedirs(f"{d}/sub/quarantine")
    for p in ("1abc.CIF", "sub/2ABC.cif", "sub/quarantine/3abc.cif", "x.cif"):
        open(f"{d}/{p}", "w").write("data_")
    files = readers.listing(spark, d)
    ids = spark.createDataFrame([("1ABC",), ("2ABC",), ("3ABC",), ("4ABC",)], "pdb_id string")
    alias = spark.createDataFrame([("X", "4ABC")], "alias string, pdb_id string")
    assert sorted(r.pdb_id for r in readers.inventory(files, ids, alias).collect()) == ["1ABC", "2ABC", "4ABC"]
    assert {r.kind for r in readers.document_kind(files, {"struct": ".cif"}).collect()} == {"struct"}
    with pytest.raises(joins.DuplicateKey):
        readers.unique_stems(files.unionByName(files)).count()


def test_tasks_with_issues(spark):
    docs = [("a", '[{"name":"a","sequences":[{"rnaSequence":{"sequence":"AUCG","count":2,"unpairedMsaPath":"/x"}},{"rnaSequence":{"sequence":"AAA"}},{"ligand":{}}]}]'), ("b", "{nope"), ("c", None), ("d", "[]"), ("e", '[{"name":"e","sequences":[{"ligand":{}}]}]')]
    chains, issues = readers.task_chains(spark.createDataFrame(docs, "k string, t string"), "k", "t")
    assert sorted((r.k, r.entry_no, r.copy_no, r.sequence) for r in chains.collect()) == [("a", 0, 1, "AUCG"), ("a", 0, 2, "AUCG"), ("a", 1, 1, "AAA")]
    assert {r.k: r.issue for r in issues.collect()} == {"b": "unreadable document", "c": "unreadable document", "d": "unreadable document", "e": "no RNA chain"}


def test_alignments(spark):
    texts = [("ok", ">q\nAC-gu\nGU\n>r\nACGUGU\n"), ("early", "x\n>q\nA"), ("empty", ">q\n>r\nA"), ("none", "")]
    got = {r.k: (r.depth, r.query, r.issue) for r in readers.alignment_audit(spark.createDataFrame(texts, "k string, t string"), "k", "t").collect()}
    assert got == {"ok": (2, "ACGU", None), "early": (1, "A", "text before the first record"), "empty": (2, "", "empty record"), "none": (0, None, "no record")}


def test_metric_contract(spark):
    m = spark.createDataFrame([(i,) for i in range(6)], "k int")
    outs = [(1, "{bad"), (2, '{"status":"FAILURE","rmsd":1}'), (3, '{"status":"SUCCESS","rmsd":"NaN"}'), (4, '{"status":"SUCCESS","rmsd":-1}'), (5, '{"status":"success","rmsd":0,"lddt":0.5}')]
    got = [(r.eval_status, r.rmsd) for r in readers.candidate_metrics(m, spark.createDataFrame(outs, "k int, t string"), ["k"], "t").orderBy("k").collect()]
    assert got == [("missing_output", None), ("invalid_output", None), ("ost_failure", None), ("invalid_output", None), ("invalid_output", None), ("SUCCESS", 0.0)]


def test_release_dates(spark):
    rev = spark.createDataFrame([("a", "2", "2020-01-01"), ("a", "1", "2021-01-01"), ("b", "?", "2019-01-01"), ("c", "1", "?"), ("d", "1", "2999-01-01"), ("e", "1", "2020-01-01")], "k string, o string, d string")
    legacy = spark.createDataFrame([("c", dt.date(2018, 1, 1)), ("e", dt.date(2020, 1, 2))], "k string, legacy_date date")
    got = {r.k: (str(r.release_date), r.source, r.issue) for r in readers.release_dates(readers.revisions(rev, "k", "o", "d"), legacy, "k", F.lit("2030-01-01").cast("date")).collect()}
    assert got == {"a": ("2021-01-01", "revision", None), "b": ("2019-01-01", "revision", None), "c": ("2018-01-01", "legacy", None), "d": ("2999-01-01", "revision", "date in the future"), "e": ("2020-01-01", "revision", "date conflict")}


def test_sequence_files_with_marks_in_headers(spark):
    d = tempfile.mkdtemp()
    open(f"{d}/x.fasta", "w").write(">1ABC__1 a > b\nAC\nGU\n>2ABC__x>y\r\nGG\r\n")
    assert sorted(map(tuple, readers.fasta(spark, d).collect())) == [("1ABC", "1 a > b", "ACGU"), ("2ABC", "x>y", "GG")]


def test_first_models(spark):
    rows = [("n", "2", 0), ("n", "1", 1), ("t", None, 0), ("t", "b", 1), ("t", "a", 2), ("m", "x", 0), ("m", "7", 1)]
    got = readers.first_model(spark.createDataFrame(rows, "k string, model string, i int"), "k", "model", "i")
    assert sorted((r.k, r.model) for r in got.collect()) == [("m", "7"), ("n", "1"), ("t", "b")]


def test_shared_folder_of_a_cluster_has_to_be_named():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context, Conf()

    with pytest.raises(ValueError):
        shared_folder(Session)


def test_sinks(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("1ABC", "a b", "ACGU", None), ("1ABC", "c", "GG", 2)], "e string, n string, s string, x int")
    assert [r.value for r in sinks.fasta_rows(df, "e", "n", "s").orderBy("record").collect()] == [">1ABC__a_b\nACGU", ">1ABC__c\nGG"]
    sinks.write_tables(d, one=df, two=df.limit(0))
    assert spark.read.parquet(f"{d}/one").count() == 2 and spark.read.parquet(f"{d}/two").count() == 0
    for _ in range(2):
        sinks.append_events(df, f"{d}/log")
    assert spark.read.json(f"{d}/log").count() == 4
    sinks.write_by(df, f"{d}/by", "n")
    assert spark.read.parquet(f"{d}/by").count() == 4 - 2


def test_streams_agree_with_batch(spark):
    d = tempfile.mkdtemp()
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=i * 7 % 5000), f"w{i % 5}", ["run", "failed", "complete"][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, worker string, state string")
    df.repartition(4).write.parquet(f"{d}/in")
    now = F.lit(base + dt.timedelta(seconds=5100))
    states = {r.worker: r.status for r in P.liveness(df.filter("state = 'run'"), "worker", "ts", "state", now, 120).collect()}
    assert set(states.values()) <= {"FRESH", "STALE"} and len(states) == 5
    done = P.progress(df, 500, "ts", F.col("state") == "complete").first()
    assert (done.done, done.remaining) == (100, 400)
    assert P.resume(df.select("id"), df, ["id"], F.col("state") == "complete").count() == 200


def test_backfills_over_many_files_agree_with_batch(spark):
    d, base = tempfile.mkdtemp(), dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=i * 7919 % 2_592_000), i % 9, ["view", "error", "complete"][i % 3], 1.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(80).write.parquet(f"{d}/events.parquet")
    assert len([x for x in os.listdir(f"{d}/events.parquet") if x.startswith("part-")]) > 64
    for stream, twin in ((q_streaming.stream_windowed_progress, q_streaming.windowed_progress), (q_streaming.stream_sessions, q_streaming.worker_sessions)):
        assert sorted(map(tuple, stream(spark, d).collect())) == sorted(map(tuple, twin(spark, d).collect()))
    end = max(r[1] for r in rows)
    want = {(str(r.user_id), r.last_seen, r.status) for r in P.liveness(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_type", F.lit(end), 3600).collect()}
    got = [tuple(r) for r in q_streaming.stream_liveness(spark, d).withColumn("last_seen", F.col("last_seen").cast("timestamp")).collect()]
    stale = {(w, t) for w, t, s in got if s == "STALE"}
    assert {(w, t, s) for w, t, s in got if s != "FRESH" or (w, t) not in stale} == want and len({w for w, *_ in got}) == 9


def test_ids_in_the_order_of_files_and_splits(spark, tmp_path):
    """Several files in many splits: first-seen order is that of the files' lines."""
    rng, lines = random.Random(4), []
    for k in range(4):
        own = [f"{rng.randrange(10**4):04}" for _ in range(3_000)]
        (tmp_path / f"part-{k}.txt").write_text("pdb_id,x\n" + "".join(f"{x},{i}\n" for i, x in enumerate(own)))
        lines += own
    seen = list(dict.fromkeys(lines))
    for conf, value in (("spark.sql.files.maxPartitionBytes", "4096"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(conf, value)
    try:
        got = readers.id_list(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        found = got.orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.pdb_id for r in found] == seen and [r.ord for r in found] == list(range(len(seen)))
    assert {r.pdb_id: r.n for r in found} == Counter(lines)
