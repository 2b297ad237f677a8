"""Source and sink rules over documents that Spark makes of the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixlake.functions import scalars as S
from helixlake.operators import joins
from helixlake.sources import readers, sinks, structure_scan, structures
from helixlake.sources.shared import shared_folder

from .registry import query, table


#: Structure texts of a file that is read whole, and of one that is read by splits (some 750 bytes each).
FILE_BLOCKS, SPLIT_FILE_BLOCKS = 10_000, 500_000


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _tasks(spark, d):
    """A task document for each brand: its parts' names, p_size % 3 + 1 copies of each."""
    p = table(spark, d, "part")
    job = F.struct(F.lit("job").alias("name"), F.array_sort(F.collect_list(F.struct(F.struct(F.col("p_name").alias("sequence"), (F.col("p_size") % 3 + 1).alias("count"), F.concat(F.lit("/m/"), F.col("p_partkey").cast("string")).alias("unpairedMsaPath")).alias("rnaSequence")))).alias("sequences"))
    doc = p.groupBy("p_brand").agg(F.to_json(F.array(job)).alias("doc"))
    return doc.withColumn("doc", F.when(F.col("p_brand") == "Brand#3", "{broken").when(F.col("p_brand") == "Brand#4", '[{"name": "x", "sequences": [{"ligand": {}}]}]').otherwise(F.col("doc")))


@query("SELECT p_brand, p_name AS sequence, '/m/' || p_partkey AS msa_path, unnest(range(1, p_size % 3 + 2))::INT AS copy_no FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#4')")
def task_chains(spark, d):
    return readers.task_chains(_tasks(spark, d), "p_brand", "doc")[0].drop("entry_no")


@query("SELECT DISTINCT p_brand, CASE p_brand WHEN 'Brand#3' THEN 'unreadable document' ELSE 'no RNA chain' END AS issue FROM part WHERE p_brand IN ('Brand#3', 'Brand#4')")
def task_issues(spark, d):
    return readers.task_chains(_tasks(spark, d), "p_brand", "doc")[1]


@query("""
SELECT event_id, CASE WHEN value < 2 THEN 'missing_output' WHEN event_id % 9 = 1 THEN 'invalid_output' WHEN event_type = 'error' THEN 'ost_failure' WHEN event_id % 9 = 2 THEN 'invalid_output' ELSE 'SUCCESS' END AS eval_status,
  CASE WHEN value >= 2 AND event_id % 9 NOT IN (1, 2) AND event_type <> 'error' THEN value END AS rmsd FROM events""")
def metric_status(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 9
    doc = F.when(k == 1, "{broken").otherwise(F.concat(F.lit('{"status": "'), F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS"), F.lit('", "rmsd": '), F.when(k == 2, F.lit('"NaN"')).otherwise(F.col("value").cast("string")), F.lit("}")))
    got = readers.candidate_metrics(e.select("event_id"), e.filter("value >= 2").select("event_id", doc.alias("doc")), ["event_id"], "doc")
    return got.select("event_id", "eval_status", "rmsd")


@query("SELECT event_id, CASE WHEN event_id % 4 > 1 THEN (props->>'$.k')::DOUBLE END AS ranking_score, CASE event_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'no finite ranking_score' END AS score_issue FROM events")
def confidence_scores(spark, d):
    k = F.col("event_id") % 4
    doc = F.when(k == 0, None).when(k == 1, '{"ranking_score": "NaN"}').otherwise(F.concat(F.lit('{"ranking_score": '), F.get_json_object("props", "$.k"), F.lit("}")))
    return readers.confidence_scores(table(spark, d, "events").select("event_id", doc.alias("doc")), "doc").drop("doc")


@query(r"""
WITH t AS (SELECT item_id, replace(text, '>', ' ') AS text FROM benchmark)
SELECT item_id, 2 AS depth, regexp_replace(regexp_replace(text, '\s', '', 'g'), '[a-z.-]', '', 'g') AS query, sha256('>q' || chr(10) || text || chr(10) || '>r' || chr(10) || CASE WHEN item_id % 3 = 0 THEN '' ELSE 'ACGU' END) AS sha256,
  CASE WHEN item_id % 3 = 0 THEN 'empty record' END AS issue FROM t""")
def alignment_audit(spark, d):
    text = F.concat(F.lit(">q\n"), F.replace("text", F.lit(">"), F.lit(" ")), F.lit("\n>r\n"), F.when(F.col("item_id") % 3 == 0, "").otherwise("ACGU"))
    return readers.alignment_audit(table(spark, d, "benchmark").select("item_id", text.alias("t")), "item_id", "t")


@query(r"SELECT 'P' || p_partkey AS pdb_id, regexp_replace(p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS entity, replace(p_name, ' ', '') AS sequence FROM part")
def fasta_round_trip(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entry"), "p_brand", "p_name")
    path = _folder(spark, "fasta")
    sinks.write_fasta(p, path, "entry", "p_brand", "p_name")
    return readers.fasta(spark, path)


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, CASE WHEN p_size > 25 THEN NULL ELSE p_size::VARCHAR END AS p_size FROM part")
def report_round_trip(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") <= 25, F.col("p_size")).alias("p_size"))
    path = _folder(spark, "report")
    sinks.write_report(p, path, ["p_partkey", "p_name", "p_size"])
    return spark.read.option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


@query("SELECT o_custkey, '{' || string_agg('\"' || o_orderkey || '\":\"' || o_orderstatus || '\"', ',' ORDER BY o_orderkey::VARCHAR) || '}' AS mask FROM orders GROUP BY 1")
def mask_documents(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("chain"), "o_orderstatus")
    return sinks.mask_documents(o, "o_custkey", "chain", "o_orderstatus")


@query("SELECT pdb_id, row_number() OVER (ORDER BY first) - 1 AS ord, n FROM (SELECT upper(substr('00' || (o_orderkey * 7 % 3000), -4)) AS pdb_id, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY 1) WHERE length(pdb_id) = 4")
def id_list(spark, d):
    """Scanned from a written list of several files, a line for each order."""
    path = _folder(spark, "ids")
    line = F.concat(F.expr("right(concat('00', cast(o_orderkey * 7 % 3000 as string)), 4)"), F.lit(",x,"), "o_orderstatus")
    table(spark, d, "orders").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").select(line.alias("value")).write.text(path)
    return readers.id_list(spark, path)


_PATH = "'/r/pred_output_' || lower('a' || lpad((user_id % 1000)::VARCHAR, 3, '0')) || '_seed_' || (event_id % 3) || '/x/seed_' || (event_id % 3) || CASE WHEN user_id % 10 = 0 AND event_id % 2 = 0 THEN '/predictions/b' ELSE '/predictions/' END"


def _paths(spark, d):
    t = lambda c: c.cast("string")
    u = F.concat(F.lit("a"), F.lpad(t(F.col("user_id") % 1000), 3, "0"))
    seed, sample = t(F.col("event_id") % 3), t(F.floor(F.col("event_id") / 3) % 5)
    root = F.when((F.col("user_id") % 10 == 0) & (F.col("event_id") % 2 == 0), "/q").otherwise("/r")
    conf = F.col("event_type") == "view"
    path = F.concat(root, F.lit("/pred_output_"), u, F.lit("_seed_"), seed, F.lit("/"), u, F.lit("/seed_"), seed, F.lit("/predictions/"), u, F.when(conf, "_summary_confidence_sample_").otherwise("_sample_"), sample, F.when(conf, ".json").otherwise(".cif"))
    return table(spark, d, "events").select(path.alias("path"))


@query("SELECT upper('a' || lpad((user_id % 1000)::VARCHAR, 3, '0')) AS pdb_id, (event_id % 3)::INT AS seed, (event_id // 3 % 5)::INT AS sample, CASE WHEN event_type = 'view' THEN 'confidence' ELSE 'prediction' END AS kind, count(*) AS n FROM events GROUP BY ALL")
def prediction_layout(spark, d):
    return readers.prediction_layout(_paths(spark, d))[0].groupBy("pdb_id", "seed", "sample", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT upper('a' || lpad((user_id % 1000)::VARCHAR, 3, '0')) AS pdb_id, (event_id % 3)::INT AS seed, 'several prediction folders: 2' AS issue FROM events WHERE user_id % 10 = 0 GROUP BY 1, 2 HAVING count(DISTINCT event_id % 2) = 2")
def layout_issues(spark, d):
    return readers.prediction_layout(_paths(spark, d))[1]


@query("SELECT upper('a' || lpad((user_id % 1000)::VARCHAR, 3, '0')) AS pdb_id, (event_id % 3)::INT AS seed, count(*) AS n_files FROM events GROUP BY ALL")
def folder_presence(spark, d):
    return readers.folder_presence(_paths(spark, d))


@query("""
WITH r AS (SELECT o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN 1000000000 ELSE (o_orderkey % 4)::INT END AS o, o_orderdate::DATE AS d FROM orders), m AS (SELECT o_custkey, min((o, d)) AS m FROM r GROUP BY 1),
l AS (SELECT o_custkey, min(o_orderdate::DATE) AS legacy FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), j AS (SELECT coalesce(m.o_custkey, l.o_custkey) AS o_custkey, CASE WHEN m.o_custkey % 3 <> 0 THEN m.m[2] END AS rev, legacy FROM m FULL JOIN l ON m.o_custkey = l.o_custkey)
SELECT o_custkey, coalesce(rev, legacy) AS release_date, CASE WHEN rev IS NOT NULL THEN 'revision' WHEN legacy IS NOT NULL THEN 'legacy' END AS source, CASE WHEN rev IS NOT NULL AND legacy IS NOT NULL AND rev <> legacy THEN 'date conflict' WHEN coalesce(rev, legacy) IS NULL THEN 'no date' WHEN coalesce(rev, legacy) > DATE '2001-01-01' THEN 'date in the future' END AS issue FROM j""")
def release_dates(spark, d):
    o = table(spark, d, "orders")
    number = F.when(F.col("o_orderkey") % 13 == 0, "?").otherwise((F.col("o_orderkey") % 4).cast("string"))
    day = F.when(F.col("o_custkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("?")
    rev = readers.revisions(o.select("o_custkey", number.alias("ordinal"), day.alias("day")), "o_custkey", "ordinal", "day")
    legacy = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("legacy_date"))
    return readers.release_dates(rev, legacy, "o_custkey", F.lit("2001-01-01").cast("date"))


@query("""
SELECT o_custkey, string_agg(DISTINCT p, ' | ' ORDER BY p) AS methods_sorted, (SELECT string_agg(p, '; ' ORDER BY f) FROM (SELECT o_orderpriority AS p, min(o_orderkey) AS f FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY 1)) AS methods
FROM (SELECT o_custkey, o_orderpriority AS p FROM orders) o GROUP BY o_custkey""")
def method_lists(spark, d):
    return readers.methods(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY l_linenumber = min(l_linenumber) OVER (PARTITION BY o_orderkey)")
def first_model(spark, d):
    """Every fifth order has models with names, whose first isn't the smallest."""
    number = F.col("l_linenumber")
    model = F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("m"), (9 - number).cast("string"))).otherwise(number.cast("string"))
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), model.alias("model"), "l_linenumber", "l_partkey")
    keep = table(spark, d, "orders").select("o_orderkey")
    return readers.first_model(a.join(keep, "o_orderkey", "left_semi"), "o_orderkey", "model", "l_linenumber", "l_partkey").select("o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, count(*) AS n_atoms, count(*) FILTER (l_partkey % 50 = 0) AS n_bad, min(CASE WHEN l_partkey % 50 = 0 THEN l_linenumber END) AS first_bad FROM lineitem GROUP BY 1")
def coordinate_issues(spark, d):
    x = F.when(F.col("l_partkey") % 50 == 0, "NaN").otherwise(F.col("l_quantity").cast("string"))
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), F.col("l_tax").alias("y"), F.col("l_discount").alias("z"))
    return readers.coordinate_issues(a, "l_orderkey", "l_linenumber")


def _cif(spark, d):
    """A structure text for each order: its lines are its atoms."""
    li = table(spark, d, "lineitem")
    atom = F.concat_ws(" ", F.lit("ATOM"), F.lit("C"), F.lit("\"C1'\""), F.lit("."), F.lit("A"), F.lit("A"), F.col("l_linenumber").cast("string"), F.lit("A"), F.format_string("%.3f", F.col("l_quantity")), F.format_string("%.3f", F.col("l_discount")), F.format_string("%.3f", F.col("l_tax")), F.lit("1.00"), F.lit("1"))
    names = "\n".join(f"_atom_site.{i}" for i in structures.TABLES["atom_site"])
    body = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(atom)), "\n").alias("atoms"))
    text = F.concat(F.lit("data_"), F.col("l_orderkey").cast("string"), F.lit("\n_struct.title 'it''s a \"title\"'\nloop_\n_entity_poly.entity_id\n_entity_poly.type\n1 polyribonucleotide\n2 'polypeptide(L)'\n# comment\nloop_\n".replace("it''s", "it s")), F.lit(names + "\n"), F.col("atoms"), F.when(F.col("l_orderkey") % 10 == 0, F.lit("\nATOM\n")).otherwise(F.lit("\n")))
    return body.select(F.col("l_orderkey").cast("string").alias("path"), text.alias("text"))


@query("SELECT l_orderkey::VARCHAR AS path, count(*) AS n_atoms, round(sum(l_quantity), 3) AS sum_x, round(max(l_tax), 3) AS max_z FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1")
def structure_atoms(spark, d):
    atoms = structures.table_of(structures.items(_cif(spark, d), "atom_site"), "atom_site")
    x, z = S.finite_or_null(F.col("Cartn_x")), S.finite_or_null(F.col("Cartn_z"))
    return atoms.groupBy("path").agg(F.count(F.lit(1)).alias("n_atoms"), F.round(F.sum(x), 3).alias("sum_x"), F.round(F.max(z), 3).alias("max_z"))


@query("SELECT DISTINCT l_orderkey::VARCHAR AS path, 'atom_site' AS category FROM lineitem WHERE l_orderkey % 10 = 0")
def structure_issues(spark, d):
    """Loops of all categories are checked, whichever is read."""
    return structures.issues(structures.items(_cif(spark, d), "entry")).select("path", "category")


@query("SELECT l_orderkey::VARCHAR AS block, count(*) AS n_atoms, round(sum(l_quantity), 3) AS sum_x FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1")
def structure_files(spark, d):
    """The structure texts written to files, many blocks each, and read back. A file is one task's work, so its
    size doesn't grow with the tables."""
    path = _folder(spark, "structures")
    _cif(spark, d).select("text").write.option("maxRecordsPerFile", FILE_BLOCKS).text(path)
    atoms = structures.table_of(structures.read_items(spark, path, "part-*", "atom_site"), "atom_site")
    return atoms.groupBy("block").agg(F.count(F.lit(1)).alias("n_atoms"), F.round(F.sum(S.finite_or_null(F.col("Cartn_x"))), 3).alias("sum_x"))


@query("SELECT l_orderkey::VARCHAR AS block, count(*) AS n_atoms, round(sum(l_quantity), 3) AS sum_x FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1")
def structure_splits(spark, d):
    """The structure texts in a file, or in several of SPLIT_FILE_BLOCKS, each of several splits; their atoms read
    by splits. One task writes a file, so files don't grow with the tables beyond that."""
    path = _folder(spark, "structures")
    files = -(-table(spark, d, "orders").count() // SPLIT_FILE_BLOCKS)
    _cif(spark, d).select("text").repartition(max(1, files)).write.text(path)
    atoms, _ = structure_scan.scan(spark, path, "atom_site", "part-*")
    return atoms.groupBy("block").agg(F.count(F.lit(1)).alias("n_atoms"), F.round(F.sum(S.finite_or_null(F.col("Cartn_x"))), 3).alias("sum_x"))


def _id():
    return F.lpad((F.col("o_orderkey") % 3000).cast("string"), 4, "0")


_ID_SQL = "lpad((o_orderkey % 3000)::VARCHAR, 4, '0')"


@query(f"SELECT DISTINCT {_ID_SQL} AS pdb_id FROM orders WHERE o_orderkey % 4 < 2")
def exclusion_list(spark, d):
    """A written list with comments, blanks and lines that are no ids."""
    k, path = F.col("o_orderkey") % 4, _folder(spark, "exclusions")
    line = F.when(k == 0, F.concat(_id(), F.lit(" # frozen"))).when(k == 1, F.concat(F.lit("  "), F.lower(_id()))).when(k == 2, F.concat(F.lit("# "), _id())).otherwise("no id")
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    return readers.exclusion_list(spark, path, strict=False)


@query(f"SELECT DISTINCT {_ID_SQL} AS pdb_id FROM orders WHERE o_orderkey % 5 > 0")
def first_column_ids(spark, d):
    path = _folder(spark, "sheet")
    table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 > 0, _id()).otherwise("total").alias("entry"), "o_orderstatus").write.option("header", True).csv(path)
    return readers.first_column(spark.read.option("header", True).csv(path))


@query("SELECT o_orderstatus AS status, count(*) > 0 AS has_bytes FROM orders GROUP BY 1")
def listed_folders(spark, d):
    """Which folders of a written table hold files, by their listing alone."""
    path = _folder(spark, "listing")
    sinks.write_by(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    files = readers.listing(spark, path, "part-*")
    return files.groupBy(F.regexp_extract("path", "o_orderstatus=([^/]+)/", 1).alias("status")).agg((F.sum("length") > 0).alias("has_bytes"))


def _files(spark, d):
    """A listing: a file for each order, some in quarantine, under names in both cases."""
    k = F.col("o_orderkey")
    stem = F.when(k % 3 == 0, F.lower(F.concat(F.lit("x"), k.cast("string")))).otherwise(F.concat(F.lit("X"), k.cast("string")))
    folder = F.when(k % 11 == 0, "/r/Quarantine/").otherwise("/r/a/")
    kind = F.when(k % 4 == 0, "-final.json").when(k % 4 == 1, ".json").otherwise(".cif")
    return table(spark, d, "orders").select(k, F.concat(folder, stem, kind).alias("path"), F.concat(stem, kind).alias("name"), stem.alias("stem"))


_PATH_SQL = "(CASE WHEN o_orderkey % 11 = 0 THEN '/r/Quarantine/' ELSE '/r/a/' END || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'X' END || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '-final.json' WHEN 1 THEN '.json' ELSE '.cif' END)"


@query(f"SELECT 'X' || o_custkey AS pdb_id, {_PATH_SQL} AS path FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 UNION ALL SELECT 'X' || o_orderkey, {_PATH_SQL} FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 2 = 1")
def file_inventory(spark, d):
    """Odd orders have files of their own name, even ones by an alias of their customer."""
    name = lambda c: F.concat(F.lit("X"), F.col(c).cast("string"))
    o = table(spark, d, "orders")
    ids = o.filter("o_orderkey % 2 = 1").select(name("o_orderkey").alias("pdb_id"))
    aliases = o.filter("o_orderkey % 2 = 0").select(F.lower(name("o_orderkey")).alias("alias"), name("o_custkey").alias("pdb_id"))
    return readers.inventory(_files(spark, d), ids, aliases)


@query(f"SELECT 'X' || o_orderkey AS pdb_id, {_PATH_SQL} AS path FROM orders")
def unique_stem_index(spark, d):
    return readers.unique_stems(_files(spark, d))


@query(f"SELECT 'X' || o_orderkey AS pdb_id, CASE o_orderkey % 4 WHEN 0 THEN 'final' ELSE 'raw' END AS kind, {_PATH_SQL} AS path FROM orders WHERE o_orderkey % 4 < 2")
def document_kinds(spark, d):
    return readers.document_kind(_files(spark, d), {"raw": ".json", "final": "-final.json"})


@query("SELECT lpad(p_partkey::VARCHAR, 4, '0') AS pdb_id, CASE WHEN p_size % 5 <> 0 THEN DATE '2024-01-01' + p_size::INT END AS release FROM part WHERE p_partkey < 10000")
def metadata_scan(spark, d):
    """A written table with another separator and header case, and a date that some rows lack."""
    day = F.when(F.col("p_size") % 5 == 0, "?").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).cast("string"))
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") < 10_000, F.lower(F.lpad(F.col("p_partkey").cast("string"), 4, "0"))).otherwise("none of them").alias("PDB_Id"), "p_size", day.alias("Release"))
    path = _folder(spark, "metadata")
    sinks.write_report(p, path, ["PDB_Id", "p_size", "Release"], sep=";")
    return readers.metadata(readers.delimited(spark, path), "pdb_id", "release", F.try_to_date)


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def candidate_manifest(spark, d):
    path = _folder(spark, "manifest")
    table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).write.parquet(path)
    return readers.manifest(spark.read.parquet(path), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderpriority AS kind, max(o_orderkey) AS run_id, '/runs/' || max(o_orderkey) AS path FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def latest_reports(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL").alias("status"), F.concat(F.lit("/runs/"), F.col("o_orderkey").cast("string")).alias("path"))
    return readers.latest_report(runs)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error') GROUP BY 1")
def event_log_round_trip(spark, d):
    path, e = _folder(spark, "log"), table(spark, d, "events").select("event_id", "user_id", "event_type")
    sinks.append_events(e, path)
    sinks.append_events(e.filter("event_type = 'error'"), path)
    return spark.read.schema(e.schema).json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT 'orders' AS sheet, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_acctbal > 0")
def table_set_round_trip(spark, d):
    path = _folder(spark, "tables")
    sinks.write_tables(path, orders=table(spark, d, "orders"), customer=table(spark, d, "customer").filter("c_acctbal > 0"))
    count = lambda n: spark.read.parquet(f"{path}/{n}").select(F.lit(n).alias("sheet")).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))
    return count("orders").unionByName(count("customer"))


@query("SELECT vec_id, label FROM embeddings WHERE label < 5 AND vec_id % 3 = 0")
def pair_samples(spark, d):
    """The samples of a split that a list names, some of their fields only."""
    e = table(spark, d, "embeddings").withColumn("split", F.when(F.col("label") < 5, "train").otherwise("test"))
    return readers.samples_of(e, "train", e.filter("vec_id % 3 = 0").select("vec_id"), ["vec_id", "label"])


@query("SELECT l_orderkey, count(*) AS n, sum(a.l_partkey - b.k)::BIGINT AS shift FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS k FROM lineitem WHERE l_discount > 0.03 GROUP BY 1, 2) b USING (l_orderkey, l_linenumber) GROUP BY 1")
def common_residues(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda df, c, x: df.groupBy("l_orderkey", F.col("l_linenumber").alias("seq_id")).agg(F.min(x).alias("x")).select("l_orderkey", F.lit(c).alias("chain"), "seq_id", "x", F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    pairs = li.select("l_orderkey", F.lit("A").alias("chain_a"), F.lit("X").alias("chain_b")).distinct()
    met = joins.common_residues(side(li, "A", "l_partkey"), side(li.filter("l_discount > 0.03"), "X", "l_suppkey"), pairs, ["l_orderkey"])
    return met.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") - F.col("x_b")).alias("shift"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 100000) AS dear FROM orders")
def expected_counts(spark, d):
    """Counts that two ways of counting agree on; an error otherwise."""
    o = table(spark, d, "orders")
    finished, dear = o.groupBy("o_orderstatus").count().filter("o_orderstatus = 'F'"), o.filter("o_totalprice > 100000")
    joins.assert_counts(o, finished=(F.col("o_orderstatus") == "F", finished.first()["count"]), dear=(F.col("o_totalprice") > 100_000, dear.count()))
    return o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 100_000).alias("dear"))
