"""The audits over stand-ins from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.functions import scalars as S
from helixlake.operators import stats
from helixlake.sources import readers, structures

from . import audits
from .q_coordinates import MAPS_SQL, atoms, halves
from .q_joins import _sides
from .q_metrics import CAND, candidates, rounded, sql_final
from .q_sequences import PAIRS_SQL, affine_sql, name_pairs
from .q_sources import _cif, _tasks
from .registry import query, table


@query("""
WITH f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS pdb_id, CASE WHEN n IS NULL THEN 'MISSING' WHEN o_orderkey % 10 <> 0 THEN 'VALID' ELSE 'INVALID' END AS file_status,
  CASE WHEN o_orderkey % 3 <> 0 AND n IS NOT NULL AND o_orderkey % 10 <> 0 THEN 'CURRENT_LIST_POLYMER_MISMATCH' WHEN o_orderkey % 3 = 0 THEN 'LEGACY_ONLY' ELSE 'NOT_ASSESSED' END AS eligibility_status, coalesce(n, 0) AS rna_chains
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def structure_manifest(spark, d):
    """Structures of two polymer types whose atoms stand for chains."""
    texts = _cif(spark, d)
    # loops of all categories are checked; blocks without an entity still tell of issues
    blocks = structures.items(texts, "entity_poly").select(F.col("path").alias("pdb_id"), (F.size("issues") > 0).alias("bad"), F.explode_outer("entity_poly").alias("e"))
    checks = blocks.groupBy("pdb_id").agg((~F.bool_or("bad")).alias("valid"), S.is_pure_rna(F.collect_set("e.type")).alias("pure_rna"), F.count("e").alias("n")).filter("n > 0").drop("n")
    key = F.col("o_orderkey")
    ids = table(spark, d, "orders").select(key.cast("string").alias("pdb_id"), (key % 3 != 0).alias("current"), (key % 3 == 0).alias("legacy"))
    files = texts.select(F.col("path").alias("pdb_id"), F.concat(F.lit("/f/"), "path").alias("path"))
    chains = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("pdb_id"))
    return audits.structure_manifest(ids, files, checks, chains)["manifest"].select("pdb_id", "file_status", "eligibility_status", "rna_chains")


@query("""
WITH o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)), m AS (SELECT o_custkey, min((o_orderkey % 4, o_orderdate::DATE)) AS m, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ' | ') AS methods_sorted, min(o_orderstatus) AS code FROM o GROUP BY 1)
SELECT o_custkey AS pdb_id, o_orderkey AS chain_id, m.m[2] AS release_date, methods_sorted, code, o_custkey || '_' || o_orderkey AS target_id FROM o JOIN m USING (o_custkey)""")
def entity_metadata(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("pdb_id"), F.col("o_orderkey").alias("chain_id"), F.col("o_orderpriority").alias("sequence"), F.lit("polyribonucleotide").alias("type"), "o_orderdate", F.col("o_orderstatus").alias("code"))
    rev = readers.revisions(o.select("pdb_id", (F.col("chain_id") % 4).cast("string").alias("o"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), "pdb_id", "o", "d")
    legacy = o.select("pdb_id", F.lit(None).cast("date").alias("legacy_date")).limit(0)
    methods = readers.methods(o, "pdb_id", "chain_id", "sequence")
    got = audits.entity_metadata(o.select("pdb_id", "chain_id", "sequence", "type"), rev, legacy, methods, o.select("pdb_id", "code"), table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("pdb_id")), F.lit("2100-01-01").cast("date"))
    return got["metadata"].select("pdb_id", "chain_id", "release_date", "methods_sorted", "code", "target_id")


def _split(spark, d):
    """Parts as entities: the brand is the entry, the name the sequence, the size the date."""
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("pdb_id"), F.col("p_partkey").cast("string").alias("entity_id"), F.array(F.col("p_partkey").cast("string")).alias("chain_ids"), F.upper(F.translate("p_name", " ", "")).alias("sequence"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size") * 10).alias("release_date"), F.col("p_retailprice").alias("resolution"))


def _split_tables(spark, d):
    date = lambda x: F.lit(x).cast("date")
    return audits.split_and_mask(_split(spark, d), date("2024-02-20"), date("2024-03-20"), 0.8)


_SPLIT = r"""
p AS (SELECT p_brand AS pdb_id, p_partkey::VARCHAR AS entity_id, p_brand || '#' || p_partkey AS key, regexp_replace(replace(upper(replace(p_name, ' ', '')), 'U', 'T'), '[^ACGT]', 'N', 'g') AS s,
  CASE WHEN p_size <= 5 THEN 'train' WHEN p_size <= 7 THEN 'val' ELSE 'test' END AS split, p_retailprice AS res, p_size FROM part),
u AS (SELECT DISTINCT s FROM p), e AS (SELECT a.s AS a, b.s AS b FROM u a JOIN u b ON levenshtein(a.s, b.s) <= floor((1 - 0.8 + 1e-12) * greatest(length(a.s), length(b.s)))),
known AS (SELECT DISTINCT s FROM p WHERE split <> 'test'), m AS (SELECT DISTINCT a AS s FROM e JOIN known ON known.s = b),
k AS (SELECT DISTINCT s FROM p WHERE split = 'test' AND s NOT IN (SELECT s FROM m)),
r(s, reach) AS (SELECT s, s FROM k UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.reach WHERE e.b IN (SELECT s FROM k)),
c AS (SELECT s, min(reach) AS comp FROM r GROUP BY s),
rep AS (SELECT comp, key AS rep FROM p JOIN c USING (s) WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY comp ORDER BY res, p_size, key) = 1),
st AS (SELECT pdb_id, entity_id, key, CASE WHEN m.s IS NOT NULL THEN 'MASK_REFERENCE' WHEN key = rep THEN 'EVALUATE' ELSE 'MASK_INTERNAL' END AS status FROM p LEFT JOIN m USING (s) LEFT JOIN c USING (s) LEFT JOIN rep USING (comp) WHERE split = 'test')"""


@query(f"WITH RECURSIVE {_SPLIT} SELECT key, status FROM st")
def split_and_mask(spark, d):
    return _split_tables(spark, d)["entities"].select("key", "status")


@query(f"""WITH RECURSIVE {_SPLIT} SELECT pdb_id, count(*) AS total_chains, count(*) FILTER (status = 'EVALUATE') AS evaluate_count,
  CASE WHEN count(*) FILTER (status = 'EVALUATE') = count(*) THEN 'KEEP_ALL' WHEN count(*) FILTER (status = 'EVALUATE') > 0 THEN 'KEEP_PARTIAL' ELSE 'DROP' END AS status FROM st GROUP BY 1""")
def split_entries(spark, d):
    return _split_tables(spark, d)["entries"].select("pdb_id", "total_chains", "evaluate_count", "status")


_MASKS = ", ".join(f"count(*) FILTER (status = '{s}') AS {n}_entities, count(*) FILTER (status = '{s}') AS {n}_chains, count(DISTINCT p.pdb_id) FILTER (status = '{s}') AS {n}_entries" for n, s in (("reference", "MASK_REFERENCE"), ("internal", "MASK_INTERNAL"), ("evaluated", "EVALUATE")))


@query(f"WITH RECURSIVE {_SPLIT} SELECT split, count(*) AS n_entities, count(*) AS n_chains, count(DISTINCT p.pdb_id) AS n_entries, {_MASKS} FROM p LEFT JOIN st ON st.key = p.key GROUP BY 1")
def split_counts(spark, d):
    return _split_tables(spark, d)["counts"]


@query("""
WITH m AS (SELECT c_custkey AS pdb_id, c_mktsegment AS split FROM customer WHERE c_mktsegment <> 'MACHINERY'), l AS (SELECT c_custkey AS pdb_id, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS found FROM customer WHERE c_acctbal > 0)
SELECT coalesce(m.pdb_id, l.pdb_id) AS pdb_id, coalesce(split, found) AS split, CASE WHEN split IS NULL THEN 'EXTRA' WHEN found IS NULL THEN 'WOULD_CREATE' WHEN found = split THEN 'EXISTS' ELSE 'WRONG_SPLIT' END AS action FROM m FULL JOIN l ON m.pdb_id = l.pdb_id""")
def placement_plan(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("pdb_id"), F.col("c_mktsegment").alias("split"), "c_acctbal")
    return audits.placement_plan(c.filter("split <> 'MACHINERY'").drop("c_acctbal"), c.filter("c_acctbal > 0").withColumn("split", F.when(F.col("pdb_id") % 7 == 0, "OTHER").otherwise(F.col("split"))))


@query("SELECT DISTINCT p_brand AS pdb_id, CASE WHEN p_brand IN ('Brand#3', 'Brand#4') THEN 'INVALID_UPDATED_JSON' WHEN count(*) FILTER (p_size = 11) OVER (PARTITION BY p_brand) > 0 THEN 'INCOMPLETE_MSA' ELSE 'COMPLETE' END AS status FROM part")
def prep_audit(spark, d):
    """Parts of size 11 have no alignment file; the brand has others, so none is taken for it."""
    docs = _tasks(spark, d)
    both = docs.select(F.col("p_brand").alias("pdb_id"), F.lit("final").alias("kind"), F.col("doc").alias("text")).unionByName(docs.select(F.col("p_brand").alias("pdb_id"), F.lit("raw").alias("kind"), F.col("doc").alias("text")))
    p = table(spark, d, "part").filter("p_size <> 11")
    path = F.concat(F.lit("/m/"), F.col("p_partkey").cast("string"))
    files = p.select(F.col("p_brand").alias("pdb_id"), path.alias("path"))
    texts = p.select(path.alias("path"), F.concat(F.lit(">q\n"), F.upper("p_name")).alias("text"))
    return audits.prep_audit(both, files, texts)["targets"].select("pdb_id", "status")


@query("""
WITH f AS (SELECT user_id, (event_id % 3)::INT AS seed, list_sort(list(DISTINCT (event_id // 3 % 4)::INT) FILTER (event_type IN ('view', 'click'))) AS p, list_sort(list(DISTINCT (event_id // 3 % 4)::INT) FILTER (event_type = 'error')) AS c FROM events GROUP BY ALL),
g AS (SELECT user_id, unnest([0, 1, 2]) AS seed FROM (SELECT DISTINCT user_id FROM events))
SELECT g.user_id AS pdb_id, g.seed, CASE WHEN p = [0, 1, 2, 3] AND c = [0, 1, 2, 3] THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.seed = g.seed""")
def candidate_stage_audit(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "prediction").when(F.col("event_type") == "error", "confidence").otherwise("other")
    files = e.select(F.col("user_id").alias("pdb_id"), (F.col("event_id") % 3).cast("int").alias("seed"), (F.floor(F.col("event_id") / 3) % 4).cast("int").alias("sample"), kind.alias("kind"), F.lit(True).alias("valid")).distinct()
    targets = table(spark, d, "events").select(F.col("user_id").alias("pdb_id")).distinct().withColumns({"raw_valid": F.lit(True), "prep": F.lit("COMPLETE")})
    return audits.candidate_stage_audit(targets, files, [0, 1, 2], [0, 1, 2, 3])["seeds"].drop("reason")


@query("""
WITH c AS (SELECT p_brand AS pdb_id, p_partkey::VARCHAR AS chain_id, upper(replace(p_name, ' ', '')) AS s FROM part WHERE p_brand <> 'Brand#5'), m AS (SELECT p_brand AS pdb_id, CASE WHEN p_partkey % 100 = 0 THEN 'ACGU' ELSE upper(replace(p_name, ' ', '')) END AS s, p_partkey FROM part WHERE p_brand <> 'Brand#6')
SELECT code, count(*) AS n FROM (SELECT 'NON_ACGU' AS code FROM c WHERE regexp_replace(s, '[ACGU]', '', 'g') <> '' UNION ALL SELECT 'OVER_LENGTH' FROM c WHERE length(s) > 9 UNION ALL SELECT 'MISSING_INPUT' WHERE EXISTS (SELECT 1 FROM m WHERE pdb_id = 'Brand#5') UNION ALL SELECT 'EXTRA_INPUT' WHERE EXISTS (SELECT 1 FROM c WHERE pdb_id = 'Brand#6')
  UNION ALL SELECT 'SEQUENCE_MISMATCH' FROM (SELECT DISTINCT pdb_id FROM m WHERE p_partkey % 100 = 0 AND pdb_id <> 'Brand#5')) GROUP BY 1""")
def chain_input_audit(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("pdb_id"), F.col("p_partkey").cast("string").alias("chain_id"), F.upper(F.translate("p_name", " ", "")).alias("sequence"), "p_partkey")
    other = p.withColumn("sequence", F.when(F.col("p_partkey") % 100 == 0, "ACGU").otherwise(F.col("sequence")))
    got = audits.chain_input_audit(p.filter("pdb_id <> 'Brand#5'").drop("p_partkey"), other.filter("pdb_id <> 'Brand#6'").drop("p_partkey"), max_length=9)
    return stats.value_counts(got["issues"], "code")


@query("""
WITH w AS (SELECT source, doc_id, text, length(text) AS n FROM documents)
SELECT source AS pdb_id, count(*) AS chain_count, sum(n)::BIGINT AS residue_count, sum(length(regexp_replace(text, '[ACGU]', '', 'g')))::BIGINT AS non_acgu, string_agg(DISTINCT CASE WHEN n <= 1022 THEN 'single' ELSE 'windowed' END, ',' ORDER BY CASE WHEN n <= 1022 THEN 'single' ELSE 'windowed' END) AS methods FROM w GROUP BY 1""")
def embedding_manifest(spark, d):
    c = table(spark, d, "documents").select(F.col("source").alias("pdb_id"), F.col("doc_id").alias("chain_id"), F.col("text").alias("sequence"))
    return audits.embedding_manifest(c)["entries"]


@query("SELECT count(*) FILTER (i < 21 AND (vec_id + i) % 17 <> 0) AS n_both, count(*) FILTER (i < 21 AND (vec_id + i) % 17 = 0) AS n_absent, count(*) FILTER (i = 21 AND vec_id % 13 = 0) AS n_unexpected, 0 AS bad_one FROM embeddings, range(22) t(i)")
def validate_embeddings(spark, d):
    """Some places of the chains are missing, and some chains have one too many."""
    a = atoms(spark, d).select(F.col("label").alias("pdb_id"), F.col("vec_id").alias("chain_id"), F.col("atom").alias("index_in_chain"), F.array("x", "y", "z").alias("emb"))
    over = a.filter("index_in_chain = 0 AND chain_id % 13 = 0").withColumn("index_in_chain", F.lit(21))
    a = a.filter("(chain_id + index_in_chain) % 17 <> 0").unionByName(over)
    chains = table(spark, d, "embeddings").select(F.col("label").alias("pdb_id"), F.col("vec_id").alias("chain_id"), F.lit(21).alias("n"))
    return audits.validate_embeddings(a, chains)["indexes"]


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber::VARCHAR AS chain, min(l_partkey % 5) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT * FROM a WHERE NOT (l_orderkey % 8 = 0 AND chain = '2')),
na AS (SELECT l_orderkey, s, count(*) AS n FROM a GROUP BY 1, 2), nb AS (SELECT l_orderkey, s, count(*) AS n FROM b GROUP BY 1, 2),
g AS (SELECT na.l_orderkey, bool_and(na.n = 1 AND coalesce(nb.n, 0) = 1) AS u, bool_and(na.n = coalesce(nb.n, 0)) AS c FROM na LEFT JOIN nb ON na.l_orderkey = nb.l_orderkey AND na.s = nb.s GROUP BY 1)
SELECT l_orderkey::VARCHAR AS pdb_id, CASE WHEN u AND c AND l_orderkey % 12 <> 0 THEN 'PASS' ELSE 'REVIEW' END AS status, concat_ws(';', CASE WHEN NOT u THEN 'unique_sequences' END, CASE WHEN NOT c THEN 'complete' END, CASE WHEN l_orderkey % 12 = 0 THEN 'consistent' END) AS reasons FROM g""")
def base_chain_map(spark, d):
    a, b = (x.select(F.col("l_orderkey").cast("string").alias("pdb_id"), F.col("chain").alias("chain_id"), F.col("s").cast("string").alias("sequence")) for x in _sides(spark, d))
    sig = a.select("pdb_id").distinct().withColumn("consistent", F.col("pdb_id").cast("long") % 12 != 0)
    return audits.base_chain_map(a, b, sig)["targets"]


@query(f"WITH {MAPS_SQL}, v AS (SELECT label, mapping_key, count(*) AS n FROM best GROUP BY 1, 2), m AS (SELECT label, max(n) / sum(n) AS dominance FROM v GROUP BY 1) SELECT label::VARCHAR AS target, CASE WHEN dominance >= 0.8 THEN 'PASS' ELSE 'REVIEW' END AS status, CASE WHEN dominance >= 0.8 THEN '' ELSE 'dominance' END AS reasons FROM m")
def coordinate_chain_map(spark, d):
    pred, truth = halves(spark, d)
    return audits.coordinate_chain_map(pred, truth, truth.select("target", "chain").distinct().withColumn("length", F.lit(11)), tolerance=0.0)["targets"]


@query("""
WITH g AS (SELECT user_id, s AS seed, k AS sample FROM (SELECT DISTINCT user_id FROM events), range(2) a(s), range(4) b(k)), o AS (SELECT DISTINCT user_id, event_id % 2 AS seed, event_id // 2 % 4 AS sample, 1 AS n FROM events WHERE event_type = 'error'),
m AS (SELECT g.user_id, bool_and(n IS NOT NULL) AS complete, string_agg(g.seed || '/' || g.sample, ',' ORDER BY g.seed || '/' || g.sample) FILTER (n IS NULL) AS miss FROM g LEFT JOIN o ON o.user_id = g.user_id AND o.seed = g.seed AND o.sample = g.sample GROUP BY 1),
r AS (SELECT user_id, min(ts)::DATE AS release_date, count(*) AS chain_count FROM events GROUP BY 1)
SELECT r.user_id AS pdb_id, release_date, CASE WHEN release_date > DATE '2024-01-01' THEN 'post_cutoff' ELSE 'pre_or_on_cutoff' END AS time_group, chain_count, complete, 'missing ' || miss AS reason FROM r JOIN m USING (user_id)""")
def targets_table(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "pdb_id")
    files = e.filter("event_type = 'error'").select("pdb_id", (F.col("event_id") % 2).cast("int").alias("seed"), (F.floor(F.col("event_id") / 2) % 4).cast("int").alias("sample")).distinct()
    return audits.targets_table(e.groupBy("pdb_id").agg(F.count(F.lit(1)).alias("chain_count")), e.groupBy("pdb_id").agg(F.to_date(F.min("ts")).alias("release_date")), files, F.lit("2024-01-01").cast("date"), [0, 1], [0, 1, 2, 3])


def _report(spark, d):
    e = table(spark, d, "events")
    targets = e.groupBy(F.col("user_id").alias("pdb_id")).agg(F.to_date(F.min("ts")).alias("release_date"), F.lit("post_cutoff").alias("time_group"), F.count_if(F.col("event_type") == "view").alias("chain_count"), F.count(F.lit(1)).alias("rna_total_length"))
    return audits.candidate_report(candidates(spark, d).withColumn("log", F.when(F.col("eval_status") != "SUCCESS", "timeout after 5 s")), targets)


@query(f"""
WITH c AS {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY ranking_score DESC NULLS LAST, seed, sample) AS rn FROM c), t AS (SELECT user_id AS pdb_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS chains FROM events GROUP BY 1)
SELECT pdb_id, seed, sample, rmsd, CASE WHEN n <= 20 THEN '1-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' WHEN n <= 200 THEN '101-200' ELSE '>200' END AS length_group, CASE WHEN chains >= 5 THEN '>=5' ELSE chains::VARCHAR END AS chain_count_group FROM r JOIN t USING (pdb_id) WHERE rn = 1""")
def candidate_report(spark, d):
    return _report(spark, d)["rank1"].select("pdb_id", "seed", "sample", "rmsd", "length_group", "chain_count_group")


_FINAL = f"""c AS {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY ranking_score DESC NULLS LAST, seed, sample) AS rn FROM c), t AS (SELECT user_id AS pdb_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS chains FROM events GROUP BY 1),
s AS (SELECT CASE WHEN pdb_id % 10 <> 4 THEN rmsd END AS v, CASE WHEN n <= 20 THEN '1-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' WHEN n <= 200 THEN '101-200' ELSE '>200' END AS lg, CASE WHEN chains >= 5 THEN '>=5' ELSE chains::VARCHAR END AS cg FROM r JOIN t USING (pdb_id) WHERE rn = 1)"""


@query(f"WITH {_FINAL} SELECT 'overall' AS section, 'all' AS \"group\", {sql_final('v')} FROM s UNION ALL SELECT 'time', 'post_cutoff', {sql_final('v')} FROM s UNION ALL SELECT 'length', lg, {sql_final('v')} FROM s GROUP BY lg UNION ALL SELECT 'chains', cg, {sql_final('v')} FROM s GROUP BY cg")
def final_report(spark, d):
    top = _report(spark, d)["rank1"]
    frozen = table(spark, d, "events").select(F.col("user_id").alias("pdb_id")).distinct().filter("pdb_id % 10 = 4")
    return rounded(audits.final_report(top, candidates(spark, d), frozen)["main"])


@query("""
WITH s AS (SELECT DISTINCT replace(upper(replace(p_name, ' ', '')), 'T', 'U') AS sequence FROM part), a AS (SELECT DISTINCT replace(upper(replace(p_name, ' ', '')), 'T', 'U') AS sequence FROM part WHERE p_size = 1), b AS (SELECT DISTINCT replace(upper(replace(p_name, ' ', '')), 'T', 'U') AS sequence FROM part WHERE p_size = 2)
SELECT CASE WHEN a.sequence IS NOT NULL THEN 'existing' WHEN b.sequence IS NOT NULL THEN 'cache' ELSE 'unresolved' END AS source_type, count(*) AS n FROM s LEFT JOIN a ON a.sequence = s.sequence LEFT JOIN b ON b.sequence = s.sequence GROUP BY 1""")
def resource_coverage(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("pdb_id"), F.col("p_name").alias("sequence"), "p_size", F.col("p_partkey").cast("string").alias("path"))
    named = p.withColumn("sequence", S.spelling_key(S.normalise_sequence(F.col("sequence"))))
    return audits.resource_coverage(p, [("existing", named.filter("p_size = 1")), ("cache", named.filter("p_size = 2"))])["counts"]


_DOUBLED = PAIRS_SQL.replace("upper(replace(x.p_name, ' ', '')) AS a, upper(replace(y.p_name, ' ', '')) AS b", "upper(replace(x.p_name || y.p_name, ' ', '')) AS a, upper(replace(x.p_name, ' ', '')) AS b")


@query(f"""
WITH RECURSIVE {affine_sql(_DOUBLED)}, c AS (SELECT w.p_partkey, count(*) AS n, count(*) FILTER (a[i] = b[j]) AS same FROM w JOIN p ON p.p_partkey = w.p_partkey GROUP BY 1)
SELECT p.p_partkey AS sample, round(same / length(a), 6) AS identity, n::INT AS aligned, CASE WHEN same = length(a) THEN 'identical' WHEN n < 10 THEN 'skipped: too few residues' ELSE 'aligned' END AS note FROM p JOIN c ON c.p_partkey = p.p_partkey""")
def aligned_report(spark, d):
    """Each part's name against its own followed by the next part's."""
    p = name_pairs(spark, d)
    return audits.aligned_report(p.select(F.col("p_partkey").alias("sample"), F.concat("a", "b").alias("truth"), F.col("a").alias("predicted"))).withColumn("identity", F.round("identity", 6))


@query("""
SELECT c_custkey AS pdb_id, o.k IS NOT NULL AS has_file, f.k IS NOT NULL AS has_folder, coalesce(n, 0) AS n_samples, CASE WHEN o.k IS NOT NULL AND f.k IS NOT NULL AND coalesce(n, 0) = 5 THEN 'PASS' ELSE 'FAIL' END AS status FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') f ON f.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) s ON s.k = c_custkey""")
def presence_report(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("pdb_id"), "o_orderstatus")
    return audits.presence_report(table(spark, d, "customer").select(F.col("c_custkey").alias("pdb_id")), o, o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), 5)
