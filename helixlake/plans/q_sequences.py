"""Scalar rules, text classification and sequence queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.functions import scalars as S
from helixlake.operators import alignment, coordinates, joins, packing, ranking, sequences

from .registry import query, table


@query(r"""
SELECT p_partkey, CASE WHEN regexp_matches(upper(trim(substr(p_brand, 4) )), '^[A-Z0-9]{4}$') THEN upper(trim(substr(p_brand, 4))) END AS strict_id,
  CASE WHEN regexp_matches(upper(replace(trim(substr(p_brand, 4)), '#', '_')), '^[A-Z0-9_]{4}$') THEN upper(replace(trim(substr(p_brand, 4)), '#', '_')) END AS loose_id,
  CASE WHEN CASE WHEN p_size = 1 THEN '?' WHEN p_size = 2 THEN ' . ' ELSE p_type END IN ('?', ' . ') THEN NULL ELSE p_type END AS cleaned FROM part""")
def id_rules(spark, d):
    raw = F.expr("substr(p_brand, 4)")
    dirty = F.when(F.col("p_size") == 1, "?").when(F.col("p_size") == 2, " . ").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", S.normalise_id(raw).alias("strict_id"), S.normalise_id(F.replace(raw, F.lit("#"), F.lit("_")), underscore=True).alias("loose_id"), S.clean_token(dirty).alias("cleaned"))


@query(r"""
WITH s AS (SELECT doc_id, upper(regexp_replace(replace(text, 'ß', 'ss'), '\s+', '', 'g')) AS seq FROM documents), x AS (SELECT *, regexp_replace(replace(seq, 'U', 'T'), '[^ACGT]', 'N', 'g') AS alpha FROM s)
SELECT doc_id, sha256(seq) AS digest, sha256(alpha) AS alpha_digest, length(alpha) - length(replace(alpha, 'N', '')) AS ambiguous, len(regexp_extract_all(seq, '\([^)]*\)|[A-Za-z?]')) AS n_tokens,
  sha256(replace(seq, 'T', 'U')) AS key_digest, coalesce(list_aggregate(list_sort(list_distinct(list_filter(string_split(regexp_replace(seq, '[ACGU]', '', 'g'), ''), lambda c: c <> ''))), 'string_agg', ''), '') AS unknown FROM x""")
def sequence_scalars(spark, d):
    s = table(spark, d, "documents").select("doc_id", S.normalise_sequence(F.col("text")).alias("seq"))
    alpha = S.search_alphabet(F.col("seq"))
    return s.select("doc_id", S.sequence_digest(F.col("seq")).alias("digest"), S.sequence_digest(alpha).alias("alpha_digest"), S.count_of(alpha, "N").alias("ambiguous"), F.size(S.residue_tokens(F.col("seq"))).alias("n_tokens"), S.sequence_digest(S.spelling_key(F.col("seq"))).alias("key_digest"), S.unknown_symbols(F.col("seq")).alias("unknown"))


@query("""
SELECT o_orderkey, n, CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26) ELSE chr(65 + (n - 703) // 676) || chr(65 + (n - 703) // 26 % 26) || chr(65 + (n - 703) % 26) END AS label
FROM (SELECT o_orderkey, (o_orderkey % 18278 + 1)::INT AS n FROM orders)""")
def chain_labels(spark, d):
    n = (F.col("o_orderkey") % 18278 + 1).cast("int")
    return table(spark, d, "orders").select("o_orderkey", n.alias("n"), S.chain_label(n).alias("label"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN -p_retailprice ELSE p_retailprice / 300 END AS a, CASE WHEN p_size % 3 = 0 THEN '?' WHEN p_size % 3 = 1 THEN '' ELSE (p_retailprice / 200)::VARCHAR END AS b, p_size / 10.0 AS c FROM part)
SELECT p_partkey, round(least(CASE WHEN a > 0 THEN a END, CASE WHEN TRY_CAST(b AS DOUBLE) > 0 THEN TRY_CAST(b AS DOUBLE) END, c), 4) AS smallest, round(coalesce(a, TRY_CAST(b AS DOUBLE), c), 4) AS first, round(CASE WHEN a IS NOT NULL THEN a WHEN b <> '' THEN TRY_CAST(b AS DOUBLE) ELSE c END, 4) AS strict FROM p""")
def resolution_rules(spark, d):
    k = F.col("p_size")
    a = F.when(k % 5 == 0, None).when(k % 5 == 1, -F.col("p_retailprice")).otherwise(F.col("p_retailprice") / 300).cast("string")
    b = F.when(k % 3 == 0, "?").when(k % 3 == 1, "").otherwise((F.col("p_retailprice") / 200).cast("string"))
    c = (k / 10.0).cast("string")
    return table(spark, d, "part").select("p_partkey", F.round(S.resolution_smallest(a, b, c), 4).alias("smallest"), F.round(S.resolution_first(a, b, c), 4).alias("first"), F.round(S.resolution_strict(a, b, c), 4).alias("strict"))


_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_TYPES = "CASE page_id % 4 WHEN 0 THEN 'polyribonucleotide' WHEN 1 THEN 'polypeptide(L) polyribonucleotide' WHEN 2 THEN 'polydeoxyribonucleotide polyribonucleotide' ELSE 'polypeptide(L)' END"
_TITLE = "lower(url || CASE WHEN page_id % 6 = 0 THEN ' Ribosomal 50S' ELSE '' END || CASE WHEN page_id % 9 = 0 THEN ' tRNA' ELSE '' END || chr(10) || html)"


@query(f"""
SELECT page_id, CASE WHEN rib AND bound THEN 'ribosome_bound' WHEN rib THEN 'ribosome' WHEN contains(t, 'polypeptide') AND contains(t, 'polyribonucleotide') THEN 'rna_protein'
  WHEN contains(t, 'polyribonucleotide') AND NOT contains(t, 'polypeptide') AND NOT contains(t, 'polydeoxyribonucleotide') THEN 'pure_rna' ELSE 'others' END AS class
FROM (SELECT page_id, lower({_TYPES}) AS t, {_ANY(_TITLE, S.RIBOSOME_WORDS)} AS rib, {_ANY(_TITLE, S.BOUND_RNA_WORDS)} AS bound FROM pages)""")
def structure_class(spark, d):
    k = F.col("page_id")
    types = F.when(k % 4 == 0, "polyribonucleotide").when(k % 4 == 1, "polypeptide(L) polyribonucleotide").when(k % 4 == 2, "polydeoxyribonucleotide polyribonucleotide").otherwise("polypeptide(L)")
    title = F.concat("url", F.when(k % 6 == 0, " Ribosomal 50S").otherwise(""), F.when(k % 9 == 0, " tRNA").otherwise(""))
    return table(spark, d, "pages").select("page_id", S.structure_class(title, F.col("html"), types).alias("class"))


_LOGS = ("", "GDT with window size 3 failed", "arrays used as indices must be of integer (or boolean) type", "ValueError: need at least one array to concatenate while Computing all-atom lDDT", "Computing RMSD; Computing patch TM-score; ERROR! No assignable chain", "Timeout after 600 s", "OST status is 'FAILURE'", "CUDA out of memory", "FileNotFoundError: x", "Dataloader initialization failed: mmcif directory", "computing chain mapping")
_LOG_SQL = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{s.replace(chr(39), chr(39) * 2)}'" for i, s in enumerate(_LOGS)) + " END"


@query(f"""
WITH l AS (SELECT event_id, event_type = 'view' AS ok, {_LOG_SQL} AS log FROM events), x AS (SELECT *, lower(log) AS low FROM l)
SELECT event_id, CASE WHEN ok THEN '' WHEN contains(low, 'gdt') AND contains(low, 'window size') THEN 'GDT_TOO_FEW_MAPPED_POSITIONS' WHEN contains(low, 'arrays used as indices') THEN 'CHAIN_MAPPING_INDEX_ERROR'
  WHEN contains(low, 'need at least one array to concatenate') THEN 'LDDT_EMPTY_ARRAY' WHEN contains(low, 'computing rmsd') AND contains(low, 'error! no assignable chain') THEN 'DOWNSTREAM_TM_NO_ASSIGNABLE_CHAIN_AFTER_RMSD'
  WHEN contains(low, 'timeout after') THEN 'TIMEOUT' WHEN contains(low, 'ost status is ''failure''') THEN 'OST_FAILURE_OTHER' WHEN log = '' THEN 'NO_ERROR_LOG' ELSE 'OTHER' END AS code,
  CASE WHEN contains(low, 'gdt') AND contains(low, 'window size') THEN 'RIGID_GDT' WHEN contains(low, 'arrays used as indices') THEN 'CHAIN_MAPPING' WHEN contains(low, 'computing rmsd') AND contains(low, 'error! no assignable chain') THEN 'DOWNSTREAM_TM_SCORE'
  WHEN contains(low, 'need at least one array') THEN 'ALL_ATOM_LDDT' WHEN contains(low, 'timeout after') THEN 'TIMEOUT' WHEN contains(low, 'computing chain mapping') THEN 'CHAIN_MAPPING' ELSE 'UNKNOWN' END AS stage,
  CASE WHEN contains(low, 'gdt') AND contains(low, 'window size') THEN 'Too few mapped positions for GDT before RMSD serialization' WHEN contains(low, 'arrays used as indices') THEN 'OpenStructure 2.8 NumPy integer/boolean index error'
  WHEN contains(low, 'computing rmsd') AND contains(low, 'error! no assignable chain') THEN 'USalign reported no assignable chain after RMSD stage was reached' WHEN contains(low, 'need at least one array') THEN 'OpenStructure 2.8 lDDT empty-array error'
  WHEN contains(low, 'timeout after') THEN 'Per-candidate evaluation timeout' WHEN contains(low, 'computing chain mapping') THEN 'Unclassified failure during/after chain mapping' ELSE 'See stderr excerpt' END AS detail,
  CASE WHEN contains(log, 'Dataloader initialization failed') AND contains(log, 'mmcif directory') THEN 'missing_template_data' WHEN contains(log, 'use_template=false') THEN 'needs_no_template' WHEN contains(log, 'CUDA out of memory') OR contains(log, 'OOM') THEN 'out_of_memory'
  WHEN contains(log, 'FileNotFoundError') OR contains(log, 'No such file') THEN 'missing_input' ELSE 'other' END AS log_class,
  CASE WHEN ok THEN NULL WHEN contains(log, 'Computing all-atom lDDT') AND contains(log, 'ValueError: need at least one array to concatenate') THEN 'LDDT_EMPTY_ARRAY_BEFORE_RIGID_SCORE'
  WHEN contains(log, 'Computing RMSD') AND contains(log, 'Computing patch TM-score') AND contains(log, 'ERROR! No assignable chain') THEN 'DOWNSTREAM_TM_NO_ASSIGNABLE_CHAIN_AFTER_RMSD' END AS rescue, substr(log, 1, 120) AS line FROM x""")
def failure_classes(spark, d):
    logs = F.array(*[F.lit(x) for x in _LOGS])
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "view").alias("ok"), logs[(F.col("event_id") % 11).cast("int")].alias("log"))
    return e.select("event_id", S.failure_code(F.lit(None).cast("string"), F.col("log"), F.col("ok")).alias("code"), S.failure_stage(F.col("log"))["stage"].alias("stage"), S.failure_stage(F.col("log"))["detail"].alias("detail"), S.log_error_class(F.col("log")).alias("log_class"), S.rescue_reason(F.col("ok"), F.col("log")).alias("rescue"), S.first_line(F.col("log")).alias("line"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b, o_orderkey % 5 <> 0 AS c, o_orderstatus = 'F' AS p, o_orderkey % 7 AS m, o_orderkey % 4 AS r FROM orders),
s AS (SELECT *, CASE WHEN NOT a THEN 'MISSING_UPDATED_JSON' WHEN NOT c THEN 'INVALID_UPDATED_JSON' WHEN m > 4 THEN 'INCOMPLETE_MSA' WHEN r > 1 THEN 'COMPLETE_REBASABLE' ELSE 'COMPLETE' END AS prep FROM o)
SELECT o_orderkey, CASE WHEN a AND c AND p THEN 'ELIGIBLE_CURRENT' WHEN a AND c THEN 'CURRENT_LIST_POLYMER_MISMATCH' WHEN b AND NOT a THEN 'LEGACY_ONLY' ELSE 'NOT_ASSESSED' END AS eligibility, CASE WHEN NOT a THEN 'NOT_DOWNLOADED' WHEN c THEN 'EXISTING_VALID' ELSE 'EXISTING_INVALID' END AS sync, prep,
  CASE WHEN NOT c THEN 'NEED_JSON' WHEN prep NOT IN ('COMPLETE', 'COMPLETE_REBASABLE') THEN 'NEED_PREP' WHEN r <> 3 THEN 'NEED_PRED' ELSE 'COMPLETE' END AS overall,
  CASE WHEN prep NOT IN ('COMPLETE', 'COMPLETE_REBASABLE') THEN 'DEFER_PREP' WHEN r = 0 THEN 'COMPLETE' WHEN b THEN 'QUARANTINE' ELSE 'SCHEDULE' END AS action, greatest(1, m) * greatest(1, m) AS weight FROM s""")
def status_rules(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", (k % 2 == 0).alias("a"), (k % 3 == 0).alias("b"), (k % 5 != 0).alias("c"), (F.col("o_orderstatus") == "F").alias("p"), (k % 7).alias("m"), (k % 4).alias("r"))
    a, b, c, p, m, r = (F.col(x) for x in "abcpmr")
    o = o.withColumn("prep", S.prep_status(a, c, F.when(m > 4, 1).otherwise(0), F.when(r > 1, 1).otherwise(0)))
    return o.select("o_orderkey", S.eligibility(a, b, c, p).alias("eligibility"), S.sync_status(a, c).alias("sync"), "prep", S.target_status(c, F.col("prep"), r, 3).alias("overall"), S.target_action(F.col("prep"), r, b).alias("action"), S.cost_weight(m).alias("weight"))


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS x, round(CASE WHEN (props->>'$.k')::DOUBLE > 1 THEN (props->>'$.k')::DOUBLE / 100 ELSE (props->>'$.k')::DOUBLE END, 6) AS share, event_type IN ('view', 'click') AS flag, printf('%.6f', value) AS fixed FROM events")
def number_rules(spark, d):
    k = F.get_json_object("props", "$.k")
    e = table(spark, d, "events")
    flag = S.truthy(F.when(F.col("event_type").isin("view", "click"), " TRUE ").otherwise("0"))
    return e.select("event_id", S.finite_or_null(k).alias("x"), F.round(S.fraction(k), 6).alias("share"), flag.alias("flag"), S.fixed_number(F.col("value")).alias("fixed"))


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (props->>'$.k')::INT = (event_id % 100) AND event_id % 5 <> 0 END AS same FROM events")
def json_equality(spark, d):
    """Against documents with a path more, some with another member more, some broken."""
    k, path = (F.col("event_id") % 100).cast("int"), F.concat(F.lit("/tmp/\""), "event_id")
    plain = F.to_json(F.struct(path.alias("path"), k.alias("k")))
    other = F.when(F.col("event_id") % 7 == 0, "{broken").when(F.col("event_id") % 5 == 0, F.to_json(F.struct(path.alias("path"), k.alias("k"), F.lit("x").alias("more")))).otherwise(plain)
    return table(spark, d, "events").select("event_id", S.same_document(F.col("props"), other, ["path"]).alias("same"))


@query("""
SELECT doc_id, CASE WHEN n_chars <= 1022 THEN [0] ELSE list_distinct(list_concat(range(0, n_chars - 1022 + 1, 766), [n_chars - 1022])) END AS starts_raw FROM documents""".replace("SELECT doc_id, CASE", "SELECT doc_id, len(s) AS n_windows, list_sum(s)::BIGINT AS sum_starts, list_max(s)::BIGINT AS last_start FROM (SELECT doc_id, CASE").replace("AS starts_raw FROM documents", "AS s FROM documents)"))
def window_plan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", S.window_starts(F.col("n_chars"), 1022, 256).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return docs.select("doc_id", F.size("s").alias("n_windows"), total.alias("sum_starts"), F.array_max("s").cast("long").alias("last_start"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))")
def running_offsets(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.max("l_quantity").cast("long").alias("n"))
    return ranking.running_offsets(li, "l_orderkey", "l_linenumber", "n").drop("n")


@query("""
WITH c AS (SELECT p_brand, p_partkey, p_name AS s, coalesce(sum(length(p_name)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM part)
SELECT p_brand, p_partkey, i AS index_in_chain, s[i + 1] AS letter, (off + i)::BIGINT AS residue_order FROM (SELECT *, unnest(range(length(s)))::INT AS i FROM c)""")
def residue_index(spark, d):
    return ranking.residue_index(table(spark, d, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey", "p_name")


@query("SELECT letter, n, CASE letter WHEN 'a' THEN 4 WHEN 'c' THEN 5 WHEN 'g' THEN 6 WHEN 'u' THEN 7 END AS token, CASE WHEN letter IN ('a', 'c', 'g', 'u') THEN 'NATIVE' ELSE 'UNKNOWN_TOKEN' END AS policy FROM (SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS letter FROM part) GROUP BY 1)")
def observed_symbols(spark, d):
    tokens = spark.createDataFrame([("a", 4), ("c", 5), ("g", 6), ("u", 7)], "letter string, token int")
    return coordinates.observed_symbols(table(spark, d, "part"), "p_name", tokens)


def name_pairs(spark, d):
    """(p_partkey, a, b): each part's name, and that of the next part."""
    p = table(spark, d, "part").select("p_partkey", F.upper(F.translate("p_name", " ", "")).alias("a"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")


#: Pairs of names, as name_pairs gives them.
PAIRS_SQL = "p AS (SELECT x.p_partkey, upper(replace(x.p_name, ' ', '')) AS a, upper(replace(y.p_name, ' ', '')) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"


@query(f"""
WITH RECURSIVE {PAIRS_SQL}, d AS (SELECT a, b, length(a) AS n, length(b) AS m, 2199023255552 AS s, 1048576 AS k FROM (SELECT DISTINCT a, b FROM p)),
r AS (SELECT a, b, 0 AS i, list_transform(range(m + 1), lambda j: -j * (s + 1)) AS v FROM d
  UNION ALL SELECT a, b, i, list_transform(range(m + 1), lambda j: list_max(list_transform(range(j + 1), lambda c: h[c + 1] - (j - c) * (s + 1))))
  FROM (SELECT r.a, r.b, r.i + 1 AS i, m, s, list_transform(range(m + 1), lambda j: greatest(v[j + 1] - s - 1, CASE WHEN j > 0 THEN v[j] + CASE WHEN r.a[r.i + 1] = r.b[j] THEN s + k ELSE -s END - 1 ELSE v[j + 1] - s - 1 END)) AS h FROM r JOIN d ON d.a = r.a AND d.b = r.b WHERE r.i < n)),
e AS (SELECT d.*, v[m + 1] - floor((v[m + 1] + k)::DOUBLE / s)::BIGINT * s AS rest FROM r JOIN d ON d.a = r.a AND d.b = r.b AND i = n)
SELECT p_partkey, p.a, p.b, round(CASE WHEN p.a = p.b THEN 1.0 ELSE ceil(rest::DOUBLE / k) / (ceil(rest::DOUBLE / k) * k - rest) END, 6) AS identity FROM p JOIN e ON e.a = p.a AND e.b = p.b""")
def seq_identity(spark, d):
    return sequences.pair_identity(name_pairs(spark, d), "a", "b").withColumn("identity", F.round("identity", 6))


def affine_sql(pairs: str) -> str:
    """CTEs w (p_partkey, i, j): residues in one column, for pairs p (p_partkey, a, b)."""
    best = lambda col, *costs: (c := [f"{n}[{col}] - {k}" for n, k in zip("mxy", costs, strict=True)]) and f"CASE WHEN {c[0]} >= greatest({c[1]}, {c[2]}) THEN 0 WHEN {c[1]} >= {c[2]} THEN 1 ELSE 2 END"
    return f"""{pairs},
r AS (SELECT p_partkey, 0 AS i, list_transform(range(length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE -100000 END) AS m, list_transform(range(length(b) + 1), lambda j: -100000) AS x, list_transform(range(length(b) + 1), lambda j: CASE WHEN j = 0 THEN -100000 ELSE -2 - j END) AS y FROM p
  UNION ALL SELECT p_partkey, i, m, x, list_transform(range(len(m)), lambda j: CASE WHEN j = 0 THEN -100000 ELSE list_max(list_transform(range(j), lambda c: greatest(m[c + 1], x[c + 1]) - 2 - j + c)) END)
  FROM (SELECT p.p_partkey, i + 1 AS i, list_transform(range(len(m)), lambda j: CASE WHEN j = 0 THEN -100000 ELSE greatest(m[j], x[j], y[j]) + CASE WHEN a[i + 1] = b[j] THEN 2 ELSE -1 END END) AS m,
          list_transform(range(len(m)), lambda j: greatest(m[j + 1] - 3, x[j + 1] - 1, y[j + 1] - 3)) AS x FROM r JOIN p ON p.p_partkey = r.p_partkey WHERE i < length(a))),
t AS (SELECT p.p_partkey, i, length(b) AS j, {best("length(b) + 1", 0, 0, 0)} AS s FROM r JOIN p ON p.p_partkey = r.p_partkey AND i = length(a)
  UNION ALL SELECT t.p_partkey, r.i, t.j - (t.s <> 1)::INT, CASE t.s WHEN 0 THEN {best("t.j", 0, 0, 0)} WHEN 1 THEN {best("t.j + 1", 3, 1, 3)} ELSE {best("t.j", 3, 3, 1)} END
  FROM t JOIN r ON r.p_partkey = t.p_partkey AND r.i = t.i - (t.s <> 2)::INT WHERE t.i > 0 OR t.j > 0),
w AS (SELECT p_partkey, i, j FROM t WHERE s = 0 AND i > 0 AND j > 0)"""


@query(f"WITH RECURSIVE {affine_sql(PAIRS_SQL)} SELECT p_partkey, (i - 1)::INT AS gt_idx, (j - 1)::INT AS pred_idx FROM w")
def residue_maps(spark, d):
    return alignment.residue_maps(name_pairs(spark, d), "p_partkey", "a", "b")


@query(f"""
WITH RECURSIVE {affine_sql(PAIRS_SQL)}, c AS (SELECT w.p_partkey, count(*) AS n, count(*) FILTER (a[i] = b[j]) AS same FROM w JOIN p ON p.p_partkey = w.p_partkey GROUP BY 1)
SELECT p.p_partkey, a, b, round(coalesce(same / greatest(length(a), length(b)), 0), 6) AS identity, coalesce(n, 0)::INT AS aligned FROM p LEFT JOIN c ON c.p_partkey = p.p_partkey""")
def report_identity(spark, d):
    """By affine gaps and the longer length."""
    return alignment.report_identity(name_pairs(spark, d), "a", "b").withColumn("identity", F.round("identity", 6))


_FULL = "greatest(longest, n) * (held + 1) > 40000 OR held >= 64"


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, n_chars + 2 AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
r AS (SELECT doc_id, i, 0 AS batch_no, n AS longest, 1 AS held FROM d WHERE i = 1
  UNION ALL SELECT d.doc_id, d.i, batch_no + (CASE WHEN {_FULL} THEN 1 ELSE 0 END), CASE WHEN {_FULL} THEN n ELSE greatest(longest, n) END, CASE WHEN {_FULL} THEN 1 ELSE held + 1 END FROM r JOIN d ON d.i = r.i + 1)
SELECT doc_id, batch_no FROM r""")
def batch_pack(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 250).alias("part"))
    return packing.pack_batches(docs, "part", "doc_id", "n_chars", max_tokens=40_000).select("doc_id", "batch_no")


_LEAST = "list_position(loads, list_min(loads))"


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY n_chars, doc_id) AS i FROM documents),
r AS (SELECT doc_id, i, 0 AS bin, [n, 0, 0, 0] AS loads FROM d WHERE i = 1
  UNION ALL SELECT d.doc_id, d.i, {_LEAST} - 1, [{", ".join(f"loads[{b}] + CASE WHEN {_LEAST} = {b} THEN n ELSE 0 END" for b in range(1, 5))}] FROM r JOIN d ON d.i = r.i + 1)
SELECT doc_id, bin FROM r""")
def least_loaded(spark, d):
    return packing.least_loaded(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], "n_chars", 4).select("doc_id", "bin")


_NAMES, _LETTERS = ("A", " ade ", "GUA", "5MC", "?", "u"), ("c", " G ", "xx")


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'G' WHEN 5 THEN 'U' ELSE CASE p_partkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'G' ELSE 'X' END END AS letter FROM part")
def residue_letters(spark, d):
    at = lambda values, k: F.array(*map(F.lit, values))[k.cast("int")]
    return table(spark, d, "part").select("p_partkey", S.residue_letter(at(_NAMES, F.col("p_size") % 6), at(_LETTERS, F.col("p_partkey") % 3)).alias("letter"))


@query("SELECT l_orderkey, l_linenumber, CASE l_partkey % 8 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 3 THEN 12 WHEN 4 THEN 30 WHEN 7 THEN 26 END AS number FROM lineitem WHERE l_partkey % 8 IN (0, 1, 3, 4, 7)")
def atomic_numbers(spark, d):
    """Atoms of hydrogen and of elements that aren't used go."""
    symbol = F.array(*map(F.lit, ("C", "n", "H", "MG", "Zn", "Q", "D", " fe ")))[(F.col("l_partkey") % 8).cast("int")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.atomic_number(symbol).alias("number")).filter("number IS NOT NULL")


@query("SELECT p_partkey, upper(replace(trim(p_name), 'o', chr(39))) AS atom FROM part")
def atom_names(spark, d):
    return table(spark, d, "part").select("p_partkey", S.atom_name(F.concat(F.lit(" "), F.translate("p_name", "o", "*"))).alias("atom"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN 'e' || p_partkey END AS id, CASE WHEN p_size % 4 <> 0 THEN p_size::INT END AS seed, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS source FROM part")
def sample_files(spark, d):
    name = F.concat(F.lit("e"), F.col("p_partkey").cast("string"), F.lit("_x_s"), F.col("p_size").cast("string"), F.lit("_"), "p_brand", F.when(F.col("p_size") % 4 == 0, ".cif").otherwise(".pt"))
    return table(spark, d, "part").withColumn("f", S.sample_file(name)).select("p_partkey", "f.id", "f.seed", "f.source")


@query("SELECT doc_id, sha256(translate(right(coalesce(text, ''), 3000), chr(13) || chr(10), '  ')) AS excerpt, length(substr(text, 1, 32000)) AS cell FROM documents")
def log_cells(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(S.log_excerpt(F.col("text")), 256).alias("excerpt"), F.length(S.sheet_cell(F.col("text"))).alias("cell"))


@query("SELECT page_id, page_id % 5 <> 3 AS has_rna, page_id % 5 = 0 AS pure_rna FROM pages")
def rna_entries(spark, d):
    types = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in (("Polyribonucleotide",), ("polypeptide(L)", "polyribonucleotide"), ("polydeoxyribonucleotide/polyribonucleotide hybrid",), ("polydeoxyribonucleotide",), ("polyribonucleotide", "polydeoxyribonucleotide"))]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", S.contains_rna(types).alias("has_rna"), S.is_pure_rna(types).alias("pure_rna"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS nth FROM (SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, min(l_suppkey) FROM lineitem GROUP BY ALL)")
def occurrences(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey").distinct()
    return joins.occurrence(li, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey"]).drop("l_returnflag")
