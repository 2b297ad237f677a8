"""Joins, pairing, graph and set queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.operators import graph, joins, ranking, sequences, stats

from .registry import query, table


@query("SELECT c_custkey, n_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def validated_join(spark, d):
    nation = joins.assert_unique(table(spark, d, "nation"), "n_nationkey")
    c = joins.assert_unique(table(spark, d, "customer"), "c_custkey")
    return c.join(F.broadcast(nation), c["c_nationkey"] == nation["n_nationkey"], "left").select("c_custkey", "n_nationkey", "n_name", "n_regionkey")


@query("SELECT o.o_orderkey, n_lines FROM orders o LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey)")
def one_to_one_join(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return joins.one_to_one(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)")
def select_for_run(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.select_for_run(table(spark, d, "customer").select("c_custkey"), [o, o.filter("o_orderstatus = 'F'")], [o.filter("o_totalprice > 480000")], "c_custkey")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0),
m AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS x, b.k IS NOT NULL AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT count(*) FILTER (x) AS n_a, count(*) FILTER (y) AS n_b, count(*) AS n_union, count(*) FILTER (x AND y) AS n_both, count(*) FILTER (x AND NOT y) AS n_only_a, count(*) FILTER (y AND NOT x) AS n_only_b,
  count(*) FILTER (x <> y) = 0 AS equal, count(*) FILTER (x AND y) = 0 AS disjoint FROM m""")
def set_report(spark, d):
    return joins.set_report(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT k FROM (SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION SELECT k FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)")
def set_difference(spark, d):
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return a.exceptAll(b).union(b.exceptAll(a)).distinct()


@query("""
SELECT d.doc_id, CASE WHEN s.doc_id IS NOT NULL THEN s.quality::DOUBLE WHEN n_chars >= 500 THEN n_chars / 1000.0 END AS quality,
  CASE WHEN s.doc_id IS NOT NULL THEN 'foldbench_full' WHEN n_chars >= 500 THEN 'rigid_only_rescue' ELSE 'unavailable' END AS protocol
FROM documents d LEFT JOIN labels s ON s.doc_id = d.doc_id AND s.toxic = 0""")
def standard_or_rescue(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    std = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 0).alias("ok"), F.col("quality").cast("double").alias("quality"))
    res = docs.select("doc_id", (F.col("n_chars") >= 500).alias("ok"), (F.col("n_chars") / 1000.0).alias("quality"))
    return joins.standard_or_rescue(docs.select("doc_id"), std, res, ["doc_id"], "ok", "quality")


@query("""
SELECT o_orderkey, o_custkey, o_totalprice AS score, n_name AS path, concat_ws('; ', CASE WHEN o_totalprice IS NULL OR o_totalprice < 5000 THEN 'missing confidence score' END, CASE WHEN n_name IS NULL THEN 'missing reference' END) AS discovery_issue
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice >= 5000 THEN o_totalprice END AS o_totalprice FROM orders) LEFT JOIN
  (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def assemble_candidates(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    refs = c.filter("c_acctbal > 0").join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("path"))
    score = o.filter("o_totalprice >= 5000").select("o_orderkey", F.col("o_totalprice").alias("score"))
    return joins.assemble(o.select("o_orderkey", "o_custkey"), score, refs, ["o_orderkey"], "o_custkey").select("o_orderkey", "o_custkey", "score", "path", "discovery_issue")


@query("""
WITH m AS (SELECT doc_id, (doc_id % 2)::INT AS v, doc_id % 50 = 7 AS gone FROM documents WHERE lang <> 'de'), l AS (SELECT doc_id, quality AS v FROM labels)
SELECT coalesce(m.doc_id, l.doc_id) AS doc_id, CASE WHEN m.doc_id IS NULL THEN 'EXTRA' WHEN gone AND l.doc_id IS NOT NULL THEN 'DROPPED_PRESENT' WHEN gone THEN 'OK' WHEN l.doc_id IS NULL THEN 'MISSING' WHEN m.v <> l.v THEN 'MISMATCH' ELSE 'OK' END AS status
FROM m FULL JOIN l ON m.doc_id = l.doc_id""")
def reconcile(spark, d):
    manifest = table(spark, d, "documents").filter("lang <> 'de'").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("v"), (F.col("doc_id") % 50 == 7).alias("gone"))
    return joins.reconcile(manifest, table(spark, d, "labels").select("doc_id", F.col("quality").alias("v")), "doc_id", "v", F.col("gone"))


@query("""
WITH g AS (SELECT user_id, s AS seed, k AS sample FROM (SELECT DISTINCT user_id FROM events), (VALUES (0), (1), (2)) a(s), (VALUES (0), (1), (2), (3)) b(k)),
o AS (SELECT user_id, (event_id % 4)::INT AS seed, (event_id // 7 % 4)::INT AS sample, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT coalesce(g.user_id, o.user_id) AS user_id, g.user_id IS NOT NULL AS want, coalesce(n, 0) AS n, coalesce(g.seed, o.seed)::VARCHAR || '/' || coalesce(g.sample, o.sample)::VARCHAR AS label
  FROM g FULL JOIN o ON g.user_id = o.user_id AND g.seed = o.seed AND g.sample = o.sample)
SELECT user_id, count(*) FILTER (want) AS n_expected, coalesce(sum(n) FILTER (want), 0)::BIGINT AS n_observed, coalesce(string_agg(label, ',' ORDER BY label) FILTER (want AND n = 0), '') AS missing,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (NOT want), '') AS extra, count(*) FILTER (n > 1) AS n_duplicate, bool_and(want AND n = 1) AS complete FROM m GROUP BY user_id""")
def completeness(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).cast("int").alias("seed"), (F.floor(F.col("event_id") / 7) % 4).cast("int").alias("sample"))
    return joins.completeness(e.select("user_id"), {"seed": [0, 1, 2], "sample": [0, 1, 2, 3]}, e, "user_id")


def _sides(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 5).alias("s"), F.col("l_linenumber").cast("string").alias("chain"), "l_suppkey")
    a = a.groupBy("l_orderkey", "chain").agg(F.min("s").alias("s"))
    return a, a.filter(~((F.col("l_orderkey") % 8 == 0) & (F.col("chain") == "2")))


_AB1 = "a AS (SELECT l_orderkey, l_linenumber::VARCHAR AS chain, min(l_partkey % 5) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT * FROM a WHERE NOT (l_orderkey % 8 = 0 AND chain = '2'))"


@query(f"""
WITH {_AB1}, x AS (SELECT l_orderkey, s, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT l_orderkey, s, count(*) AS n FROM b GROUP BY 1, 2)
SELECT coalesce(x.l_orderkey, y.l_orderkey) AS l_orderkey, bool_and(x.n IS NOT DISTINCT FROM y.n) AS same FROM x FULL JOIN y ON x.l_orderkey = y.l_orderkey AND x.s = y.s GROUP BY 1""")
def multiset_equality(spark, d):
    return stats.same_multiset(*_sides(spark, d), "l_orderkey", "s")


_PAIRS = f"""{_AB1},
x AS (SELECT l_orderkey, s, chain AS chain_a, row_number() OVER (PARTITION BY l_orderkey, s ORDER BY chain) AS nth, count(*) OVER (PARTITION BY l_orderkey, s) AS n FROM a),
y AS (SELECT l_orderkey, s, chain AS chain_b, row_number() OVER (PARTITION BY l_orderkey, s ORDER BY chain) AS nth, count(*) OVER (PARTITION BY l_orderkey, s) AS n FROM b),
p AS (SELECT coalesce(x.l_orderkey, y.l_orderkey) AS l_orderkey, coalesce(x.s, y.s) AS s, chain_a, chain_b,
  CASE WHEN chain_a IS NULL OR chain_b IS NULL THEN 'NO_MATCH' WHEN x.n = 1 AND y.n = 1 THEN 'EXACT_UNIQUE' ELSE 'ORDER_ASSUMED' END AS status
  FROM x FULL JOIN y ON x.l_orderkey = y.l_orderkey AND x.s = y.s AND x.nth = y.nth)"""


@query(f"WITH {_PAIRS} SELECT * FROM p")
def nth_pairing(spark, d):
    return joins.pair_equal_sequences(*_sides(spark, d), "l_orderkey", "s", "chain")


@query(f"""
WITH {_PAIRS.replace("b AS (SELECT * FROM a WHERE NOT (l_orderkey % 8 = 0 AND chain = '2'))", "b AS (SELECT l_orderkey, chain, CASE WHEN chain = '2' THEN 99 ELSE s END AS s FROM a)")},
l AS (SELECT l_orderkey, min(chain_a) AS chain_a FROM p WHERE chain_b IS NULL GROUP BY 1 HAVING count(*) = 1), r AS (SELECT l_orderkey, min(chain_b) AS chain_b FROM p WHERE chain_a IS NULL GROUP BY 1 HAVING count(*) = 1)
SELECT l_orderkey, chain_a, chain_b FROM l JOIN r USING (l_orderkey)""")
def residual_pairing(spark, d):
    a, _ = _sides(spark, d)
    b = a.withColumn("s", F.when(F.col("chain") == "2", F.lit(99).cast("long")).otherwise(F.col("s")))
    return joins.pair_residual(joins.pair_equal_sequences(a, b, "l_orderkey", "s", "chain"), "l_orderkey")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber::VARCHAR AS chain, min(l_partkey % 5) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, CASE WHEN chain IN ('1', '3') THEN 'X' || chain ELSE chain END AS chain, s FROM a),
i AS (SELECT a.l_orderkey, a.chain AS chain_a, b.chain AS chain_b, 'BY_ID' AS how, a.s = b.s AS same_sequence FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.chain = b.chain),
la AS (SELECT a.l_orderkey, a.s, min(a.chain) AS chain_a FROM a ANTI JOIN i ON i.l_orderkey = a.l_orderkey AND i.chain_a = a.chain GROUP BY 1, 2 HAVING count(*) = 1),
lb AS (SELECT b.l_orderkey, b.s, min(b.chain) AS chain_b FROM b ANTI JOIN i ON i.l_orderkey = b.l_orderkey AND i.chain_b = b.chain GROUP BY 1, 2 HAVING count(*) = 1),
q AS (SELECT * FROM i UNION ALL SELECT l_orderkey, chain_a, chain_b, 'BY_SEQUENCE', true FROM la JOIN lb USING (l_orderkey, s))
SELECT * FROM q UNION ALL SELECT a.l_orderkey, a.chain, NULL, 'UNRESOLVED', NULL FROM a ANTI JOIN q ON q.l_orderkey = a.l_orderkey AND q.chain_a = a.chain""")
def compare_chains(spark, d):
    a, _ = _sides(spark, d)
    b = a.withColumn("chain", F.when(F.col("chain").isin("1", "3"), F.concat(F.lit("X"), "chain")).otherwise(F.col("chain")))
    return joins.compare_chains(a, b, "l_orderkey", "chain", "s")


@query("""
WITH f AS (SELECT source AS k, doc_id::VARCHAR AS path FROM documents WHERE lang <> 'de'), w AS (SELECT k, count(*) AS n, min(path) AS sole FROM f GROUP BY 1)
SELECT e.k, e.path, CASE WHEN f.path IS NOT NULL THEN e.path WHEN n = 1 THEN sole END AS resolved, CASE WHEN f.path IS NOT NULL THEN 'DIRECT' WHEN n = 1 THEN 'REBASED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status
FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE source END AS k, doc_id::VARCHAR AS path FROM documents) e LEFT JOIN f ON e.path = f.path LEFT JOIN w ON w.k = e.k""")
def resolve_paths(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("k"), F.col("doc_id").cast("string").alias("path"), "doc_id", "lang")
    entries = docs.withColumn("k", F.when(F.col("doc_id") % 5 == 0, "none").otherwise(F.col("k"))).drop("doc_id", "lang")
    return joins.resolve_paths(entries, docs.filter("lang <> 'de'").drop("doc_id", "lang"), "k")


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place, 'm' || l_orderkey || '/' || l_linenumber AS path FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
f AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN path ELSE 'n' || path END AS file, CASE WHEN l_orderkey % 2 = 0 AND l_linenumber <= 2 THEN l_linenumber END AS folder FROM e WHERE NOT (l_orderkey % 5 = 0 AND l_linenumber = 1)),
b AS (SELECT l_orderkey, folder, min(file) AS file FROM f WHERE folder IS NOT NULL GROUP BY ALL),
t AS (SELECT l_orderkey, file, row_number() OVER (PARTITION BY l_orderkey ORDER BY file) - 1 AS turn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM f)
SELECT e.l_orderkey, place, path, CASE WHEN f.file IS NOT NULL THEN path ELSE coalesce(b.file, t.file) END AS resolved, CASE WHEN f.file IS NOT NULL THEN 'DIRECT' WHEN b.file IS NOT NULL OR t.file IS NOT NULL THEN 'REBASED' ELSE 'MISSING' END AS status
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM e) e LEFT JOIN f ON f.file = e.path LEFT JOIN b ON b.l_orderkey = e.l_orderkey AND b.folder = place
LEFT JOIN t ON t.l_orderkey = e.l_orderkey AND turn = place AND t.n = e.n""")
def resolve_paths_in_order(spark, d):
    """By folder number, or by the order of files where their number is right."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("place", F.row_number().over(w) - 1).withColumn("path", F.concat(F.lit("m"), "l_orderkey", F.lit("/"), "l_linenumber"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    f = e.filter(~((k % 5 == 0) & (n == 1))).select("l_orderkey", F.when(k % 3 == 0, F.col("path")).otherwise(F.concat(F.lit("n"), "path")).alias("path"), F.when((k % 2 == 0) & (n <= 2), n).alias("folder"))
    return joins.resolve_paths_in_order(e.drop("l_linenumber"), f, "l_orderkey")


@query("""
SELECT c_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'existing' WHEN b.v IS NOT NULL THEN 'cache' ELSE 'unresolved' END AS source_type FROM customer
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def source_priority(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("v"), "o_orderstatus")
    return joins.by_priority(table(spark, d, "customer").select("c_custkey"), [("existing", o.filter("o_orderstatus = 'F'")), ("cache", o.filter("o_orderstatus = 'O'"))], "c_custkey", "v")


@query("SELECT CASE WHEN f IS NOT NULL THEN 'existing' ELSE 'unresolved' END AS source_type, count(*) AS n FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def source_counts(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("v"))
    return stats.value_counts(joins.by_priority(table(spark, d, "customer").select("c_custkey"), [("existing", o)], "c_custkey", "v"), "source_type")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_extendedprice > 80000)")
def remove_over_threshold(spark, d):
    li = table(spark, d, "lineitem")
    return joins.remove_over_threshold(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), li, ["l_partkey", "l_suppkey"], F.col("l_extendedprice"), 80000).select("l_orderkey", "l_linenumber")


@query("""
WITH p AS (SELECT p_partkey, p_name AS s1, CASE WHEN p_size % 4 = 0 THEN replace(p_name, 'o', 'N') WHEN p_size % 4 = 1 THEN p_name || 'x' WHEN p_size % 4 = 2 THEN replace(p_name, 'e', 'q') ELSE p_name END AS s2, p_size FROM part),
m AS (SELECT p_partkey, s1, CASE WHEN p_size = 7 THEN NULL ELSE s2 END AS s2 FROM p),
z AS (SELECT p_partkey, s1, s2, list_max(list_transform(range(1, length(s1) + 1), lambda i: CASE WHEN s1[i] = s2[i] THEN 0 WHEN s1[i] = 'N' OR s2[i] = 'N' THEN 1 ELSE 2 END)) AS w FROM m)
SELECT p_partkey, CASE WHEN s2 IS NULL THEN 'ABSENT_EXPECTED' WHEN length(s1) <> length(s2) THEN 'LENGTH_CONFLICT' WHEN w = 2 THEN 'BASE_CONFLICT' WHEN w = 1 THEN 'UNKNOWN_ONLY' ELSE 'OK' END AS status FROM z""")
def sequence_check(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_size") % 4
    other = F.when(k == 0, F.replace("p_name", F.lit("o"), F.lit("N"))).when(k == 1, F.concat("p_name", F.lit("x"))).when(k == 2, F.replace("p_name", F.lit("e"), F.lit("q"))).otherwise(F.col("p_name"))
    return joins.sequence_check(p.select("p_partkey", F.col("p_name").alias("sequence")), p.filter("p_size <> 7").select("p_partkey", other.alias("sequence")), ["p_partkey"])


@query("SELECT label, bool_and(n = 1) AS consistent FROM (SELECT label, vec_id % 7 AS dig, i, count(DISTINCT v) AS n FROM (SELECT label, vec_id, unnest(range(0, 4)) AS i, CASE WHEN label < 5 THEN vec_id % 7 ELSE vec_id END AS v FROM embeddings) GROUP BY ALL) GROUP BY label")
def consistent_copies(spark, d):
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("dig"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"), F.array(F.when(F.col("label") < 5, F.col("vec_id") % 7).otherwise(F.col("vec_id"))).alias("v"))
    return joins.consistent_copies(e, "label", "dig", "i", "v")


_HIT = "SELECT DISTINCT l_orderkey AS query, l_partkey AS target, l_discount * 5 + 0.5 AS identity, l_tax * 8 + 0.3 AS qcov, (l_quantity / 50) AS tcov, l_linenumber FROM lineitem"


def _hits(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), (F.col("l_discount") * 5 + 0.5).alias("identity"), (F.col("l_tax") * 8 + 0.3).alias("qcov"), (F.col("l_quantity") / 50).alias("tcov"), "l_linenumber")


@query(f"WITH h AS ({_HIT}) SELECT query, target, round(identity, 4) AS identity, round(qcov, 4) AS qcov, round(tcov, 4) AS tcov FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(identity, 6) DESC, round(qcov, 6) DESC, round(tcov, 6) DESC, target) = 1")
def best_hits(spark, d):
    h = _hits(spark, d).select("query", "target", *[F.round(c, 6).alias(c) for c in ("identity", "qcov", "tcov")])
    return ranking.best_hits(h, ["query"], ["target"]).select("query", "target", *[F.round(c, 4).alias(c) for c in ("identity", "qcov", "tcov")])


@query(f"""
WITH h AS (SELECT query, target, round(identity, 6) AS identity, round(qcov, 6) AS qcov, round(tcov, 6) AS tcov, l_linenumber <= 3 AS is_primary FROM ({_HIT}))
SELECT query, target, identity, qcov, tcov, is_primary FROM h QUALIFY row_number() OVER (PARTITION BY query, target ORDER BY identity DESC, qcov DESC, tcov DESC, is_primary DESC) = 1""")
def merge_hits(spark, d):
    h = _hits(spark, d).select("query", "target", *[F.round(c, 6).alias(c) for c in ("identity", "qcov", "tcov")], "l_linenumber")
    return ranking.merge_hits((h.filter("l_linenumber <= 3"), True), (h.filter("l_linenumber > 3"), False))


@query(f"SELECT query, target, round(identity, 4) AS identity, round(qcov, 4) AS qcov, round(tcov, 4) AS tcov FROM (SELECT query, target, identity, qcov, CASE WHEN tcov > 1 THEN tcov / 100 ELSE tcov END AS tcov FROM ({_HIT})) WHERE round(identity, 9) >= 0.7 AND round(qcov, 9) >= 0.7 AND tcov >= 0.7 AND query <> target")
def filter_hits(spark, d):
    h = _hits(spark, d).drop("l_linenumber").distinct().select("query", "target", *[F.round(c, 9).alias(c) for c in ("identity", "qcov", "tcov")])
    h = sequences.filter_hits(h, 0.7, 0.7)
    return h.select("query", "target", *[F.round(c, 4).alias(c) for c in ("identity", "qcov", "tcov")])


_HOSTS = "h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages WHERE url LIKE '%://%')"
_HOST_PAIRS = f"""{_HOSTS}, e AS (SELECT a.host AS a, b.host AS b, levenshtein(a.host, b.host) AS distance FROM h a JOIN h b ON a.host < b.host
  AND levenshtein(a.host, b.host) <= floor((1 - 0.8 + 1e-12) * greatest(length(a.host), length(b.host))))"""


def _hosts(spark, d):
    return table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).filter("host <> ''").distinct()


@query(f"WITH {_HOST_PAIRS} SELECT a, b, distance, round(1 - distance / greatest(length(a), length(b)), 6) AS identity FROM e")
def homology_pairs(spark, d):
    return sequences.similar_pairs(_hosts(spark, d), "host", 0.8).withColumn("identity", F.round("identity", 6))


@query("""
WITH h AS (SELECT DISTINCT p_name AS s FROM part)
SELECT a.s AS a, b.s AS b, levenshtein(a.s, b.s) AS distance, round(1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)), 6) AS identity FROM h a JOIN h b ON a.s < b.s
WHERE least(length(a.s), length(b.s)) < 15 AND levenshtein(a.s, b.s) <= floor((1 - 0.75 + 1e-12) * greatest(length(a.s), length(b.s)))""")
def short_similarity(spark, d):
    return sequences.similar_pairs(table(spark, d, "part"), "p_name", 0.75, short=15).withColumn("identity", F.round("identity", 6))


@query(f"""
WITH RECURSIVE {_HOST_PAIRS}, l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(host, reach) AS (SELECT host, host FROM h UNION SELECT r.host, l.b FROM r JOIN l ON l.a = r.reach)
SELECT host, min(reach) AS component, format('cluster_{{:04d}}', dense_rank() OVER (ORDER BY min(reach))) AS cluster_id FROM r GROUP BY host""")
def homology_components(spark, d):
    h = _hosts(spark, d)
    return ranking.number_components(graph.components(h, sequences.similar_pairs(h, "host", 0.8), "host"), "component")


@query(f"""
WITH RECURSIVE {_HOST_PAIRS}, l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
m AS (SELECT DISTINCT host FROM h JOIN l ON l.a = host WHERE ends_with(l.b, '.org') AND NOT ends_with(host, '.org')),
t AS (SELECT host FROM h WHERE NOT ends_with(host, '.org')), k AS (SELECT host FROM t WHERE host NOT IN (SELECT host FROM m)),
r(host, reach) AS (SELECT host, host FROM k UNION SELECT r.host, l.b FROM r JOIN l ON l.a = r.reach WHERE l.b IN (SELECT host FROM k)),
c AS (SELECT host, min(reach) AS component FROM r GROUP BY host),
rep AS (SELECT component, host AS representative FROM c QUALIFY row_number() OVER (PARTITION BY component ORDER BY length(host), host) = 1)
SELECT host, 'MASK_REFERENCE' AS status FROM m UNION ALL SELECT host, CASE WHEN host = representative THEN 'EVALUATE' ELSE 'MASK_INTERNAL' END FROM c JOIN rep USING (component)""")
def redundancy_mask(spark, d):
    pairs = sequences.similar_pairs(_hosts(spark, d), "host", 0.8)
    hits = pairs.select(F.col("a").alias("query"), F.col("b").alias("target"), "identity").unionByName(pairs.select(F.col("b").alias("query"), F.col("a").alias("target"), "identity")).withColumns({"qcov": F.lit(1.0), "tcov": F.lit(1.0)})
    org = lambda c: F.col(c).endswith(".org")
    tests = _hosts(spark, d).filter(~org("host")).withColumns({"resolution": F.length("host").cast("double"), "day": F.lit(None).cast("date")})
    return graph.mask_redundant(tests, hits.filter(~org("query") & org("target")), hits.filter(~org("query") & ~org("target")), "host", "resolution", "day").select("host", "status")


@query("""
SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = count(*) THEN 'KEEP_ALL' WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 THEN 'KEEP_PARTIAL' ELSE 'DROP' END AS status, count(*) AS total_chains,
  count(*) FILTER (o_orderstatus <> 'P') AS evaluate_count, count(*) FILTER (o_orderstatus = 'P') AS masked_count, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) FILTER (o_orderstatus <> 'P'), '') AS evaluate_ids,
  coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) FILTER (o_orderstatus = 'P'), '') AS masked_ids FROM orders GROUP BY 1""")
def entry_status(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("chain"), (F.col("o_orderstatus") != "P").alias("ev"))
    return graph.entry_status(o, "o_custkey", "chain", "ev")


@query("""
WITH g AS (SELECT o_custkey, bool_and(o_totalprice > 20000) AS a, bool_and(o_orderstatus <> 'P') AS b FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN a AND b THEN 'PASS' ELSE 'REVIEW' END AS status, concat_ws(';', CASE WHEN NOT a THEN 'coverage' END, CASE WHEN NOT b THEN 'unique' END) AS reasons FROM g""")
def accept_maps(spark, d):
    return graph.accept_maps(table(spark, d, "orders"), "o_custkey", coverage=F.col("o_totalprice") > 20000, unique=F.col("o_orderstatus") != "P")


@query("""
WITH o AS (SELECT user_id AS target, event_id // 3 AS cand, event_type AS key, min(value) AS rmsd FROM events GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY target, cand) AS n FROM o),
s AS (SELECT target, key, count(*) AS support FROM n WHERE n = 1 GROUP BY ALL)
SELECT target, cand, n.key, rmsd, coalesce(support, 0) AS support, n > 1 AS tie_break FROM n LEFT JOIN s ON s.target = n.target AND s.key = n.key
QUALIFY row_number() OVER (PARTITION BY n.target, cand ORDER BY coalesce(support, 0) DESC, rmsd, n.key) = 1""".replace("SELECT target, cand, n.key", "SELECT n.target, cand, n.key"))
def consensus_choice(spark, d):
    o = table(spark, d, "events").groupBy(F.col("user_id").alias("target"), F.floor(F.col("event_id") / 3).alias("cand"), F.col("event_type").alias("key")).agg(F.min("value").alias("rmsd"))
    return ranking.consensus(o, "cand", "target", "key", "rmsd").select("target", "cand", "key", "rmsd", "support", "tie_break")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_discount DESC, l_partkey, l_tax) = 1")
def alternate_location(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("occupancy"), F.col("l_partkey").alias("alt_id"), "l_tax")
    return ranking.alternate_location(a, ["l_orderkey", "l_linenumber"], "l_tax").withColumnsRenamed({"occupancy": "l_discount", "alt_id": "l_partkey"})


@query("SELECT user_id, event_type, max(value) AS value FROM events WHERE (user_id, event_type) IN (SELECT user_id, event_type FROM events WHERE value > 40) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, event_type) = 1")
def best_existing_seed(spark, d):
    e = table(spark, d, "events")
    scores = e.groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return ranking.best_existing_seed(scores, e.filter("value > 40"), "user_id", "event_type", "value").select("user_id", "event_type", "value")


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, url FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY page_id % 3 = 0 DESC, len(string_split(url, '/')), length(url), url) = 1")
def preferred_path(spark, d):
    p = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "url", "page_id")
    return ranking.preferred_path(p, "host", "url", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise("none")).select("host", "url")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', event_id) = 1")
def first_report_row(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return ranking.first_report_row(e, "user_id", F.col("event_type") == "error", "event_id")
