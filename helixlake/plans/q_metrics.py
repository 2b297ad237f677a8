"""Rank-1, descriptions, strata and distributions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.functions import scalars as S
from helixlake.operators import ranking, stats

from .registry import query, table

LABELS = [label for label, _ in S.LENGTH_BINS]


def candidates(spark, d):
    """Events as candidates: a user is a target, errors have no metric."""
    e = table(spark, d, "events")
    ok = F.col("event_type") != "error"
    return e.select(F.col("user_id").alias("pdb_id"), (F.col("event_id") % 5).alias("seed"), F.col("event_id").alias("sample"), F.col("value").alias("ranking_score"), F.when(ok, F.col("value") / 10).alias("rmsd"), F.when(ok, "SUCCESS").otherwise("ost_failure").alias("eval_status"), "event_type", "ts")


def rounded(df, *keep):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def sql_describe(v: str) -> str:
    pct = ", ".join(f"round(quantile_cont({v}, {p}), 9) AS p{round(p * 100)}" for p in stats.PERCENTILES)
    le = ", ".join(f"round(100.0 * count(*) FILTER ({v} <= {t}) / nullif(count({v}), 0), 9) AS pct_le_{t}" for t in stats.DESCRIBE_THRESHOLDS)
    return f"count(*) AS n_total, count({v}) AS n_with, count(*) - count({v}) AS n_missing, round(100.0 * count({v}) / count(*), 9) AS coverage_percent, round(avg({v}), 9) AS mean, round(stddev_samp({v}), 9) AS std, round(min({v}), 9) AS min, {pct}, round(max({v}), 9) AS max, {le}"


def sql_final(v: str) -> str:
    le = ", ".join(f"round(100.0 * count(*) FILTER ({v} <= {t}) / nullif(count({v}), 0), 9) AS pct_le_{t}" for t in stats.FINAL_THRESHOLDS)
    q = lambda p: f"quantile_cont({v}, {p})"
    return f"count(*) AS n_total, count({v}) AS n_valid, count(*) - count({v}) AS n_excluded_or_missing, round(100.0 * count({v}) / count(*), 9) AS coverage_percent, round({q(0.5)}, 9) AS median, round({q(0.25)}, 9) AS q25, round({q(0.75)}, 9) AS q75, round({q(0.75)} - {q(0.25)}, 9) AS iqr, round(avg({v}), 9) AS mean, round({q(0.9)}, 9) AS p90, round(max({v}), 9) AS max, {le}"


CAND = "(SELECT user_id AS pdb_id, event_id % 5 AS seed, event_id AS sample, value AS ranking_score, CASE WHEN event_type <> 'error' THEN value / 10 END AS rmsd, event_type, ts FROM events)"
LENGTH_SQL = "CASE WHEN {x} <= 20 THEN '1-20' WHEN {x} <= 50 THEN '21-50' WHEN {x} <= 100 THEN '51-100' WHEN {x} <= 200 THEN '101-200' ELSE '>200' END"


@query(f"""
WITH c AS {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY ranking_score DESC NULLS LAST, seed, sample) AS rn,
  max(ranking_score) OVER (PARTITION BY pdb_id) AS top FROM c),
g AS (SELECT pdb_id, count(*) AS candidate_count, count(rmsd) AS evaluated_count, min(rmsd) AS oracle_best, quantile_cont(rmsd, 0.5) AS median_metric,
  avg(rmsd) AS mean_metric, count(*) FILTER (top - ranking_score <= 1e-12) AS tie_count FROM r GROUP BY pdb_id)
SELECT r.pdb_id, seed, sample, ranking_score, rmsd, 'OK' AS selection_status, candidate_count, evaluated_count, round(oracle_best, 9) AS oracle_best,
  round(median_metric, 9) AS median_metric, round(mean_metric, 9) AS mean_metric, tie_count FROM r JOIN g USING (pdb_id) WHERE rn = 1""")
def rank1_strict(spark, d):
    c = candidates(spark, d)
    met = ranking.rank1(c).join(ranking.rank1_companions(c), "pdb_id").drop("eval_status", "event_type", "ts")
    return rounded(met, "ranking_score", "rmsd")


@query(f"SELECT {sql_describe('rmsd')} FROM {CAND}")
def describe_overall(spark, d):
    return rounded(stats.describe(candidates(spark, d), F.col("rmsd")))


@query(f"SELECT event_type, {sql_describe('rmsd')} FROM {CAND} GROUP BY event_type")
def describe_by_group(spark, d):
    return rounded(stats.describe(candidates(spark, d), F.col("rmsd"), "event_type"))


@query(f"""
WITH b AS (SELECT l_extendedprice / 1000 AS v, {LENGTH_SQL.format(x='l_quantity')} AS length_group FROM lineitem),
g AS (SELECT length_group, {sql_describe('v')} FROM b GROUP BY length_group),
dim(bin_order, length_group) AS (VALUES (0, '1-20'), (1, '21-50'), (2, '51-100'), (3, '101-200'), (4, '>200'))
SELECT bin_order, dim.length_group, coalesce(n_total, 0) AS n_total, coalesce(n_with, 0) AS n_with, coalesce(n_missing, 0) AS n_missing, g.* EXCLUDE (length_group, n_total, n_with, n_missing)
FROM dim LEFT JOIN g USING (length_group)""")
def describe_length_bins(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("v"), S.length_group(F.col("l_quantity")).alias("length_group"))
    return rounded(stats.describe_bins(rows, F.col("v"), "length_group", LABELS))


@query(f"""
WITH c AS {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY ranking_score DESC NULLS LAST, seed, sample) AS rn FROM c),
p AS (SELECT 'rank1' AS population, rmsd AS v FROM r WHERE rn = 1 UNION ALL SELECT 'all_successful', rmsd FROM c WHERE rmsd IS NOT NULL
  UNION ALL SELECT 'oracle_best', min(rmsd) FROM c GROUP BY pdb_id)
SELECT population, {sql_describe('v')} FROM p GROUP BY population""")
def describe_populations(spark, d):
    c = candidates(spark, d)
    best = ranking.rank1_companions(c).select(F.col("oracle_best").alias("rmsd"))
    return rounded(stats.describe_populations({"rank1": ranking.rank1(c), "all_successful": c.filter("rmsd IS NOT NULL"), "oracle_best": best}, "rmsd"))


_STRATA = f"""(SELECT CASE WHEN l_tax >= 0.01 AND l_suppkey % 10 <> 3 THEN l_extendedprice / 5000 END AS v,
  CASE WHEN l_shipdate > TIMESTAMP '1998-06-01' THEN 'post_cutoff' ELSE 'pre_or_on_cutoff' END AS time_group, {LENGTH_SQL.format(x='l_quantity')} AS length_group,
  CASE WHEN l_linenumber >= 5 THEN '>=5' ELSE l_linenumber::VARCHAR END AS chain_count_group FROM lineitem)"""


@query(f"""
WITH s AS {_STRATA}
SELECT 'overall' AS section, 'all' AS "group", {sql_final('v')} FROM s
UNION ALL SELECT 'time', time_group, {sql_final('v')} FROM s WHERE time_group = 'post_cutoff' GROUP BY time_group
UNION ALL SELECT 'length', length_group, {sql_final('v')} FROM s GROUP BY length_group
UNION ALL SELECT 'chains', chain_count_group, {sql_final('v')} FROM s GROUP BY chain_count_group""")
def final_main_table(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.when(F.col("l_tax") >= 0.01, F.col("l_extendedprice") / 5000).alias("v"), (F.col("l_suppkey") % 10 == 3).alias("excluded"), S.time_group(F.col("l_shipdate"), F.lit("1998-06-01").cast("timestamp")).alias("time_group"), S.length_group(F.col("l_quantity")).alias("length_group"), S.chain_count_group(F.col("l_linenumber")).alias("chain_count_group"))
    return rounded(stats.main_table(rows, "v", "excluded", "time_group", "length_group", "chain_count_group"))


@query("""
SELECT user_id AS pdb_id, count(*) AS candidate_count, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS valid_count, count(*) FILTER (event_type IN ('error', 'signup')) AS failed_count,
  coalesce(string_agg(DISTINCT event_type, ';' ORDER BY event_type) FILTER (event_type IN ('error', 'signup')), '') AS failure_reasons FROM events GROUP BY user_id""")
def candidate_audit(spark, d):
    return stats.candidate_audit(candidates(spark, d), "pdb_id", ~F.col("event_type").isin("error", "signup"), F.col("event_type"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY event_type")
def failure_counts(spark, d):
    return stats.value_counts(candidates(spark, d).filter(F.col("event_type").isin("error", "signup")), "event_type")


@query(f"""
WITH c AS {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY ranking_score DESC NULLS LAST, seed, sample) AS rn FROM c)
SELECT a.pdb_id, count(b.rmsd) AS n_lower_valid, count(b.rmsd) > 0 AS exists_lower_valid FROM r a LEFT JOIN r b ON b.pdb_id = a.pdb_id AND b.rn > 1 WHERE a.rn = 1 AND a.rmsd IS NULL GROUP BY a.pdb_id""")
def excluded_supplement(spark, d):
    c = candidates(spark, d)
    top = ranking.rank1(c)
    lower = c.join(top.select("pdb_id", "seed", "sample"), ["pdb_id", "seed", "sample"], "left_anti").groupBy("pdb_id").agg(F.count("rmsd").alias("n"))
    out = top.filter("rmsd IS NULL").select("pdb_id").join(lower, "pdb_id", "left").withColumn("n_lower_valid", F.coalesce("n", F.lit(0)))
    return out.select("pdb_id", "n_lower_valid", (F.col("n_lower_valid") > 0).alias("exists_lower_valid"))


@query("SELECT o_totalprice AS x, round(row_number() OVER (ORDER BY o_totalprice) / count(*) OVER ()::DOUBLE, 8) AS y FROM orders")
def ecdf(spark, d):
    return stats.ecdf(table(spark, d, "orders"), "o_totalprice").select("x", F.round("y", 8).alias("y"))


@query("""
SELECT t::DOUBLE AS threshold, count(*) FILTER (value > t) AS n_above, round(100.0 * count(*) FILTER (value > t) / count(*), 9) AS pct_above
FROM events, (VALUES (10), (20), (30), (50), (100)) AS x(t) GROUP BY t""")
def exceedance(spark, d):
    return rounded(stats.exceedance(table(spark, d, "events"), F.col("value"), (10, 20, 30, 50, 100)))


@query("SELECT least(floor(least(value, 20) / 0.2)::INT + 1, 100) AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(spark, d):
    return stats.histogram(table(spark, d, "events"), F.col("value"), 0, 20, 100)


_DIST = "count(value) AS n, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75), 9) AS q75, " + ", ".join(f"round(100.0 * count(*) FILTER (value < {t}) / count(value), 9) AS pct_lt_{t}" for t in (1, 2, 5))


@query(f"SELECT event_type, {_DIST} FROM events GROUP BY ROLLUP(event_type)")
def distribution_rollup(spark, d):
    return rounded(stats.distribution(table(spark, d, "events"), F.col("value"), by="event_type"))


@query("SELECT count(*) AS n, round(avg(r), 9) AS mean, round(quantile_cont(r, 0.5), 9) AS median, round(min(r), 9) AS min, round(100.0 * count(*) FILTER (r > 0.9) / count(*), 9) AS pct_above_90, count(*) FILTER (r = 0) AS n_zero FROM (SELECT 1 - l_discount * 2 AS r FROM lineitem)")
def ratio_stats(spark, d):
    return rounded(stats.ratio_stats(table(spark, d, "lineitem"), 1 - F.col("l_discount") * 2))


@query("""
SELECT count(*) AS n, round(avg(b), 9) AS mean_before, round(avg(a), 9) AS mean_after, round(quantile_cont(b, 0.5), 9) AS median_before, round(quantile_cont(a, 0.5), 9) AS median_after,
  round(avg(b - a), 9) AS mean_improvement, count(*) FILTER (b - a > 0) AS n_improved, round(100.0 * count(*) FILTER (b - a > 0) / count(*), 9) AS pct_improved
FROM (SELECT l_extendedprice / 1000 AS b, l_extendedprice / 1000 * (1 - l_discount) + l_tax * 40 AS a FROM lineitem)""")
def before_after(spark, d):
    b = F.col("l_extendedprice") / 1000
    return rounded(stats.before_after(table(spark, d, "lineitem"), b, b * (1 - F.col("l_discount")) + F.col("l_tax") * 40))


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 9) AS improvement, round(CASE WHEN l_extendedprice > 0 THEN l_discount * 100 ELSE 0 END, 9) AS improvement_pct FROM lineitem""")
def improvement_rows(spark, d):
    before = F.col("l_extendedprice")
    gain, share = S.improvement(before, before * (1 - F.col("l_discount")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(gain, 9).alias("improvement"), F.round(share, 9).alias("improvement_pct"))


@query("""
SELECT CASE WHEN o_orderdate::DATE <= DATE '1998-12-31' THEN 'train' WHEN o_orderdate::DATE <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS split,
  CASE WHEN o_orderdate::DATE > DATE '1999-09-30' THEN 'post_cutoff' ELSE 'pre_or_on_cutoff' END AS time_group, o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS n_entries FROM orders GROUP BY ALL""")
def split_chronological(spark, d):
    day = F.to_date("o_orderdate")
    date = lambda x: F.lit(x).cast("date")
    rows = table(spark, d, "orders").select(S.chronological_split(day, date("1998-12-31"), date("1999-12-31")).alias("split"), S.time_group(day, date("1999-09-30")).alias("time_group"), F.col("o_orderstatus").alias("status"), "o_custkey")
    return rows.groupBy("split", "time_group", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_entries"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return stats.duplicate_keys(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_codes, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS codes FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def conflicting_codes(spark, d):
    return stats.conflicting_codes(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT count(*) AS n, count(*) FILTER (o_totalprice > 1000) AS priced, count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) AS known_status, coalesce(bool_and(o_totalprice > 1000 AND o_orderstatus IN ('F', 'O', 'P')), false) AS all_pass FROM orders")
def summary_counters(spark, d):
    return stats.summary_counters(table(spark, d, "orders"), priced=F.col("o_totalprice") > 1000, known_status=F.col("o_orderstatus").isin("F", "O", "P"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_id % 4 = {i} AND event_type <> 'error') AS \"{i}\"" for i in range(4)) + " FROM events GROUP BY user_id")
def completeness_pivot(spark, d):
    e = table(spark, d, "events").withColumn("seed", F.col("event_id") % 4)
    return stats.completeness_pivot(e, "user_id", "seed", [0, 1, 2, 3], F.col("event_type") != "error")


@query("""
WITH g AS (SELECT o_orderstatus AS target, o_custkey % 100 AS cand, list_sort(list(o_orderpriority)) AS sig FROM orders GROUP BY 1, 2)
SELECT target, count(DISTINCT sig) AS n_signatures, count(DISTINCT sig) = 1 AS consistent FROM g GROUP BY 1""")
def signature_consistency(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("target"), (F.col("o_custkey") % 100).alias("cand"), F.lit("A").alias("chain"), "o_orderpriority")
    return stats.signature_consistency(o, "target", "cand", "chain", "o_orderpriority")


@query("""
WITH n AS (SELECT user_id, event_type, count(*) AS support FROM events GROUP BY 1, 2)
SELECT user_id, event_type, support, round(support / sum(support) OVER (PARTITION BY user_id), 9) AS fraction, row_number() OVER (PARTITION BY user_id ORDER BY support DESC, event_type) AS variant,
  count(*) OVER (PARTITION BY user_id) AS n_variants FROM n""")
def mapping_variants(spark, d):
    return stats.variants(table(spark, d, "events"), "user_id", "event_type").withColumn("fraction", F.round("fraction", 9))


@query("""
SELECT o.o_orderkey, coalesce(n, 0) AS n_observed, round(coalesce(n, 0) / 7.0, 9) AS coverage, coalesce(n, 0) / 7.0 < 0.5 AS low_coverage
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def chain_coverage(spark, d):
    chains = table(spark, d, "orders").select("o_orderkey", F.lit(7).alias("length"))
    seen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return rounded(stats.chain_coverage(seen, chains, ["o_orderkey"], "length", 0.5).drop("length"))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_observed, (max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber))::BIGINT AS n_missing, round(count(DISTINCT l_linenumber) / (max(l_linenumber) - min(l_linenumber) + 1), 4) AS completeness FROM lineitem GROUP BY 1")
def sequence_completeness(spark, d):
    return stats.sequence_completeness(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
WITH r AS (SELECT o_custkey, ['A', 'C', 'G', 'U', 'DA', 'DT'][1 + (o_orderkey % 6)::INT] AS name FROM orders)
SELECT o_custkey, bool_or(name IN ('A', 'C', 'G', 'U')) AND NOT (bool_or(name IN ('DA', 'DT')) AND NOT bool_or(name = 'U')) AS is_rna FROM r GROUP BY 1""")
def rna_chain_rule(spark, d):
    names = F.array(*[F.lit(x) for x in ("A", "C", "G", "U", "DA", "DT")])
    r = table(spark, d, "orders").select("o_custkey", names[(F.col("o_orderkey") % 6).cast("int")].alias("name"))
    return stats.rna_chains(r, ["o_custkey"], "name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(spark, d):
    return ranking.by_cost(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 20, shortest=False)


@query("SELECT o_orderkey FROM orders ORDER BY md5('13:' || o_orderkey), o_orderkey LIMIT 100")
def sample_n(spark, d):
    return ranking.repeatable_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 13)


@query("""
WITH b AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL WHEN p_size > 3 THEN p_retailprice / 400 END AS r FROM part)
SELECT CASE WHEN r IS NULL THEN 'no_resolution' WHEN r > 3.5 THEN 'removed' ELSE 'kept' END AS bucket, count(*) AS n FROM b GROUP BY 1""")
def low_resolution(spark, d):
    r = F.when(F.col("p_size") > 40, None).when(F.col("p_size") > 3, F.col("p_retailprice") / 400)
    return table(spark, d, "part").groupBy(S.low_resolution_bucket(r, 3.5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE 1 - l_discount >= 0.95 AND l_quantity BETWEEN 10 AND 40 QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate) = 1")
def quality_filter(spark, d):
    li = table(spark, d, "lineitem").withColumn("completeness", F.round(1 - F.col("l_discount"), 6))
    return stats.quality_filter(li, "completeness", "l_quantity", ["l_partkey", "l_suppkey"], "l_orderkey", "l_linenumber", "l_shipdate", shortest=10, longest=40).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query(f"SELECT l_returnflag, {sql_describe('l_extendedprice')} FROM lineitem GROUP BY 1")
def describe_prices(spark, d):
    return rounded(stats.describe(table(spark, d, "lineitem"), F.col("l_extendedprice"), "l_returnflag"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type IN ('error', 'view') AS failed FROM events), r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
f AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT event_id, n::BIGINT AS failures_in_row FROM f QUALIFY coalesce(max(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3""")
def failure_stop(spark, d):
    """Each worker's events up to its third failure in a row."""
    return ranking.until_failures(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "view")).select("event_id", "failures_in_row")


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT event_id, (sum(failed::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS failures_in_row FROM e""")
def failure_runs(spark, d):
    return ranking.run_length(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "failures_in_row")
