"""Window functions: strict rank-1, representatives, choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.functions.scalars import finite_or_null
from helixlake.sources.shared import write_shared


def first_by(df: DataFrame, by: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def rank1(candidates: DataFrame, target: str = "pdb_id", seed: str = "seed", sample: str = "sample", score: str = "ranking_score") -> DataFrame:
    """The candidate of each target with the highest finite score, then the least seed and sample;
    without a finite score the first by seed and sample. A failed metric never changes the choice."""
    clean = candidates.withColumn(score, finite_or_null(F.col(score)))
    best = first_by(clean, [target], F.col(score).desc_nulls_last(), F.col(seed), F.col(sample))
    return best.withColumn("selection_status", F.when(F.col(score).isNull(), "NO_FINITE_SCORE").otherwise("OK"))


def rank1_companions(candidates: DataFrame, target: str = "pdb_id", score: str = "ranking_score", metric: str = "rmsd", tolerance: float = 1e-12) -> DataFrame:
    """Per target: candidates, evaluated ones, the oracle's best, median and mean metric, and how many
    scores are within the tolerance of the top."""
    clean = candidates.withColumns({score: finite_or_null(F.col(score)), metric: finite_or_null(F.col(metric))})
    top = clean.withColumn("__top", F.max(score).over(Window.partitionBy(target)))
    return top.groupBy(target).agg(F.count(F.lit(1)).alias("candidate_count"), F.count(metric).alias("evaluated_count"), F.min(metric).alias("oracle_best"), F.percentile(metric, 0.5).alias("median_metric"), F.avg(metric).alias("mean_metric"), F.count_if(F.col("__top") - F.col(score) <= tolerance).alias("tie_count"))


def best_hits(hits: DataFrame, query: Sequence[str], target: Sequence[str]) -> DataFrame:
    """The best hit of each query: identity, both coverages, then the target's ids."""
    return first_by(hits, query, F.desc("identity"), F.desc("qcov"), F.desc("tcov"), *target)


def merge_hits(*sources: tuple[DataFrame, bool]) -> DataFrame:
    """Hits (query, target, identity, qcov, tcov) of several sources, one for each directed pair: the
    best by identity, coverages and being of a primary source."""
    every = None
    for df, primary in sources:
        part = df.select("query", "target", "identity", "qcov", "tcov").withColumn("is_primary", F.lit(primary))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("query", "target").agg(F.max(F.struct("identity", "qcov", "tcov", "is_primary")).alias("h"))
    return best.select("query", "target", "h.*")


def counted_before(rows: DataFrame, count: str, *order: str) -> DataFrame:
    """rows, distinct in `order`, plus `before`: the sum of their counts over all rows that come first.
    They are cut into ranges, written, and summed range by range: no task holds all of them."""
    held = write_shared(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = held.groupBy("__p").agg(F.sum(count).alias("n")).select("__p", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__ahead"))
    inside = F.coalesce(F.sum(count).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("__in", inside).join(F.broadcast(sums), "__p").withColumn("before", (F.col("__ahead") + F.col("__in")).cast("long")).drop("__p", "__in", "__ahead")


def representatives(members: DataFrame, component: str, resolution: str, day: str, *ids: str) -> DataFrame:
    """Each component's member of best (lowest) resolution, then date, then ids."""
    return first_by(members, [component], F.col(resolution).asc_nulls_last(), F.col(day).asc_nulls_last(), *ids)


def number_components(members: DataFrame, component: str, prefix: str = "cluster_", name: str = "cluster_id") -> DataFrame:
    """Labels by the order of the components' smallest members."""
    keys = counted_before(members.select(component).distinct().withColumn("__n", F.lit(1)), "__n", component)
    return members.join(keys.select(component, F.format_string(prefix + "%04d", F.col("before") + 1).alias(name)), component)


def alternate_location(atoms: DataFrame, keys: Sequence[str], *ties: str) -> DataFrame:
    """Of alternate locations the one of highest occupancy, then the smaller id, then by `ties`."""
    return first_by(atoms, keys, F.col("occupancy").desc_nulls_last(), F.col("alt_id").asc_nulls_first(), *ties)


def best_existing_seed(scores: DataFrame, files: DataFrame, target: str, seed: str, score: str) -> DataFrame:
    """Each target's best seed among those that have files."""
    return first_by(scores.join(files.select(target, seed).distinct(), [target, seed]), [target], F.col(score).desc_nulls_last(), seed)


def preferred_path(paths: DataFrame, key: str, path: str, preferred: Column) -> DataFrame:
    """The preferred path, else that of fewest parts, then the shorter, then the first."""
    return first_by(paths, [key], F.col(path).eqNullSafe(preferred).desc(), F.size(F.split(path, "/")), F.length(path), path)


def first_report_row(report: DataFrame, key: str, skipped: Column, order: str) -> DataFrame:
    return first_by(report, [key], skipped, order)


def running_offsets(chains: DataFrame, entry: str, order: str, length: str) -> DataFrame:
    """Where each chain begins in its entry's run of residues."""
    w = Window.partitionBy(entry).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chains.withColumn("start_offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def residue_index(chains: DataFrame, entry: str, chain: str, sequence: str) -> DataFrame:
    """A row for each residue: its letter, its index in the chain, and its order in the entry."""
    offs = running_offsets(chains.withColumn("__len", F.length(sequence)), entry, chain, "__len")
    out = offs.select(entry, chain, "start_offset", F.posexplode(F.split(sequence, "")).alias("index_in_chain", "letter")).filter("letter <> ''")
    return out.withColumn("residue_order", F.col("start_offset") + F.col("index_in_chain")).drop("start_offset")


def consensus(options: DataFrame, candidate: str, target: str, key: str, rmsd: str) -> DataFrame:
    """The mapping of each candidate: its only option, or of several the one that most single-option
    candidates of the target have, then the lower rmsd, then the key."""
    n = options.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(target, candidate)))
    support = n.filter("__n = 1").groupBy(target, key).agg(F.count(F.lit(1)).alias("support"))
    met = n.join(support, [target, key], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    best = first_by(met, [target, candidate], F.desc("support"), rmsd, key)
    return best.withColumn("tie_break", F.col("__n") > 1).drop("__n")


def by_cost(ready: DataFrame, weight: str, key: str, n: int, shortest: bool = True) -> DataFrame:
    """The n cheapest (or dearest) items."""
    return ready.orderBy(F.col(weight).asc() if shortest else F.col(weight).desc(), key).limit(n)


def repeatable_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a seeded hash of the key: the same whatever the partitions."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def run_length(events: DataFrame, by: Sequence[str], order: Sequence[str], failed: Column) -> DataFrame:
    """Consecutive failures up to each event."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = events.withColumn("__run", F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("failures_in_row", F.sum(F.when(failed, 1).otherwise(0)).over(inside)).drop("__run")


def until_failures(events: DataFrame, by: Sequence[str], order: Sequence[str], failed: Column, limit: int = 3) -> DataFrame:
    """Each group's events up to the first that is the limit-th failure in a row, itself included."""
    runs = run_length(events, by, order, failed)
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("__stopped", F.coalesce(F.max(F.col("failures_in_row") >= limit).over(before), F.lit(False))).filter(~F.col("__stopped")).drop("__stopped")
