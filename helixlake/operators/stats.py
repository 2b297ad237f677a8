"""Aggregations: metric descriptions, strata, distributions, completeness and consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.functions.scalars import finite_or_null
from helixlake.operators.ranking import counted_before, first_by
from helixlake.sources.shared import write_shared

PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
DESCRIBE_THRESHOLDS, FINAL_THRESHOLDS = (2, 4, 5, 10), (2, 5, 10, 20)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole)


def description(value: Column, thresholds: Sequence[float] = DESCRIBE_THRESHOLDS) -> list[Column]:
    """Aggregates that describe a metric (what isn't finite is missing): coverage is of all rows, the
    shares under the thresholds are of the rows with a value, and so are all others."""
    value = finite_or_null(value)
    n, with_ = F.count(F.lit(1)), F.count(value)
    out = [n.alias("n_total"), with_.alias("n_with"), (n - with_).alias("n_missing"), _share(with_, n).alias("coverage_percent"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    return out + [_share(F.count_if(value <= t), with_).alias(f"pct_le_{t:g}") for t in thresholds]


def percentiles(df: DataFrame, value: str, by: Sequence[str], shares: Sequence[float], times: str | None = None) -> DataFrame:
    """Exact percentiles of each group, an array in the order of shares: what F.percentile gives, but
    from ranks by ranges of (group, value), so that a group may be of any size. `by` may be empty;
    groups without a finite value are left out. With `times` df has each value of a group once, and
    how often it comes."""
    keys = list(by)
    per = df.select(*keys, finite_or_null(F.col(value)).alias("__x"), (F.col(times) if times else F.lit(1)).alias("__n")).filter(F.col("__x").isNotNull())
    per = per if times else per.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n"))
    ranked = counted_before(per, "__n", *keys, "__x")
    sizes = ranked.groupBy(*keys).agg(F.min("before").alias("__first"), F.sum("__n").alias("__all"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("__all") - 1)).alias("p")) for i, s in enumerate(shares)])
    holds = lambda rank: (rank >= F.col("__at")) & (rank < F.col("__at") + F.col("__n"))
    met = _beside(ranked, sizes, keys).withColumn("__at", F.col("before") - F.col("__first"))
    met = met.select(*keys, "__x", "__n", "__at", F.explode(F.filter(wanted, lambda w: holds(F.floor(w["p"])) | holds(F.ceil(w["p"])))).alias("w"))
    low, high = F.floor("w.p"), F.ceil("w.p")
    got = met.groupBy(*keys, F.col("w.i").alias("__i")).agg(F.max("w.p").alias("p"), F.max(F.when(holds(low), F.col("__x"))).alias("lo"), F.max(F.when(holds(high), F.col("__x"))).alias("hi"))
    between = F.when(F.floor("p") == F.ceil("p"), F.col("lo")).otherwise((F.ceil("p") - F.col("p")) * F.col("lo") + (F.col("p") - F.floor("p")) * F.col("hi"))
    return got.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", between.alias("v")))), lambda s: s["v"]).alias("percentiles"))


def _beside(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what groups has for their keys, nulls alike; all of it without keys."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        groups = groups.withColumnRenamed(k, f"__of{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"__of{i}"))
    met = rows.join(groups if keys else F.broadcast(groups), same, "left")
    return met.drop(*[f"__of{i}" for i in range(len(keys))])


#: Up to so many rows a group's distinct values may meet in one task.
IN_TASK_ROWS = 2_000_000


def _summed(rows: DataFrame, value: str, keys: Sequence[str], aggs: Sequence[Column], shares: dict[str, float], n: int | None = None) -> DataFrame:
    """One row, or one for each group: the aggregates, and exact percentiles under their names, in one
    aggregation where no group can be large (n, the most rows of a group, is counted if it isn't
    given), else from ranks by ranges."""
    n = rows.count() if n is None else n
    at = F.percentile(finite_or_null(F.col(value)), list(shares.values())).alias("percentiles")
    aggs = [*aggs, at] if n <= IN_TASK_ROWS else list(aggs)
    met = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
    if n > IN_TASK_ROWS:
        met = _beside(met, percentiles(rows, value, keys, list(shares.values())), keys)
    return met.withColumns({n: F.get("percentiles", F.lit(i)) for i, n in enumerate(shares)}).drop("percentiles")


def describe(df: DataFrame, value: Column, *by: str, thresholds: Sequence[float] = DESCRIBE_THRESHOLDS) -> DataFrame:
    """One row, or one for each group; a null group is called `missing`."""
    rows = df.select(*[F.coalesce(F.col(b).cast("string"), F.lit("missing")).alias(b) for b in by], value.alias("__v"))
    return _summed(rows, "__v", by, description(F.col("__v"), thresholds), {f"p{round(p * 100)}": p for p in PERCENTILES})


def describe_bins(df: DataFrame, value: Column, group: str, labels: Sequence[str]) -> DataFrame:
    """describe() by a group of known labels, which are there even if empty, in their order."""
    dim = df.sparkSession.createDataFrame(list(enumerate(labels)), f"bin_order int, {group} string")
    got = describe(df.filter(F.col(group).isNotNull()), value, group)
    out = F.broadcast(dim).join(got, group, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_total", "n_with", "n_missing")})


def describe_populations(populations: dict[str, DataFrame], value: str) -> DataFrame:
    """One description for each labelled table."""
    parts = [df.select(F.lit(name).alias("population"), F.col(value).cast("double").alias("v")) for name, df in populations.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return describe(every, F.col("v"), "population")


def final_summary(value: Column, times: Column, thresholds: Sequence[float] = FINAL_THRESHOLDS) -> list[Column]:
    """Aggregates of the final report over values, each with how often it comes; those that don't count are null."""
    counted = lambda c: F.coalesce(F.sum(F.when(c, times)), F.lit(0))
    n, ok = F.sum(times), counted(value.isNotNull())
    out = [n.alias("n_total"), ok.alias("n_valid"), (n - ok).alias("n_excluded_or_missing"), _share(ok, n).alias("coverage_percent"), F.when(ok > 0, F.sum(value * times) / ok).alias("mean"), F.max(value).alias("max")]
    return out + [_share(counted(value <= t), ok).alias(f"pct_le_{t:g}") for t in thresholds]


def valid_value(value: Column, excluded: Column) -> Column:
    """Values of 0 or more that aren't excluded; else null."""
    v = finite_or_null(value)
    return F.when((v >= 0) & ~F.coalesce(excluded, F.lit(False)), v)


def main_table(df: DataFrame, value: str, excluded: str, time: str, length: str, chains: str) -> DataFrame:
    """Overall, by time, by length and by number of chains. Rows are counted once by their groups and
    value; only these counts are dealt to the four sections and counted again by section, group and value.
    Of the time groups only post_cutoff is reported; a null group is called `missing`."""
    one = lambda section, group: F.struct(F.lit(section).alias("section"), F.coalesce(group, F.lit("missing")).alias("group"))
    sections = F.array(one("overall", F.lit("all")), one("time", F.col("__t")), one("length", F.col("__l")), one("chains", F.col("__c")))
    every = df.select(F.col(time).alias("__t"), F.col(length).alias("__l"), F.col(chains).alias("__c"), valid_value(F.col(value), F.col(excluded)).alias("__v"))
    every = every.groupBy("__t", "__l", "__c", "__v").agg(F.count(F.lit(1)).alias("__times"))
    rows = every.select(F.explode(F.filter(sections, lambda s: (s["section"] != "time") | (s["group"] == "post_cutoff"))).alias("s"), "__v", "__times").select("s.section", "s.group", "__v", "__times")
    keys, shares = ["section", "group"], {"q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9}
    rows = write_shared(rows.groupBy(*keys, "__v").agg(F.sum("__times").alias("__times")), "strata")
    aggs = final_summary(F.col("__v"), F.col("__times"))
    if rows.count() > IN_TASK_ROWS:
        got = _beside(rows.groupBy(*keys).agg(*aggs), percentiles(rows, "__v", keys, list(shares.values()), "__times"), keys)
    else:
        got = rows.groupBy(*keys).agg(*aggs, F.percentile("__v", list(shares.values()), F.col("__times")).alias("percentiles"))
    got = got.withColumns({n: F.get("percentiles", F.lit(i)) for i, n in enumerate(shares)}).drop("percentiles")
    return got.withColumn("iqr", F.col("q75") - F.col("q25"))


def joined_set(c: Column, sep: str = ";") -> Column:
    """Aggregate: distinct texts, sorted and joined; '' if there is none."""
    return F.array_join(F.array_sort(F.collect_set(F.when(c != "", c))), sep)


def candidate_audit(candidates: DataFrame, target: str, valid: Column, reason: Column) -> DataFrame:
    return candidates.groupBy(target).agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(valid).alias("valid_count"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("failed_count"), joined_set(F.when(~F.coalesce(valid, F.lit(False)), reason)).alias("failure_reasons"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))


#: So many rows of one value are emitted by one row.
TIES = 100_000


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(x, y): one row for each finite value, ties kept, y its rank among them over their number. Ranks
    come from counts of value ranges, so no task sorts all values; ties of more than TIES rows are cut into
    runs of ranks that are dealt to tasks before they become rows."""
    per = df.select(finite_or_null(F.col(value)).alias("x")).filter(F.col("x").isNotNull()).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted_before(per, "n", "x")
    total, most = ranked.agg(F.sum("n"), F.max("n")).first()
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TIES)))
    runs = ranked.withColumn("run", run).select("x", (F.col("before") + F.col("run") * TIES).alias("before"), F.least(F.lit(TIES), F.col("n") - F.col("run") * TIES).cast("int").alias("n"))
    runs = runs.repartition("x", "before") if (most or 0) > TIES else runs
    rows = runs.select("x", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "before")
    return rows.select("x", ((F.col("before") + F.col("k")) / F.lit(total)).alias("y"))


def exceedance(df: DataFrame, value: Column, thresholds: Sequence[float]) -> DataFrame:
    """How many values are above each threshold, and their share."""
    counts = df.agg(F.count(value).alias("n"), F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(value > t).alias("n_above")) for t in thresholds]).alias("a"))
    return counts.select("n", F.explode("a").alias("x")).select("x.threshold", "x.n_above", _share(F.col("x.n_above"), F.col("n")).alias("pct_above"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin (from 1); values beyond the range are clipped to it."""
    x = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    b = F.least(F.floor((x - low) / ((high - low) / bins)).cast("int") + 1, F.lit(bins))
    return df.filter(value.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, value: Column, *, by: str | None = None, thresholds: Sequence[float] = (1, 2, 5)) -> DataFrame:
    """Number, mean, quartiles and shares under thresholds; with `by` also each group's, the total
    being the row with a null group, as of a rollup."""
    v, n = F.col("__v"), F.count("__v")
    aggs = [n.alias("n"), F.avg(v).alias("mean"), *[_share(F.count_if(v < t), n).alias(f"pct_lt_{t:g}") for t in thresholds]]
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    if by is None:
        return _summed(df.select(finite_or_null(value).alias("__v")), "__v", [], aggs, shares)
    both = F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast(df.schema[by].dataType).alias(by)), F.struct(F.lit(False).alias("whole"), F.col(by)))
    rows = df.select(F.explode(both).alias("s"), finite_or_null(value).alias("__v")).select("s.*", "__v")
    return _summed(rows, "__v", ["whole", by], aggs, shares).drop("whole")


def ratio_stats(df: DataFrame, ratio: Column) -> DataFrame:
    """Mean, median and least of alignment ratios, and the share above 0.9; zeros only count there."""
    v, n = F.col("__v"), F.count("__v")
    aggs = [n.alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), _share(F.count_if(v > 0.9), n).alias("pct_above_90"), F.count_if(v == 0).alias("n_zero")]
    return _summed(df.select(finite_or_null(ratio).alias("__v")), "__v", [], aggs, {"median": 0.5})


def before_after(df: DataFrame, before: Column, after: Column) -> DataFrame:
    n, rows = F.count(F.lit(1)), df.select(before.alias("b"), after.alias("a"))
    gain = F.col("b") - F.col("a")
    aggs = [n.alias("n"), F.avg("b").alias("mean_before"), F.avg("a").alias("mean_after"), F.avg(gain).alias("mean_improvement"), F.count_if(gain > 0).alias("n_improved"), _share(F.count_if(gain > 0), n).alias("pct_improved")]
    n_rows = rows.count()
    once = _summed(rows, "b", [], aggs, {"median_before": 0.5}, n_rows)
    return _beside(once, _summed(rows, "a", [], [F.count("a").alias("__n")], {"median_after": 0.5}, n_rows).drop("__n"), [])


def same_multiset(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """(key, same): whether both tables hold the same items of the key as often."""
    count = lambda df, n: df.groupBy(F.col(key), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias(n))
    left, right = count(a, "n1"), count(b, "n2").withColumnsRenamed({key: "k2", "item": "i2"})
    met = left.join(right, F.col(key).eqNullSafe(F.col("k2")) & F.col("item").eqNullSafe(F.col("i2")), "full_outer")
    return met.groupBy(F.coalesce(key, "k2").alias(key)).agg(F.bool_and(F.col("n1").eqNullSafe(F.col("n2"))).alias("same"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def conflicting_codes(df: DataFrame, key: str, code: str) -> DataFrame:
    return df.groupBy(key).agg(F.countDistinct(code).alias("n_codes"), joined_set(F.col(code).cast("string"), ",").alias("codes")).filter("n_codes > 1")


def summary_counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """A count for each condition and whether all rows meet all of them; false for no rows."""
    every = F.lit(True)
    for c in conditions.values():
        every = every & F.coalesce(c, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in conditions.items()], F.coalesce(F.bool_and(every), F.lit(False)).alias("all_pass"))


def completeness_pivot(files: DataFrame, target: str, seed: str, seeds: Sequence, valid: Column) -> DataFrame:
    """Valid files of each target by seed, a column for each of the listed seeds."""
    return files.groupBy(target).pivot(seed, list(seeds)).agg(F.count_if(valid)).na.fill(0)


def signature_consistency(df: DataFrame, target: str, candidate: str, chain: str, sequence: str) -> DataFrame:
    """Whether all candidates of a target have the same (chain, sequence) list."""
    one = df.groupBy(target, candidate).agg(F.array_sort(F.collect_list(F.struct(F.col(chain).alias("c"), F.col(sequence).alias("s")))).alias("sig"))
    return one.groupBy(target).agg(F.countDistinct("sig").alias("n_signatures"), (F.countDistinct("sig") == 1).alias("consistent"))


def variants(df: DataFrame, target: str, mapping: str) -> DataFrame:
    """The mappings of each target by support: number, share of the target's candidates, and rank
    (by support, then key); variant 1 is the dominant one."""
    n = df.groupBy(target, mapping).agg(F.count(F.lit(1)).alias("support"))
    w = Window.partitionBy(target)
    return n.withColumns({"fraction": F.col("support") / F.sum("support").over(w), "variant": F.row_number().over(w.orderBy(F.desc("support"), mapping)), "n_variants": F.count(F.lit(1)).over(w)})


def chain_coverage(observed: DataFrame, chains: DataFrame, keys: Sequence[str], length: str, threshold: float) -> DataFrame:
    """Observed residues over the chain's length, and whether that is under the threshold."""
    n = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_observed"))
    met = chains.join(n, list(keys), "left").withColumn("n_observed", F.coalesce("n_observed", F.lit(0)))
    share = F.col("n_observed") / F.col(length)
    return met.withColumns({"coverage": share, "low_coverage": share < threshold})


def sequence_completeness(residues: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Observed residues over the span of their numbers, and how many are missing in it."""
    n, span = F.countDistinct(number), F.max(number) - F.min(number) + 1
    return residues.groupBy(*keys).agg(n.alias("n_observed"), (span - n).alias("n_missing"), F.round(n / span, 4).alias("completeness"))


def quality_filter(df: DataFrame, completeness: str, length: str, keys: Sequence[str], *order: str, least: float = 0.95, shortest: int = 30, longest: int = 1024) -> DataFrame:
    """Rows that are complete enough and of a length within the bounds; of those that share the keys
    the first in that order."""
    good = df.filter((F.col(completeness) >= least) & F.col(length).between(shortest, longest))
    return first_by(good, keys, *order)


def rna_chains(residues: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Whether a chain is RNA: it has an RNA base, and not a DNA one without a U."""
    has = lambda *names: F.bool_or(F.upper(F.trim(F.col(name))).isin(*names))
    return residues.groupBy(*keys).agg((has("A", "C", "G", "U") & ~(has("DA", "DC", "DG", "DT") & ~has("U"))).alias("is_rna"))


def embedding_qa(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """Whether vectors are finite and not zero, and the extremes of their values and norms."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    size = F.transform(v, lambda x: F.abs(x))
    rows = df.select(*by, finite.alias("ok"), norm.alias("norm"), F.array_min(size).alias("lo"), F.array_max(size).alias("hi"))
    good = lambda c: F.when(F.col("ok"), F.col(c))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("n_not_finite"), F.count_if(F.col("ok") & (F.col("norm") <= 0)).alias("n_zero"), F.min(good("lo")).alias("min_abs"), F.max(good("hi")).alias("max_abs"), F.min(good("norm")).alias("min_norm"), F.max(good("norm")).alias("max_norm"))
