"""Joins: validated, reconciling, pairing and completeness joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class DuplicateKey(ValueError):
    pass


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, once one job has found no key twice."""
    bad = df.groupBy(*keys).count().filter("count > 1").limit(3).collect()
    if bad:
        raise DuplicateKey(f"{keys} not unique: {[tuple(r)[:-1] for r in bad]}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join on keys that both sides have once; an error otherwise."""
    return assert_unique(left, *keys).join(assert_unique(right, *keys), list(keys), "left")


def keep_ids(df: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    return df.join(ids, list(keys), "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    return df.join(ids, list(keys), "left_anti")


def select_for_run(current: DataFrame, required: Sequence[DataFrame], excluded: Sequence[DataFrame], key: str) -> DataFrame:
    """Ids that all the required tables have and none of the excluded ones."""
    for t in required:
        current = keep_ids(current, t.select(key), key)
    for t in excluded:
        current = drop_ids(current, t.select(key), key)
    return current


def standard_or_rescue(manifest: DataFrame, standard: DataFrame, rescue: DataFrame, keys: Sequence[str], valid: str, value: str) -> DataFrame:
    """manifest plus the value of the standard result where that is valid, else of a valid rescue,
    and the protocol it came by. Results have a key once."""
    side = lambda df, n: df.select(*keys, F.col(valid).alias(f"{n}_ok"), F.col(value).alias(f"{n}_value"))
    met = manifest.join(side(standard, "std"), list(keys), "left").join(side(rescue, "res"), list(keys), "left")
    std, res = F.coalesce("std_ok", F.lit(False)), F.coalesce("res_ok", F.lit(False))
    chosen = F.when(std, F.col("std_value")).when(res, F.col("res_value"))
    protocol = F.when(std, "foldbench_full").when(res, "rigid_only_rescue").otherwise("unavailable")
    return met.withColumns({value: chosen, "protocol": protocol}).drop("std_ok", "std_value", "res_ok", "res_value")


def assemble(candidates: DataFrame, confidence: DataFrame, references: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Candidates with their score and reference; what is missing is named in discovery_issue."""
    met = candidates.join(confidence, list(keys), "left").join(references, target, "left")
    score = [c for c in confidence.columns if c not in keys][0]
    path = [c for c in references.columns if c != target][0]
    missing = lambda c, text: F.when(F.col(c).isNull(), text)
    return met.withColumn("discovery_issue", F.concat_ws("; ", missing(score, "missing confidence score"), missing(path, "missing reference")))


def reconcile(manifest: DataFrame, listing: DataFrame, key: str, compare: str | None = None, dropped: Column | None = None) -> DataFrame:
    """(key, status): OK, MISSING (listed nowhere), EXTRA (in no manifest), MISMATCH (compare differs),
    DROPPED_PRESENT (the manifest says dropped and it is there)."""
    left = manifest.select(F.col(key).alias("k1"), (F.col(compare) if compare else F.lit(0)).alias("v1"), (dropped if dropped is not None else F.lit(False)).alias("gone"))
    right = listing.select(F.col(key).alias("k2"), (F.col(compare) if compare else F.lit(0)).alias("v2"))
    met = left.join(right, F.col("k1") == F.col("k2"), "full_outer")
    gone, there = F.coalesce("gone", F.lit(False)), F.col("k2").isNotNull()
    status = F.when(F.col("k1").isNull(), "EXTRA").when(gone & there, "DROPPED_PRESENT").when(gone, "OK").when(~there, "MISSING").when(~F.col("v1").eqNullSafe(F.col("v2")), "MISMATCH").otherwise("OK")
    return met.select(F.coalesce("k1", "k2").alias(key), status.alias("status"))


def occurrence(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "nth") -> DataFrame:
    """The number of each equal row in its group, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def pair_equal_sequences(a: DataFrame, b: DataFrame, group: str, sequence: str, chain: str) -> DataFrame:
    """(group, sequence, chain_a, chain_b, status): the k-th copy of a sequence in a with the k-th in
    b of the same group. EXACT_UNIQUE if both have it once, ORDER_ASSUMED for copies, NO_MATCH
    for what is left on either side."""
    def numbered(df: DataFrame, out: str, n: str) -> DataFrame:
        w = Window.partitionBy(group, sequence)
        return df.select(group, sequence, F.col(chain).alias(out), F.row_number().over(w.orderBy(chain)).alias("nth"), F.count(F.lit(1)).over(w).alias(n))

    met = numbered(a, "chain_a", "n_a").join(numbered(b, "chain_b", "n_b"), [group, sequence, "nth"], "full_outer")
    status = F.when(F.col("chain_a").isNull() | F.col("chain_b").isNull(), "NO_MATCH").when((F.col("n_a") == 1) & (F.col("n_b") == 1), "EXACT_UNIQUE").otherwise("ORDER_ASSUMED")
    return met.select(group, sequence, "chain_a", "chain_b", status.alias("status"))


def pair_residual(pairs: DataFrame, group: str) -> DataFrame:
    """Where a group has exactly one unmatched chain on each side, these two."""
    left = pairs.filter("chain_b IS NULL").groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("chain_a").alias("chain_a")).filter("n = 1")
    right = pairs.filter("chain_a IS NULL").groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("chain_b").alias("chain_b")).filter("n = 1")
    return left.drop("n").join(right.drop("n"), group)


def compare_chains(a: DataFrame, b: DataFrame, group: str, chain: str, sequence: str) -> DataFrame:
    """Chains of a with their partner in b: BY_ID if the id is in both, else BY_SEQUENCE if exactly
    one chain of each side that is left has the sequence, else UNRESOLVED. Uniqueness on both
    sides makes the result independent of order. One join by id, then one pass over what is left
    by sequence."""
    x, y = a.select(group, chain, F.col(sequence).alias("s1"), F.lit(True).alias("in_a")), b.select(group, chain, F.col(sequence).alias("s2"), F.lit(True).alias("in_b"))
    met = x.join(y, [group, chain], "full_outer")
    both, left, right = F.col("in_a") & F.col("in_b"), F.col("in_b").isNull(), F.col("in_a").isNull()
    paired = F.coalesce(both, F.lit(False))
    w = Window.partitionBy(group, F.when(paired, F.col(chain)), F.when(~paired, F.coalesce("s1", "s2").cast("string")))
    rows = met.withColumns({"paired": paired, "one": (F.count_if(left).over(w) == 1) & (F.count_if(right).over(w) == 1), "other": F.max(F.when(right, F.col(chain))).over(w), "s": F.coalesce("s1", "s2")}).filter("in_a")
    unique = F.col("one") & F.col("s").isNotNull()
    how = F.when(F.col("paired"), "BY_ID").when(unique, "BY_SEQUENCE").otherwise("UNRESOLVED")
    partner = F.when(F.col("paired"), F.col(chain)).when(unique, F.col("other"))
    same = F.when(F.col("paired"), F.col("s1") == F.col("s2")).when(unique, F.lit(True))
    return rows.select(group, F.col(chain).alias("chain_a"), partner.alias("chain_b"), how.alias("how"), same.alias("same_sequence"))


def resolve_paths(entries: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """entries(key, path) against files(key, path): DIRECT if the path is there, REBASED if the key
    has exactly one file, else MISSING or AMBIGUOUS."""
    w = files.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only"))
    direct = files.select(F.col("path").alias("p2")).distinct()
    met = entries.join(direct, F.col("path") == F.col("p2"), "left").join(w, key, "left")
    status = F.when(F.col("p2").isNotNull(), "DIRECT").when(F.col("n") == 1, "REBASED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("MISSING")
    return met.select(key, "path", F.when(F.col("p2").isNotNull(), F.col("path")).when(F.col("n") == 1, F.col("only")).alias("resolved"), status.alias("status"))


def resolve_paths_in_order(entries: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, place, path, resolved, status) of entries(key, place, path), places counted from 0, against
    files(key, path, folder): DIRECT if the path is there, else REBASED to the key's first file (by path) whose
    folder is the place, else, where the key has as many files as entries, to the file of that place in the
    order of paths; else MISSING. The folder is null where its name is no number."""
    every = files.filter(F.col("path").isNotNull()).select(F.col(key).alias("k"), F.col("path").alias("file"), F.col("folder").cast("long").alias("folder"))
    direct = every.select(F.col("file").alias("there")).distinct()
    by_folder = every.filter(F.col("folder").isNotNull()).groupBy(F.col("k").alias("k1"), "folder").agg(F.min("file").alias("by_folder"))
    turn = every.distinct().withColumn("turn", F.row_number().over(Window.partitionBy("k").orderBy("file", "folder")) - 1)
    in_turn = turn.select(F.col("k").alias("k2"), "turn", F.col("file").alias("by_turn"), F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n_files"))
    met = entries.withColumn("n_entries", F.count(F.lit(1)).over(Window.partitionBy(key)))
    met = met.join(direct, F.col("path") == F.col("there"), "left").join(by_folder, (F.col(key) == F.col("k1")) & (F.col("place") == F.col("folder")), "left")
    met = met.join(in_turn, (F.col(key) == F.col("k2")) & (F.col("place") == F.col("turn")) & (F.col("n_entries") == F.col("n_files")), "left")
    other = F.coalesce("by_folder", "by_turn")
    status = F.when(F.col("there").isNotNull(), "DIRECT").when(other.isNotNull(), "REBASED").otherwise("MISSING")
    return met.select(key, "place", "path", F.coalesce("there", other).alias("resolved"), status.alias("status"))


def completeness(targets: DataFrame, expected: dict[str, Sequence], observed: DataFrame, target: str) -> DataFrame:
    """Per target the expected, observed, missing, extra and duplicate combinations of the listed
    values (few, known beforehand), e.g. seeds and samples."""
    names, grid = list(expected), targets.select(target).distinct()
    for n, values in expected.items():
        grid = grid.withColumn(n, F.explode(F.array(*[F.lit(v) for v in values])))
    seen = observed.groupBy(target, *names).agg(F.count(F.lit(1)).alias("n"))
    met = grid.withColumn("want", F.lit(True)).join(seen, [target, *names], "full_outer")
    want, n = F.coalesce("want", F.lit(False)), F.coalesce("n", F.lit(0))
    label = F.concat_ws("/", *[F.col(c).cast("string") for c in names])
    texts = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, label))), ",")
    return met.groupBy(target).agg(F.count_if(want).alias("n_expected"), F.sum(F.when(want, n).otherwise(0)).alias("n_observed"), texts(want & (n == 0)).alias("missing"), texts(~want).alias("extra"), F.count_if(n > 1).alias("n_duplicate"), F.bool_and(want & (n == 1)).alias("complete"))


def by_priority(needed: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """needed plus the value of the first source that has the key, and its name, else `unresolved`.
    Within a source the smallest value counts."""
    every = None
    for rank, (name, df) in enumerate(sources):
        part = df.select(F.col(key), F.struct(F.lit(rank).alias("rank"), F.col(value).alias("value"), F.lit(name).alias("source")).alias("s"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(key).agg(F.min("s").alias("s"))
    return needed.join(best, key, "left").withColumns({value: F.col("s.value"), "source_type": F.coalesce("s.source", F.lit("unresolved"))}).drop("s")


def pair_atoms(truth: DataFrame, predicted: DataFrame, sample: str, least: int = 10) -> DataFrame:
    """Atom pairs of each sample on (chain, residue number, atom); where that gives fewer than
    `least`, on (residue order, atom); samples with fewer again are dropped. Both tables have
    sample, chain, residue, residue_order, atom, x, y, z."""
    xyz = ["x", "y", "z"]
    right = predicted.withColumnsRenamed({c: f"{c}_pred" for c in xyz})

    def on(keys: list[str], branch: str) -> DataFrame:
        met = truth.select(sample, *keys, *xyz).join(right.select(sample, *keys, *[f"{c}_pred" for c in xyz]), [sample, *keys])
        return met.select(sample, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("atom_key"), *xyz, *[f"{c}_pred" for c in xyz], F.lit(branch).alias("branch"))

    exact, order = on(["chain", "residue", "atom"], "exact"), on(["residue_order", "atom"], "order")
    good = exact.groupBy(sample).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(sample)
    fallback = order.join(good, sample, "left_anti")
    enough = fallback.groupBy(sample).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(sample)
    return exact.join(good, sample, "left_semi").unionByName(fallback.join(enough, sample, "left_semi"))


def pair_atoms_by_map(truth: DataFrame, predicted: DataFrame, residue_map: DataFrame, sample: str) -> tuple[DataFrame, DataFrame]:
    """Atom pairs through a map (sample, gt_idx, pred_idx) of aligned residues, and for each sample
    the share of its true atoms that are paired."""
    xyz = ["x", "y", "z"]
    left = truth.withColumnRenamed("residue_order", "gt_idx").join(residue_map, [sample, "gt_idx"]).select(sample, "pred_idx", "atom", *xyz)
    right = predicted.select(F.col(sample), F.col("residue_order").alias("pred_idx"), "atom", *[F.col(c).alias(f"{c}_pred") for c in xyz])
    pairs = left.join(right, [sample, "pred_idx", "atom"])
    total = truth.groupBy(sample).agg(F.count(F.lit(1)).alias("n_true"))
    ratio = total.join(pairs.groupBy(sample).agg(F.count(F.lit(1)).alias("n_pairs")), sample, "left").select(sample, F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), (F.coalesce("n_pairs", F.lit(0)) / F.col("n_true")).alias("alignment_ratio"))
    return pairs, ratio


def common_residues(a: DataFrame, b: DataFrame, pairs: DataFrame, keys: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """Representative atoms of paired chains at the residues that both have: pairs(keys, chain_a,
    chain_b); a and b have keys, chain, seq_id, x, y, z. Where b has only some of the keys, `by`
    names them."""
    by = list(keys if by is None else by)
    left = pairs.join(a.select(*keys, F.col("chain").alias("chain_a"), "seq_id", *"xyz"), [*keys, "chain_a"])
    right = b.select(*by, F.col("chain").alias("chain_b"), "seq_id", *[F.col(c).alias(f"{c}_b") for c in "xyz"])
    return left.join(right, [*by, "chain_b", "seq_id"])


def consistent_copies(df: DataFrame, group: str, digest: str, position: str, vector: str) -> DataFrame:
    """Per group whether equal sequences have equal vectors at every position: one aggregation by
    (group, digest, position), no pairs of copies."""
    one = df.groupBy(group, digest, position).agg((F.count_distinct(F.xxhash64(vector)) == 1).alias("same"))
    return one.groupBy(group).agg(F.bool_and("same").alias("consistent"))


def remove_over_threshold(samples: DataFrame, metric: DataFrame, keys: Sequence[str], value: Column, limit: float) -> DataFrame:
    """samples without those whose keys have a value above the limit in metric."""
    return samples.join(metric.filter(value > limit).select(*keys).distinct(), list(keys), "left_anti")


def sequence_check(predicted: DataFrame, expected: DataFrame, keys: Sequence[str], unknown: str = "N") -> DataFrame:
    """Predicted against expected sequences by id: OK, UNKNOWN_ONLY (they differ only where one has
    the unknown letter), BASE_CONFLICT, LENGTH_CONFLICT, or ABSENT_... on a side."""
    met = predicted.select(*keys, F.col("sequence").alias("s1")).join(expected.select(*keys, F.col("sequence").alias("s2")), list(keys), "full_outer")
    zipped = F.zip_with(F.split("s1", ""), F.split("s2", ""), lambda a, b: F.when(a == b, 0).when((a == unknown) | (b == unknown), 1).otherwise(2))
    worst = F.array_max(F.concat(F.array(F.lit(0)), zipped))
    status = F.when(F.col("s1").isNull(), "ABSENT_PREDICTED").when(F.col("s2").isNull(), "ABSENT_EXPECTED").when(F.length("s1") != F.length("s2"), "LENGTH_CONFLICT").when(worst == 2, "BASE_CONFLICT").when(worst == 1, "UNKNOWN_ONLY").otherwise("OK")
    return met.select(*keys, status.alias("status"))


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of both id sets, their union, intersection and differences, and whether they are equal
    or disjoint, in one full outer join."""
    met = a.select(F.col(key).alias("k")).distinct().withColumn("in_a", F.lit(True)).join(b.select(F.col(key).alias("k")).distinct().withColumn("in_b", F.lit(True)), "k", "full_outer")
    x, y = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    return met.agg(F.count_if(x).alias("n_a"), F.count_if(y).alias("n_b"), F.count(F.lit(1)).alias("n_union"), F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("n_only_a"), F.count_if(y & ~x).alias("n_only_b"), (F.count_if(x != y) == 0).alias("equal"), (F.count_if(x & y) == 0).alias("disjoint"))


def assert_counts(df: DataFrame, **expected: tuple[Column, int]) -> None:
    """One job over all conditions; an error names those whose count isn't as expected."""
    got = df.agg(*[F.count_if(c).alias(n) for n, (c, _) in expected.items()]).first()
    bad = {n: (got[n], want) for n, (_, want) in expected.items() if got[n] != want}
    if bad:
        raise AssertionError(f"counts differ (found, expected): {bad}")
