"""Whole audits and reports, composed of the operators. Each returns its tables by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.functions import scalars as S
from helixlake.operators import alignment, assignment, coordinates, graph, joins, ranking, sequences, stats
from helixlake.sources import readers

Tables = dict[str, DataFrame]


def structure_manifest(ids: DataFrame, files: DataFrame, checks: DataFrame, chains: DataFrame) -> Tables:
    """ids(pdb_id, current, legacy), files(pdb_id, path), checks(pdb_id, valid, pure_rna): one row for
    each id with its file, its statuses and its number of RNA chains, and the counters."""
    best = ranking.preferred_path(files, "pdb_id", "path", F.lit(None).cast("string"))
    n = chains.groupBy("pdb_id").agg(F.count(F.lit(1)).alias("rna_chains"))
    met = ids.join(best, "pdb_id", "left").join(checks, "pdb_id", "left").join(n, "pdb_id", "left")
    there, valid, pure = F.col("path").isNotNull(), F.coalesce("valid", F.lit(False)) & F.col("path").isNotNull(), F.coalesce("pure_rna", F.lit(False))
    rows = met.select("pdb_id", "path", S.file_status(there, valid).alias("file_status"), S.sync_status(there, valid).alias("sync_status"), S.eligibility(F.col("current"), F.col("legacy"), valid, pure).alias("eligibility_status"), F.coalesce("rna_chains", F.lit(0)).alias("rna_chains"))
    counters = stats.summary_counters(rows, present=F.col("file_status") != "MISSING", valid=F.col("file_status") == "VALID", eligible=F.col("eligibility_status") == "ELIGIBLE_CURRENT")
    return {"manifest": rows, "summary": counters}


def entity_metadata(entities: DataFrame, revisions: DataFrame, legacy: DataFrame, methods: DataFrame, codes: DataFrame, excluded: DataFrame, today: Column) -> Tables:
    """entities(pdb_id, chain_id, sequence, type), codes(pdb_id, code): the metadata of every chain of
    entries that aren't excluded, duplicate targets, and ids with several codes."""
    kept = joins.drop_ids(entities, excluded, "pdb_id")
    dates = readers.release_dates(revisions, legacy, "pdb_id", today)
    code = codes.groupBy("pdb_id").agg(F.min("code").alias("code"))
    pure = kept.groupBy("pdb_id").agg(S.is_pure_rna(F.collect_set("type")).alias("pure_rna"))
    met = kept.join(dates, "pdb_id", "left").join(methods, "pdb_id", "left").join(code, "pdb_id", "left").join(pure, "pdb_id")
    rows = met.withColumns({"target_id": S.target_id(F.col("pdb_id"), F.col("chain_id")), "n_residues": F.size(S.residue_tokens(F.col("sequence")))})
    return {"metadata": rows, "duplicates": stats.duplicate_keys(rows, "target_id"), "conflicts": stats.conflicting_codes(codes, "pdb_id", "code"), "by_code": stats.value_counts(rows, "code")}


def split_counts(entities: DataFrame, masked: DataFrame) -> DataFrame:
    """Entities, chains and entries of each split, and of them those masked by the reference sets, masked within
    the test set, and left for evaluation (0 in splits that aren't masked)."""
    rows = entities.select("key", "split", "pdb_id", F.size("chain_ids").alias("n")).join(masked.select("key", "status"), "key", "left")
    aggs = [F.count(F.lit(1)).alias("n_entities"), F.sum("n").alias("n_chains"), F.countDistinct("pdb_id").alias("n_entries")]
    for name, status in (("reference", "MASK_REFERENCE"), ("internal", "MASK_INTERNAL"), ("evaluated", "EVALUATE")):
        of = F.coalesce(F.col("status") == status, F.lit(False))
        aggs += [F.count_if(of).alias(f"{name}_entities"), F.sum(F.when(of, F.col("n")).otherwise(0)).alias(f"{name}_chains"), F.countDistinct(F.when(of, F.col("pdb_id"))).alias(f"{name}_entries")]
    return rows.groupBy("split").agg(*aggs)


def split_and_mask(entities: DataFrame, train_end, val_end, min_identity: float = 0.8, listing: DataFrame | None = None) -> Tables:
    """entities(pdb_id, entity_id, chain_ids, sequence, release_date, resolution): the split by date,
    similarity of test entities to train and val and to each other (identity over full length;
    see sequences.similar_pairs), the masks, and the status of chains and entries."""
    split = S.chronological_split(F.col("release_date"), train_end, val_end)
    rows = entities.withColumns({"split": split, "key": F.concat_ws("#", "pdb_id", "entity_id"), "search": S.search_alphabet(S.normalise_sequence(F.col("sequence")))})
    distinct = rows.select(F.col("search").alias("s")).distinct()
    pairs = sequences.similar_pairs(distinct, "s", min_identity)
    both = pairs.select("a", "b", "identity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "identity")).unionByName(distinct.select(F.col("s").alias("a"), F.col("s").alias("b"), F.lit(1.0).alias("identity")))
    tests = rows.filter("split = 'test'")
    reps = lambda df: df.groupBy("search").agg(F.min("key").alias("target"))
    known = reps(rows.filter("split IN ('train', 'val')")).withColumnRenamed("search", "b")
    # the best hit is that of the sequence: copies don't meet all sequences like theirs
    best = ranking.best_hits(both.join(known, "b").select("a", "target", "identity", F.lit(1.0).alias("qcov"), F.lit(1.0).alias("tcov")), ["a"], ["target"])
    hits = tests.select(F.col("key").alias("query"), F.col("search").alias("a")).join(best, "a").drop("a")
    # copies meet through their representative, not each other
    mine = reps(tests)
    copies = tests.join(mine, "search").filter("key <> target").select(F.col("key").alias("query"), "target", F.lit(1.0).alias("identity"))
    near = pairs.join(mine.select(F.col("search").alias("a"), F.col("target").alias("query")), "a").join(mine.select(F.col("search").alias("b"), "target"), "b").select("query", "target", "identity")
    inner = copies.unionByName(near).withColumns({"qcov": F.lit(1.0), "tcov": F.lit(1.0)})
    masked = graph.mask_redundant(tests.select("key", "pdb_id", "entity_id", "chain_ids", "resolution", "release_date"), hits, inner, "key", "resolution", "release_date")
    chains = masked.select("pdb_id", "entity_id", F.explode("chain_ids").alias("chain_id"), (F.col("status") == "EVALUATE").alias("evaluate"), "status")
    entries = graph.entry_status(chains, "pdb_id", "chain_id", "evaluate")
    counts = split_counts(rows, masked)
    manifest = rows.select("pdb_id", "split").distinct().join(entries.select("pdb_id", F.col("status").alias("entry_status")), "pdb_id", "left").withColumn("kept", F.coalesce(F.col("entry_status") != "DROP", F.lit(True)))
    out = {"entities": masked, "chains": chains, "entries": entries, "counts": counts, "manifest": manifest}
    return out if listing is None else out | {"placement": placement_plan(manifest.filter("kept").select("pdb_id", "split"), listing)}


def placement_plan(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """(pdb_id, split, action): EXISTS, WOULD_CREATE, WRONG_SPLIT (it is in another split's folder) or
    EXTRA. Nothing is created."""
    met = manifest.join(listing.select("pdb_id", F.col("split").alias("found")), "pdb_id", "full_outer")
    action = F.when(F.col("split").isNull(), "EXTRA").when(F.col("found").isNull(), "WOULD_CREATE").when(F.col("found") == F.col("split"), "EXISTS").otherwise("WRONG_SPLIT")
    return met.select("pdb_id", F.coalesce("split", "found").alias("split"), action.alias("action"))


def prep_audit(documents: DataFrame, files: DataFrame, alignments: DataFrame) -> Tables:
    """documents(pdb_id, kind raw or final, text), files(pdb_id, path), alignments(path, text): per entry
    whether its alignment is found and its query spells the sequence; per target the status and
    whether raw and final documents have the same sequences."""
    wide = documents.groupBy("pdb_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in ("raw", "final")])
    chains, issues = readers.task_chains(wide.filter("final IS NOT NULL"), "pdb_id", "final")
    raw, _ = readers.task_chains(wide.filter("raw IS NOT NULL"), "pdb_id", "raw")
    entries = chains.filter("copy_no = 1")
    where = joins.resolve_paths(entries.select("pdb_id", F.col("msa_path").alias("path")).distinct(), files, "pdb_id")
    audit = readers.alignment_audit(alignments, "path", "text").withColumnRenamed("path", "resolved")
    met = entries.join(where.withColumnRenamed("path", "msa_path"), ["pdb_id", "msa_path"], "left").join(audit, "resolved", "left")
    spelled = S.spelling_key(F.col("query")) == S.spelling_key(S.normalise_sequence(F.col("sequence")))
    rows = met.withColumn("msa_ok", F.coalesce(spelled & F.col("issue").isNull(), F.lit(False)))
    per = rows.groupBy("pdb_id").agg(F.count_if(~F.col("status").isin("DIRECT", "REBASED")).alias("missing"), F.count_if(F.col("status") == "REBASED").alias("rebased"), F.count_if(~F.col("msa_ok")).alias("bad_msa"))
    same = stats.same_multiset(raw, chains, "pdb_id", "sequence")
    targets = wide.join(per, "pdb_id", "left").join(same, "pdb_id", "left").join(issues, "pdb_id", "left")
    status = S.prep_status(F.col("final").isNotNull(), F.col("issue").isNull(), F.coalesce("missing", F.lit(0)), F.coalesce("rebased", F.lit(0)))
    done = targets.select("pdb_id", status.alias("status"), F.coalesce("bad_msa", F.lit(0)).alias("bad_msa"), "same")
    return {"entries": rows, "targets": done, "summary": stats.summary_counters(done, complete=F.col("status").isin("COMPLETE", "COMPLETE_REBASABLE"), same_sequences=F.col("same"))}


def candidate_stage_audit(targets: DataFrame, files: DataFrame, seeds: Sequence[int], samples: Sequence[int]) -> Tables:
    """targets(pdb_id, raw_valid, prep), files(pdb_id, seed, sample, kind, valid): each seed is complete
    if it has one valid prediction and one valid confidence for each sample and nothing else."""
    grid = targets.select("pdb_id").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    wanted = F.array(*[F.lit(s) for s in samples])
    of = lambda k: F.array_sort(F.collect_list(F.when((F.col("kind") == k) & F.col("valid"), F.col("sample"))))
    bad = F.count_if(~F.coalesce("valid", F.lit(False))).alias("n_invalid")
    seen = files.groupBy("pdb_id", "seed").agg(of("prediction").alias("p"), of("confidence").alias("c"), bad)
    rows = grid.join(seen, ["pdb_id", "seed"], "left")
    full = lambda c: F.coalesce(F.col(c) == F.array_sort(wanted), F.lit(False))
    text = lambda c, what: F.when(~full(c), F.concat(F.lit(f"{what}: "), F.coalesce(F.array_join(c, ","), F.lit(""))))
    reason = F.concat_ws("; ", text("p", "predictions"), text("c", "confidences"), F.when(F.col("n_invalid") > 0, F.concat(F.col("n_invalid").cast("string"), F.lit(" invalid"))))
    rows = rows.select("pdb_id", "seed", F.when(full("p") & full("c") & (F.col("n_invalid") == 0), "COMPLETE").otherwise("INCOMPLETE").alias("status"), reason.alias("reason"))
    per = rows.groupBy("pdb_id").agg(F.count_if(F.col("status") == "COMPLETE").alias("complete_seeds"))
    overall = targets.join(per, "pdb_id").withColumn("status", S.target_status(F.col("raw_valid"), F.col("prep"), F.col("complete_seeds"), len(seeds)))
    return {"seeds": rows, "targets": overall}


def chain_input_audit(chains: DataFrame, manifest: DataFrame, *, max_length: int = 1022, severity: dict[str, str] | None = None) -> Tables:
    """chains and manifest (pdb_id, chain_id, sequence): pairs of equal sequences, and issues (severity,
    code, pdb_id, detail). The run passes without an issue of severity ERROR."""
    level = {"NON_ACGU": "WARNING", "OVER_LENGTH": "WARNING", "SEQUENCE_MISMATCH": "ERROR", "MISSING_INPUT": "ERROR", "EXTRA_INPUT": "ERROR", **(severity or {})}
    pairs = joins.pair_equal_sequences(chains, manifest, "pdb_id", "sequence", "chain_id")
    same = stats.same_multiset(chains, manifest, "pdb_id", "sequence")
    there = joins.reconcile(manifest.select("pdb_id").distinct(), chains.select("pdb_id").distinct(), "pdb_id")
    issue = lambda df, code, detail: df.select(F.lit(level[code]).alias("severity"), F.lit(code).alias("code"), "pdb_id", detail.alias("detail"))
    odd, n = S.unknown_symbols(F.col("sequence")), F.length("sequence")
    found = (
        issue(chains.filter(odd != ""), "NON_ACGU", F.concat_ws("=", "chain_id", odd)).unionByName(issue(chains.filter(n > max_length), "OVER_LENGTH", F.concat_ws("=", "chain_id", n.cast("string"))))
        .unionByName(issue(there.filter("status = 'MISSING'"), "MISSING_INPUT", F.lit(""))).unionByName(issue(there.filter("status = 'EXTRA'"), "EXTRA_INPUT", F.lit("")))
        .unionByName(issue(same.filter(~F.col("same")).join(there.filter("status = 'OK'"), "pdb_id", "left_semi"), "SEQUENCE_MISMATCH", F.lit("")))
    )
    return {"chains": pairs, "issues": found, "summary": found.agg((F.count_if(F.col("severity") == "ERROR") == 0).alias("pass"), F.count(F.lit(1)).alias("n_issues"))}


def embedding_manifest(chains: DataFrame, window: int = 1022, overlap: int = 256) -> Tables:
    """chains(pdb_id, chain_id, sequence): method, windows, offsets and digest of each, and by entry."""
    rows = chains.withColumns({"n": F.length("sequence"), "sequence_sha256": S.sequence_digest(F.col("sequence")), "non_acgu": F.length(F.regexp_replace("sequence", "[ACGU]", ""))})
    rows = rows.withColumns({"window_starts": S.window_starts(F.col("n"), window, overlap), "method": F.when(F.col("n") <= window, "single").otherwise("windowed")}).withColumn("window_count", F.size("window_starts"))
    rows = ranking.running_offsets(rows, "pdb_id", "chain_id", "n").drop("sequence")
    return {"chains": rows, "entries": rows.groupBy("pdb_id").agg(F.count(F.lit(1)).alias("chain_count"), F.sum("n").alias("residue_count"), F.sum("non_acgu").alias("non_acgu"), stats.joined_set(F.col("method"), ",").alias("methods"))}


def validate_embeddings(residues: DataFrame, chains: DataFrame) -> Tables:
    """residues(pdb_id, chain_id, index_in_chain, emb), chains as of embedding_manifest with sequences:
    value checks by entry, and whether each chain has every index once."""
    want = chains.select("pdb_id", "chain_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("index_in_chain"), F.lit(1).alias("one"))
    have = residues.select("pdb_id", "chain_id", "index_in_chain", F.lit(1).alias("one"))
    return {"values": stats.embedding_qa(residues, "emb", "pdb_id"), "indexes": coordinates.index_integrity(have, want, ["pdb_id", "chain_id", "index_in_chain"], ["one"])}


def base_chain_map(inputs: DataFrame, truth: DataFrame, signatures: DataFrame) -> Tables:
    """inputs and truth(pdb_id, chain_id, sequence), signatures(pdb_id, consistent): chains paired by
    sequence, what is left one to one with its identity, and PASS or REVIEW with reasons."""
    pairs = joins.pair_equal_sequences(inputs, truth, "pdb_id", "sequence", "chain_id")
    w = Window.partitionBy("pdb_id")
    only_a, only_b = F.col("chain_b").isNull(), F.col("chain_a").isNull()
    other = lambda side, c: F.max(F.when(side, F.col(c))).over(w)
    two = F.col("pdb_id").isNotNull() & (F.count_if(only_a).over(w) == 1) & (F.count_if(only_b).over(w) == 1) & other(only_a, "chain_a").isNotNull() & other(only_b, "chain_b").isNotNull()
    rows = pairs.withColumns({"two": two, "other": other(only_b, "chain_b"), "seq_b": other(only_b, "sequence")}).filter(~(F.col("two") & only_b))
    paired = F.col("two") & only_a
    rows = rows.select("pdb_id", "chain_a", F.when(paired, F.col("other")).otherwise(F.col("chain_b")).alias("chain_b"), F.when(paired, "RESIDUAL").otherwise(F.col("status")).alias("status"), F.when(paired, F.col("sequence")).alias("seq_a"), F.when(paired, F.col("seq_b")).alias("seq_b"))
    identity = F.when(F.col("status") == "RESIDUAL", F.col("identity")).when(F.col("status") != "NO_MATCH", 1.0)
    done = sequences.pair_identity(rows, "seq_a", "seq_b").select("pdb_id", "chain_a", "chain_b", "status", identity.alias("identity"))
    met = rows.join(signatures, "pdb_id", "left")
    return {"map": done, "targets": graph.accept_maps(met, "pdb_id", unique_sequences=F.col("status") == "EXACT_UNIQUE", complete=F.col("chain_a").isNotNull() & F.col("chain_b").isNotNull(), consistent=F.col("consistent"))}


def coordinate_chain_map(predicted: DataFrame, truth: DataFrame, lengths: DataFrame, *, min_coverage: float = 0.5, min_dominance: float = 0.8, tolerance: float = 1e-6) -> Tables:
    """Chain maps by coordinates: the choice of each candidate, its target's variants, and acceptance."""
    options = assignment.mapping_options(predicted, truth, tolerance=tolerance)
    chosen = ranking.consensus(options.filter("mapping_key IS NOT NULL"), "sample", "target", "mapping_key", "rmsd")
    variants = stats.variants(chosen, "target", "mapping_key")
    covered = stats.chain_coverage(truth.select("target", "chain"), lengths, ["target", "chain"], "length", min_coverage)
    least = covered.groupBy("target").agg(F.min("coverage").alias("least_coverage"))
    top = variants.filter("variant = 1").select("target", F.col("fraction").alias("dominance"))
    exact = options.groupBy("target").agg(F.bool_and("exact").alias("exact"))
    met = top.join(least, "target", "left").join(exact, "target")
    return {"candidates": chosen, "variants": variants, "issues": options.filter("issue <> ''").select("target", "sample", "issue"), "targets": graph.accept_maps(met, "target", exact=F.col("exact"), coverage=F.col("least_coverage") >= min_coverage, dominance=F.col("dominance") >= min_dominance)}


def targets_table(targets: DataFrame, metadata: DataFrame, files: DataFrame, cutoff, seeds: Sequence[int], samples: Sequence[int]) -> DataFrame:
    """targets(pdb_id, chain_count), metadata(pdb_id, release_date): date, time group, chain count, and
    whether all candidates are there or which are missing."""
    got = joins.completeness(targets, {"seed": list(seeds), "sample": list(samples)}, files, "pdb_id").select("pdb_id", "complete", F.when(F.col("missing") != "", F.concat(F.lit("missing "), "missing")).alias("reason"))
    return targets.join(metadata, "pdb_id", "left").join(got, "pdb_id", "left").select("pdb_id", "release_date", S.time_group(F.col("release_date"), cutoff).alias("time_group"), "chain_count", "complete", "reason")


def candidate_report(candidates: DataFrame, targets: DataFrame) -> Tables:
    """candidates(pdb_id, seed, sample, ranking_score, rmsd, eval_status, log), targets(pdb_id,
    release_date, time_group, chain_count, rna_total_length): the rank-1 table, the audit, and the
    statistics by population, time, length and number of chains."""
    valid = (F.col("eval_status") == "SUCCESS") & (S.finite_or_null(F.col("rmsd")) >= 0)
    clean = candidates.withColumns({"rmsd": F.when(valid, S.finite_or_null(F.col("rmsd"))), "reason": S.failure_code(F.lit(None).cast("string"), F.col("log"), valid)})
    top = joins.one_to_one(ranking.rank1(clean), targets, "pdb_id").join(ranking.rank1_companions(clean), "pdb_id")
    top = top.withColumns({"length_group": S.length_group(F.col("rna_total_length")), "chain_count_group": S.chain_count_group(F.col("chain_count"))})
    audit = stats.candidate_audit(clean, "pdb_id", F.col("rmsd").isNotNull(), F.col("reason"))
    best = top.select(F.col("oracle_best").alias("rmsd"))
    v = F.col("rmsd")
    return {
        "rank1": top, "audit": audit, "overall": stats.describe_populations({"rank1": top, "all_successful": clean.filter(v.isNotNull()), "oracle_best": best}, "rmsd"),
        "by_time": stats.describe(top, v, "time_group"), "by_length": stats.describe_bins(top, v, "length_group", [b for b, _ in S.LENGTH_BINS]), "by_chains": stats.describe(top, v, "chain_count_group"),
    }


def final_report(rank1: DataFrame, candidates: DataFrame, frozen: DataFrame) -> Tables:
    """The main table with frozen exclusions: an excluded target stays so even if it has a metric by now;
    an excluded id that isn't a target is an error. The supplement lists, for excluded targets,
    how many lower-ranked candidates are valid."""
    unknown = joins.drop_ids(frozen, rank1, "pdb_id").limit(3).collect()
    if unknown:
        raise ValueError(f"excluded ids that aren't targets: {[r['pdb_id'] for r in unknown]}")
    marked = rank1.join(frozen.select("pdb_id", F.lit(True).alias("excluded")), "pdb_id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    out = marked.filter("excluded")
    lower = joins.keep_ids(joins.drop_ids(candidates, rank1.select("pdb_id", "seed", "sample"), "pdb_id", "seed", "sample"), out, "pdb_id").groupBy("pdb_id").agg(F.count_if(F.col("rmsd") >= 0).alias("n"))
    supplement = out.select("pdb_id").join(lower, "pdb_id", "left").select("pdb_id", F.coalesce("n", F.lit(0)).alias("n_lower_valid"))
    return {"main": stats.main_table(marked, "rmsd", "excluded", "time_group", "length_group", "chain_count_group"), "supplement": supplement, "ecdf": stats.ecdf(marked.filter(~F.col("excluded")), "rmsd")}


def resource_coverage(needed: DataFrame, sources: Sequence[tuple[str, DataFrame]]) -> Tables:
    """needed(pdb_id, sequence), sources of (sequence, path): where each distinct sequence's resource
    comes from, its uses, and counts by source."""
    rows = needed.withColumn("sequence", S.spelling_key(S.normalise_sequence(F.col("sequence"))))
    found = joins.by_priority(rows.select("sequence").distinct(), sources, "sequence", "path")
    return {"sequences": found, "usage": rows.join(found, "sequence"), "counts": stats.value_counts(found, "source_type")}


def aligned_report(pairs: DataFrame) -> DataFrame:
    """pairs(sample, truth, predicted): identity by affine gaps and the longer length, matched residues and a
    note for each sample."""
    rows = alignment.report_identity(pairs, "truth", "predicted")
    note = F.when(F.col("identity") == 1, "identical").when(F.col("aligned") < 10, "skipped: too few residues").otherwise("aligned")
    return rows.select("sample", "identity", "aligned", note.alias("note"))


def presence_report(ids: DataFrame, files: DataFrame, folders: DataFrame, samples: DataFrame, expected: int) -> DataFrame:
    """Each listed id: whether it has a file and a folder, its samples, and PASS if all are there."""
    low = lambda df: df.select(F.lower("pdb_id").alias("id"))
    n = low(samples).groupBy("id").agg(F.count(F.lit(1)).alias("n_samples"))
    met = ids.withColumn("id", F.lower("pdb_id")).join(low(files).distinct().withColumn("f", F.lit(True)), "id", "left").join(low(folders).distinct().withColumn("d", F.lit(True)), "id", "left").join(n, "id", "left")
    f, d, k = F.coalesce("f", F.lit(False)), F.coalesce("d", F.lit(False)), F.coalesce("n_samples", F.lit(0))
    return met.select("pdb_id", f.alias("has_file"), d.alias("has_folder"), k.alias("n_samples"), F.when(f & d & (k == expected), "PASS").otherwise("FAIL").alias("status"))
