"""Sources: id lists, listings, task and metric documents, sequence files, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions.scalars import clean_token, finite_or_null, normalise_id
from helixlake.operators.joins import assert_unique
from helixlake.operators.ranking import counted_before

TASK_DDL = "array<struct<name:string,sequences:array<struct<rnaSequence:struct<sequence:string,count:int,unpairedMsaPath:string>>>>>"
METRIC_DDL = "struct<status:string,rmsd:string,lddt:string,tm_score:string>"


def id_list(spark: SparkSession, path: str, sep: str = ",", header: str = "pdb_id") -> DataFrame:
    """(pdb_id, ord, n): first column of a delimited text, normalised, blanks and the header dropped,
    the first of repeated ids kept with the number of its repeats; ord counts ids from 0 in the order in which
    they are first seen, in the files by name and in each from its first line on.

    A split of a file is read by one task from its first line to its last, so a line's place is its file,
    where its split begins in it, and its turn in the split, whatever the order in which tasks run."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("turn"))
    lines = spark.read.text(path).select("value", place.alias("ord"))
    return distinct_ids(lines.select(F.split("value", sep)[0].alias("id"), "ord"), header)


def distinct_ids(rows: DataFrame, header: str = "pdb_id") -> DataFrame:
    """Of (id, ord): normalised ids once with their number, counted from 0 in the order of their first place."""
    ids = rows.filter(F.lower(F.trim("id")) != header).select(normalise_id(F.col("id"), underscore=True).alias("pdb_id"), "ord").filter("pdb_id IS NOT NULL")
    ids = ids.groupBy("pdb_id").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
    return counted_before(ids.withColumn("one", F.lit(1)), "one", "first").select("pdb_id", F.col("before").alias("ord"), "n")


def exclusion_list(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Ids of a text with `#` comments; malformed or repeated ones are an error if strict, else they
    go (malformed) or count once."""
    lines = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("raw")).filter("raw <> ''")
    ids = lines.select("raw", normalise_id(F.col("raw")).alias("pdb_id"))
    if strict:
        bad = ids.filter("pdb_id IS NULL").limit(3).collect()
        if bad:
            raise ValueError(f"malformed ids: {[r['raw'] for r in bad]}")
        assert_unique(ids, "pdb_id")
    return ids.filter("pdb_id IS NOT NULL").select("pdb_id").distinct()


def first_column(df: DataFrame) -> DataFrame:
    """The ids in the first column of a sheet, once each."""
    return df.select(normalise_id(F.col(df.columns[0]).cast("string")).alias("pdb_id")).filter("pdb_id IS NOT NULL").distinct()


def listing(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, name, stem, length) of the files under root; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length")


def inventory(files: DataFrame, ids: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(pdb_id, path): files whose stem is an id in any case, or an alias(alias, pdb_id) of one, outside
    quarantine folders."""
    names = ids.select(F.upper("pdb_id").alias("alias"), "pdb_id")
    if aliases is not None:
        names = names.unionByName(aliases.select(F.upper("alias").alias("alias"), "pdb_id")).distinct()
    good = files.filter(~F.lower("path").contains("/quarantine/")).withColumn("alias", F.upper("stem"))
    return good.join(names, "alias").select("pdb_id", "path")


def unique_stems(files: DataFrame) -> DataFrame:
    return assert_unique(files.select(F.upper("stem").alias("pdb_id"), "path"), "pdb_id")


def document_kind(files: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """(pdb_id, kind, path) by file-name suffix; the longest that fits."""
    kind = F.lit(None).cast("string")
    stem = F.col("name")
    for k, suffix in sorted(suffixes.items(), key=lambda x: len(x[1])):
        fits = F.col("name").endswith(suffix)
        kind, stem = F.when(fits, k).otherwise(kind), F.when(fits, F.expr(f"left(name, length(name) - {len(suffix)})")).otherwise(stem)
    return files.select(F.upper(stem).alias("pdb_id"), kind.alias("kind"), "path").filter("kind IS NOT NULL")


_LAYOUT = r"pred_output_([^/]+)_seed_(\d+)/[^/]+/seed_\d+/predictions/[^/]*?_(?:(summary_confidence)_)?sample_(\d+)\.(?:cif|json)$"


def prediction_layout(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate files (pdb_id, seed, sample, kind, path) by their place, and issues (pdb_id, seed,
    issue): a target and seed with several prediction folders."""
    part = lambda k: F.regexp_extract("path", _LAYOUT, k)
    files = paths.filter(F.col("path").rlike(_LAYOUT)).select(F.upper(part(1)).alias("pdb_id"), part(2).cast("int").alias("seed"), part(4).cast("int").alias("sample"), F.when(part(3) != "", "confidence").otherwise("prediction").alias("kind"), "path")
    folder = F.regexp_extract("path", r"^(.*/predictions)/", 1)
    issues = files.groupBy("pdb_id", "seed").agg(F.countDistinct(folder).alias("n")).filter("n > 1").select("pdb_id", "seed", F.concat(F.lit("several prediction folders: "), F.col("n").cast("string")).alias("issue"))
    return files, issues


def folder_presence(paths: DataFrame) -> DataFrame:
    """Files of each target and seed folder."""
    part = lambda k: F.regexp_extract("path", r"pred_output_([^/]+)_seed_(\d+)/", k)
    return paths.filter(part(1) != "").groupBy(F.upper(part(1)).alias("pdb_id"), part(2).cast("int").alias("seed")).agg(F.count(F.lit(1)).alias("n_files"))


def task_chains(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Expanded chains (key, entry_no, copy_no, sequence, msa_path) of task documents, a row for each of
    `count` copies, and issues (key, issue) of documents that can't be read or have no chain."""
    read = documents.select(key, F.from_json(text, TASK_DDL).alias("d"))
    entries = read.select(key, F.explode("d").alias("job")).select(key, F.posexplode("job.sequences").alias("entry_no", "s"))
    rna = entries.filter("s.rnaSequence IS NOT NULL").select(key, "entry_no", "s.rnaSequence.*")
    copies = F.sequence(F.lit(1), F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)))
    chains = rna.select(key, "entry_no", F.explode(copies).alias("copy_no"), "sequence", F.col("unpairedMsaPath").alias("msa_path"))
    none = read.join(rna.select(key).distinct(), key, "left_anti")
    issues = none.select(key, F.when(F.col("d").isNull() | (F.size("d") == 0) | F.col("d")[0]["sequences"].isNull(), "unreadable document").otherwise("no RNA chain").alias("issue"))
    return chains, issues


def candidate_metrics(manifest: DataFrame, outputs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """manifest plus eval_status and metrics of its JSON: missing_output, invalid_output, ost_failure,
    or SUCCESS, which needs a finite rmsd of 0 or more. Metrics are null unless SUCCESS."""
    met = manifest.join(outputs.select(*keys, F.col(text).alias("__raw")), list(keys), "left").withColumn("__m", F.from_json("__raw", METRIC_DDL))
    rmsd, status = finite_or_null(F.col("__m.rmsd")), F.upper("__m.status")
    state = F.when(F.col("__raw").isNull(), "missing_output").when(status.isNull(), "invalid_output").when(status != "SUCCESS", "ost_failure").when(rmsd >= 0, "SUCCESS").otherwise("invalid_output")
    out = met.withColumn("eval_status", state)
    return out.withColumns({c: F.when(F.col("eval_status") == "SUCCESS", finite_or_null(F.col(f"__m.{c}"))) for c in ("rmsd", "lddt", "tm_score")}).drop("__raw", "__m")


def confidence_scores(documents: DataFrame, text: str) -> DataFrame:
    """documents plus ranking_score, or why there is none."""
    score = finite_or_null(F.get_json_object(text, "$.ranking_score"))
    parsed = F.get_json_object(text, "$")
    why = F.when(F.col(text).isNull(), "missing").when(parsed.isNull(), "unreadable").when(score.isNull(), "no finite ranking_score")
    return documents.withColumns({"ranking_score": score, "score_issue": why})


def alignment_records(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rec_no, header, sequence) of aligned-sequence texts (records begin with `>`)."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), "\n>"), lambda x: x.isNotNull())
    rows = files.select(key, F.posexplode(parts).alias("rec_no", "r")).filter("rec_no > 0")
    return rows.select(key, "rec_no", F.trim(F.split("r", "\n")[0]).alias("header"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "").alias("sequence"))


def alignment_audit(files: DataFrame, key: str, text: str) -> DataFrame:
    """Depth, query (record 1 without insertions and gaps), digest and first error of each file."""
    recs = alignment_records(files, key, text)
    query = F.min_by(F.regexp_replace("sequence", "[a-z.-]", ""), "rec_no")
    got = recs.groupBy(key).agg(F.count(F.lit(1)).alias("depth"), query.alias("query"), F.count_if(F.col("sequence") == "").alias("n_empty"))
    head = F.trim(F.split(F.concat(F.lit("\n"), F.col(text)), "\n>")[0])
    met = files.select(key, F.sha2(text, 256).alias("sha256"), (head != "").alias("early")).join(got, key, "left")
    issue = F.when(F.col("depth").isNull(), "no record").when(F.col("early"), "text before the first record").when(F.col("n_empty") > 0, "empty record")
    return met.select(key, F.coalesce("depth", F.lit(0)).alias("depth"), "query", "sha256", issue.alias("issue"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(pdb_id, entity, sequence) of records named `>PDB__ENTITY_n`."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")))


def fasta_records(values: DataFrame) -> DataFrame:
    """Of the texts between the `>` at line starts."""
    head = F.split("value", "\n")[0]
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")
    return values.filter(F.trim("value") != "").select(F.regexp_extract(head, r"^(.+?)__", 1).alias("pdb_id"), F.regexp_extract(head, r"__(.+)$", 1).alias("entity"), body.alias("sequence"))


def metadata(df: DataFrame, key: str, value: str, parse) -> DataFrame:
    """(key, value) of a table whose header may be in any case; the key has to be unique and the value
    goes through `parse`, a Column to Column function."""
    by = {c.lower(): c for c in df.columns}
    missing = [c for c in (key, value) if c.lower() not in by]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = df.select(normalise_id(F.col(by[key.lower()])).alias(key), parse(F.col(by[value.lower()])).alias(value)).filter(F.col(key).isNotNull())
    return assert_unique(out, key)


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table; the separator is the commonest of tab, semicolon and comma in its first line."""
    first = spark.read.text(path).head(1)
    line = first[0][0] if first else ""
    sep = max("\t;,", key=line.count)
    return spark.read.option("header", True).option("sep", sep).csv(path)


def manifest(df: DataFrame, required: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """df, once it has the required columns and its keys are unique."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return assert_unique(df, *keys)


def latest_report(runs: DataFrame, status: str = "PASS") -> DataFrame:
    """The path of the newest run of that status, for each kind of run: runs(kind, run_id, status, path)."""
    return runs.filter(F.col("status") == status).groupBy("kind").agg(F.max("run_id").alias("run_id"), F.max_by("path", "run_id").alias("path"))


def samples_of(pairs: DataFrame, split: str | None = None, names: DataFrame | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """A coordinate-pair dataset cut to a split, or to a list of sample names, and to some fields."""
    out = pairs if split is None else pairs.filter(F.col("split") == split)
    if names is not None:
        out = out.join(names, names.columns, "left_semi")
    return out.select(*fields) if fields else out


def revisions(rows: DataFrame, entry: str, ordinal: str, day: str) -> DataFrame:
    """Each entry's date of least revision ordinal (unreadable: last), then the earlier date."""
    number = F.coalesce(F.col(ordinal).try_cast("int"), F.lit(10**9))
    date = F.try_to_date(clean_token(F.col(day)))
    return rows.groupBy(entry).agg(F.min(F.when(date.isNotNull(), F.struct(number.alias("o"), date.alias("d")))).alias("m")).select(entry, F.col("m.d").alias("revision_date"))


def release_dates(revision: DataFrame, legacy: DataFrame, entry: str, today: Column) -> DataFrame:
    """(entry, release_date, source, issue): the revision date, else the legacy one; both and unequal is
    a conflict, and a date after today an error."""
    met = revision.join(legacy.select(entry, "legacy_date"), entry, "full_outer")
    day = F.coalesce("revision_date", "legacy_date")
    issue = F.when(F.col("revision_date").isNotNull() & F.col("legacy_date").isNotNull() & (F.col("revision_date") != F.col("legacy_date")), "date conflict").when(day.isNull(), "no date").when(day > today, "date in the future")
    return met.select(entry, day.alias("release_date"), F.when(F.col("revision_date").isNotNull(), "revision").when(F.col("legacy_date").isNotNull(), "legacy").alias("source"), issue.alias("issue"))


def methods(rows: DataFrame, entry: str, order: str, method: str) -> DataFrame:
    """Methods of each entry: distinct in order joined by '; ', and sorted joined by ' | '."""
    m = clean_token(F.col(method))
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(m.isNotNull(), F.struct(F.col(order).alias("o"), m.alias("m"))))), lambda s: s["m"]))
    return rows.groupBy(entry).agg(F.array_join(ordered, "; ").alias("methods"), F.array_join(F.sort_array(F.collect_set(m)), " | ").alias("methods_sorted"))


def first_model(atoms: DataFrame, entry: str, model: str, *order: str) -> DataFrame:
    """Atoms of each entry's first model: the least number, or without numbers the first text there is
    in that order of the rows."""
    n, text = F.col(model).try_cast("int"), clean_token(F.col(model))
    first = atoms.groupBy(entry).agg(F.min(n).alias("n"), F.min(F.when(text.isNotNull(), F.struct(*order, text.alias("t")))).alias("f")).select(entry, "n", "f.t")
    met = atoms.join(first, entry)
    return met.filter(F.when(F.col("n").isNotNull(), n == F.col("n")).otherwise(F.col(model).eqNullSafe(F.col("t")))).drop("n", "t")


def coordinate_issues(atoms: DataFrame, entry: str, row: str) -> DataFrame:
    """Per entry the number of atoms, of atoms without three finite coordinates, and the first of these."""
    bad = finite_or_null(F.col("x")).isNull() | finite_or_null(F.col("y")).isNull() | finite_or_null(F.col("z")).isNull()
    return atoms.groupBy(entry).agg(F.count(F.lit(1)).alias("n_atoms"), F.count_if(bad).alias("n_bad"), F.min(F.when(bad, F.col(row))).alias("first_bad"))


