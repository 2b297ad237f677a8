"""Scalar rules of the engine: Column to Column, no Python in the rows' path.

Missing text is null, '', '.' or '?'; missing numbers are null, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data format and its tools.
NULL_TOKENS = ("", ".", "?")
TRUTHY = ("1", "true", "yes", "y", "on")
LENGTH_BINS = (("1-20", 20), ("21-50", 50), ("51-100", 100), ("101-200", 200), (">200", None))
CHAIN_GROUPS = ("1", "2", "3", "4", ">=5", "unknown")
RIBOSOME_WORDS = ("ribosome", "ribosomal", "50s", "30s", "70s", "80s", "40s", "60s")
BOUND_RNA_WORDS = ("trna", "mrna", "transfer rna", "messenger rna", "aptamer")
RNA_TYPE, PROTEIN_TYPE, DNA_TYPE = "polyribonucleotide", "polypeptide", "polydeoxyribonucleotide"
LDDT_MARKERS = ("Computing all-atom lDDT", "ValueError: need at least one array to concatenate")
TM_MARKERS = ("Computing RMSD", "Computing patch TM-score", "ERROR! No assignable chain")
ATOMIC_NUMBERS = {"C": 6, "N": 7, "O": 8, "P": 15, "S": 16, "MG": 12, "ZN": 30, "FE": 26}
COMMON_RESIDUES = {"A": "A", "C": "C", "G": "G", "U": "U", "ADE": "A", "CYT": "C", "GUA": "G", "URA": "U"}
FAILURE_CODES = (  # what the log holds in lower case, all of it, and the code; the first that fits
    (("gdt", "window size"), "GDT_TOO_FEW_MAPPED_POSITIONS"),
    (("arrays used as indices must be of integer (or boolean) type",), "CHAIN_MAPPING_INDEX_ERROR"),
    (("need at least one array to concatenate",), "LDDT_EMPTY_ARRAY"),
    (("computing rmsd", "error! no assignable chain"), "DOWNSTREAM_TM_NO_ASSIGNABLE_CHAIN_AFTER_RMSD"),
    (("timeout after",), "TIMEOUT"),
    (("ost status is 'failure'",), "OST_FAILURE_OTHER"),
)
FAILURE_STAGES = (  # likewise: the stage and its detail
    (("gdt", "window size"), "RIGID_GDT", "Too few mapped positions for GDT before RMSD serialization"),
    (("arrays used as indices must be of integer (or boolean) type",), "CHAIN_MAPPING", "OpenStructure 2.8 NumPy integer/boolean index error"),
    (("computing rmsd", "error! no assignable chain"), "DOWNSTREAM_TM_SCORE", "USalign reported no assignable chain after RMSD stage was reached"),
    (("need at least one array to concatenate",), "ALL_ATOM_LDDT", "OpenStructure 2.8 lDDT empty-array error"),
    (("timeout after",), "TIMEOUT", "Per-candidate evaluation timeout"),
    (("computing chain mapping",), "CHAIN_MAPPING", "Unclassified failure during/after chain mapping"),
)
UNKNOWN_STAGE = ("UNKNOWN", "See stderr excerpt")


def finite_or_null(c: Column) -> Column:
    """A double, or null if it isn't one, or is NaN or infinite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean_token(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin(*NULL_TOKENS), t)


def normalise_id(c: Column, underscore: bool = False) -> Column:
    """Trimmed and upper-cased; null unless it is four letters or digits (or, if asked, underscores)."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike("^[A-Z0-9_]{4}$" if underscore else "^[A-Z0-9]{4}$"), t)


def normalise_sequence(c: Column, upper: bool = True) -> Column:
    t = F.regexp_replace(c, r"\s+", "")
    return F.upper(t) if upper else t


def search_alphabet(c: Column) -> Column:
    """U to T, and whatever isn't A, C, G or T to N."""
    return F.regexp_replace(F.translate(c, "U", "T"), "[^ACGT]", "N")


def count_of(c: Column, letter: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))


def spelling_key(c: Column) -> Column:
    return F.translate(c, "T", "U")


def residue_tokens(c: Column) -> Column:
    """One token for each letter; a modified residue in brackets is one."""
    return F.regexp_extract_all(c, F.lit(r"\([^)]*\)|[A-Za-z?]"), F.lit(0))


def sequence_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def chain_label(n: Column) -> Column:
    """1 is A, 26 Z, 27 AA, up to three letters; null beyond and below 1."""
    n = n.cast("int")
    letter = lambda x: F.chr(F.pmod(x, F.lit(26)) + 65)
    two, three = F.floor((n - 1) / 26), F.floor((n - 703) / 676)
    return (
        F.when(n.between(1, 26), letter(n - 1)).when(n.between(27, 702), F.concat(letter(two - 1), letter(n - 1)))
        .when(n.between(703, 18278), F.concat(letter(three), letter(F.floor((n - 703) / 26)), letter(n - 703)))
    )


def residue_letter(c: Column, tabulated: Column | None = None) -> Column:
    """The usual nucleotide names, else the tabulated letter, else X."""
    name = F.upper(clean_token(c))
    known = F.create_map(*[F.lit(x) for pair in COMMON_RESIDUES.items() for x in pair])
    letter = F.upper(F.trim(tabulated)) if tabulated is not None else F.lit(None).cast("string")
    return F.coalesce(F.when(name.isNotNull(), F.try_element_at(known, name)), F.when(letter.rlike("^[A-Z]$"), letter), F.lit("X"))


def resolution_smallest(*tags: Column) -> Column:
    """The least finite value above 0."""
    good = [F.when(finite_or_null(t) > 0, finite_or_null(t)) for t in tags]
    return F.array_min(F.array(*good))


def resolution_first(refine: Column, em: Column, reflns: Column) -> Column:
    """The first that isn't missing, of refinement, microscopy and reflections."""
    return finite_or_null(F.coalesce(*map(clean_token, (refine, em, reflns))))


def resolution_strict(refine: Column, reflns: Column, em: Column) -> Column:
    """The first that is written down at all: a written `?` is no number and ends the search."""
    written = [F.when(F.trim(c) != "", F.trim(c)) for c in (refine, reflns, em)]
    return finite_or_null(F.coalesce(*written))


def chronological_split(day: Column, train_end, val_end) -> Column:
    return F.when(day <= F.lit(train_end), "train").when(day <= F.lit(val_end), "val").when(day.isNotNull(), "test")


def time_group(day: Column, cutoff) -> Column:
    return F.when(day > F.lit(cutoff), "post_cutoff").when(day.isNotNull(), "pre_or_on_cutoff")


def length_group(n: Column) -> Column:
    """The bin of a length; each bin has its upper edge, the first also 0."""
    x = finite_or_null(n)
    out = F.when(x.isNull() | (x < 0), F.lit(None))
    for label, top in LENGTH_BINS[:-1]:
        out = out.when(x <= top, label)
    return out.otherwise(LENGTH_BINS[-1][0])


def chain_count_group(n: Column) -> Column:
    x = finite_or_null(n)
    return F.when(x.isNull(), "unknown").when(x >= 5, ">=5").otherwise(x.cast("int").cast("string"))


def has_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(c.contains(w), F.lit(False))
    return out


def has_all(c: Column, words) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.coalesce(c.contains(w), F.lit(False))
    return out


def structure_class(title: Column, descriptions: Column, types: Column) -> Column:
    """From the title, the entities' descriptions and the polymer types (text, any case)."""
    text, kinds = F.lower(F.concat_ws("\n", title, descriptions)), F.lower(F.coalesce(types, F.lit("")))
    rna, protein, dna = (kinds.contains(t) for t in (RNA_TYPE, PROTEIN_TYPE, DNA_TYPE))
    ribosome, bound = has_any(text, RIBOSOME_WORDS), has_any(text, BOUND_RNA_WORDS)
    return F.when(ribosome & bound, "ribosome_bound").when(ribosome, "ribosome").when(protein & rna, "rna_protein").when(rna & ~protein & ~dna, "pure_rna").otherwise("others")


def is_pure_rna(types: Column) -> Column:
    """types: an array of the entry's polymer types. Its only one, lower-cased, is RNA."""
    return F.array_distinct(F.transform(F.filter(types, lambda t: t.isNotNull()), lambda t: F.lower(F.trim(t)))) == F.array(F.lit(RNA_TYPE))


def contains_rna(types: Column) -> Column:
    """The looser rule of the chain maps: a hybrid of DNA and RNA also counts."""
    return F.exists(types, lambda t: F.lower(t).contains(RNA_TYPE))


def eligibility(current: Column, legacy: Column, valid: Column, pure: Column) -> Column:
    return F.when(current & valid & pure, "ELIGIBLE_CURRENT").when(current & valid, "CURRENT_LIST_POLYMER_MISMATCH").when(legacy & ~current, "LEGACY_ONLY").otherwise("NOT_ASSESSED")


def file_status(present: Column, valid: Column) -> Column:
    return F.when(~present, "MISSING").when(valid, "VALID").otherwise("INVALID")


def sync_status(present: Column, valid: Column) -> Column:
    return F.when(~present, "NOT_DOWNLOADED").when(valid, "EXISTING_VALID").otherwise("EXISTING_INVALID")


def low_resolution_bucket(resolution: Column, threshold: float) -> Column:
    return F.when(resolution.isNull(), "no_resolution").when(resolution > threshold, "removed").otherwise("kept")


def _first_fit(low: Column, rules, other: Column, value) -> Column:
    out = other
    for words, *rest in reversed(rules):
        out = F.when(has_all(low, words), value(*rest)).otherwise(out)
    return out


def failure_code(rescue_log: Column, standard_log: Column, ok: Column) -> Column:
    """Why a candidate has no metric; '' if it has one."""
    text = F.concat_ws("\n", rescue_log, standard_log)
    rest = F.when(text == "", "NO_ERROR_LOG").otherwise("OTHER")
    return F.when(F.coalesce(ok, F.lit(False)), "").otherwise(_first_fit(F.lower(text), FAILURE_CODES, rest, F.lit))


def failure_stage(log: Column) -> Column:
    """(stage, detail); in another order than failure_code."""
    pair = lambda a, b: F.struct(F.lit(a).alias("stage"), F.lit(b).alias("detail"))
    return _first_fit(F.lower(F.coalesce(log, F.lit(""))), FAILURE_STAGES, pair(*UNKNOWN_STAGE), pair)


def log_error_class(log: Column) -> Column:
    return (
        F.when(has_all(log, ("Dataloader initialization failed", "mmcif directory")), "missing_template_data").when(log.contains("use_template=false"), "needs_no_template")
        .when(has_any(log, ("CUDA out of memory", "OOM")), "out_of_memory").when(has_any(log, ("FileNotFoundError", "No such file")), "missing_input").otherwise("other")
    )


def first_line(log: Column, width: int = 120) -> Column:
    line = F.split(F.trim(F.coalesce(log, F.lit(""))), "\n")[0]
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line)


def rescue_reason(standard_valid: Column, log: Column) -> Column:
    return (
        F.when(F.coalesce(standard_valid, F.lit(False)), F.lit(None)).when(has_all(log, LDDT_MARKERS), "LDDT_EMPTY_ARRAY_BEFORE_RIGID_SCORE")
        .when(has_all(log, TM_MARKERS), "DOWNSTREAM_TM_NO_ASSIGNABLE_CHAIN_AFTER_RMSD")
    )


def fraction(c: Column) -> Column:
    """Values above 1 are percent."""
    x = finite_or_null(c)
    return F.when(x > 1, x / 100).otherwise(x)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUTHY), F.lit(False))


def unknown_symbols(sequence: Column, known: str = "ACGU") -> Column:
    """The other letters of a sequence, each once, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(sequence, f"[{known}]", ""), ""))), "")


def atomic_number(element: Column) -> Column:
    """Null for hydrogen and for elements that aren't used."""
    known = F.create_map(*[F.lit(x) for pair in ATOMIC_NUMBERS.items() for x in pair])
    return F.try_element_at(known, F.upper(F.trim(element)))


def atom_name(c: Column) -> Column:
    return F.translate(F.upper(F.trim(c)), "*", "'")


def sample_file(name: Column) -> Column:
    """(id, seed, source) of a sample's file name `<id>..._s<seed>_<source>.pt`."""
    part = lambda k: F.regexp_extract(name, r"^([^_]+).*?_s(\d+)_(.+)\.pt$", k)
    ok = name.rlike(r"_s\d+_.+\.pt$")
    return F.when(ok, F.struct(part(1).alias("id"), part(2).cast("int").alias("seed"), part(3).alias("source")))


def cost_weight(tokens: Column) -> Column:
    n = F.greatest(F.lit(1), F.coalesce(tokens.cast("long"), F.lit(1)))
    return n * n


def prep_status(has_document: Column, valid: Column, missing: Column, rebased: Column) -> Column:
    return F.when(~has_document, "MISSING_UPDATED_JSON").when(~valid, "INVALID_UPDATED_JSON").when(missing > 0, "INCOMPLETE_MSA").when(rebased > 0, "COMPLETE_REBASABLE").otherwise("COMPLETE")


def target_status(raw_valid: Column, prep: Column, complete_seeds: Column, seeds: int) -> Column:
    return F.when(~raw_valid, "NEED_JSON").when(~prep.isin("COMPLETE", "COMPLETE_REBASABLE"), "NEED_PREP").when(complete_seeds != seeds, "NEED_PRED").otherwise("COMPLETE")


def target_action(prep: Column, missing_seeds: Column, excluded: Column) -> Column:
    return F.when(~prep.isin("COMPLETE", "COMPLETE_REBASABLE"), "DEFER_PREP").when(missing_seeds == 0, "COMPLETE").when(excluded, "QUARANTINE").otherwise("SCHEDULE")


def same_document(a: Column, b: Column, ignored: Sequence[str] = ()) -> Column:
    """Whether two JSON texts are equal but for the text members of these names, at any depth, and the
    order of members. Null if one of them can't be read."""
    member = "|".join(ignored)
    one = rf'"(?:{member})":(?:"(?:[^"\\]|\\.)*"|null)'

    def plain(c: Column) -> Column:
        text = F.to_json(F.try_parse_json(c))
        for pattern in (f"{one},", f",{one}", one) if ignored else ():
            text = F.regexp_replace(text, pattern, "")
        return text

    return plain(a) == plain(b)


def fixed_number(c: Column, digits: int = 6) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", c), F.lit(""))


def log_excerpt(log: Column, width: int = 3000) -> Column:
    return F.translate(F.right(F.coalesce(log, F.lit("")), F.lit(width)), "\r\n", "  ")


def sheet_cell(text: Column, width: int = 32_000) -> Column:
    return F.substring(text, 1, width)


def improvement(before: Column, after: Column) -> tuple[Column, Column]:
    """The gain and its share in percent, 0 where there was nothing to gain."""
    return before - after, F.when(before > 0, (before - after) / before * 100).otherwise(0.0)


def target_id(entry: Column, chain: Column) -> Column:
    return F.concat_ws("_", entry, chain)


def window_starts(n: Column, window: int, overlap: int) -> Column:
    """Where windows over n places start, a last one flush with the end."""
    stride = window - overlap
    if not 0 <= overlap < window:
        raise ValueError("0 <= overlap < window")
    last = (n - window).cast("int")
    return F.when(n <= window, F.array(F.lit(0))).otherwise(F.array_union(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(F.greatest(last, F.lit(0)))))
