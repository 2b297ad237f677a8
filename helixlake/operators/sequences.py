"""Sequence similarity: exact joins by edit distance, global identity with linear gaps (for affine ones
see alignment)."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.sources.shared import write_shared

SLACK, MOST_GRAM, COMMON, BLOCK = 1e-12, 8, 200, 1_000


def _edits(length: Column, min_identity: float) -> Column:
    """Edits that a pair may have whose longer sequence has this length."""
    return F.floor((1 - min_identity + SLACK) * length).cast("int")


def _gram(length: Column, min_identity: float) -> Column:
    """The length of grams for pairs whose longer sequence has this length: the longest of which some stay
    whole, whatever the edits."""
    return F.least(F.lit(MOST_GRAM), F.floor(length / (_edits(length, min_identity) + 1))).cast("int")


def numbered(sequences: DataFrame, column: str) -> DataFrame:
    """The written table (id, s, n) of distinct sequences that aren't empty."""
    one = sequences.select(F.col(column).cast("string").alias("s")).filter("s <> ''").distinct()
    return write_shared(one.select(F.monotonically_increasing_id().alias("id"), "s", F.length("s").alias("n")), "sequences")


def prefix_grams(one: DataFrame, min_identity: float) -> DataFrame:
    """(id, n, q, own, g, df): each sequence's rarest grams, of a length for each length of a longer partner
    (`own`: for its own). A pair within the edits has a gram that is among these of both.

    With d edits at most q * d of a sequence's grams are touched. So of the grams in order of rarity, the
    first that both have comes before more than q * d others, counted with repeats, have passed."""
    partner = F.filter(F.sequence("n", F.floor(F.col("n") / min_identity + SLACK).cast("int") + 1), lambda m: (m - _edits(m, min_identity) <= F.col("n")) & (_edits(m, min_identity) > 0))
    roles = one.withColumn("m", partner).filter(F.size("m") > 0)
    most = _edits(F.array_max("m"), min_identity)
    roles = roles.select("id", "s", "n", most.alias("d"), F.explode(F.array_distinct(F.transform("m", lambda m: _gram(m, min_identity)))).alias("q")).filter("n >= q")
    grams = roles.select("id", "n", "q", "d", F.explode(F.expr("transform(sequence(1, n - q + 1), i -> substring(s, i, q))")).alias("g"))
    grams = grams.groupBy("id", "n", "q", "d", "g").agg(F.count(F.lit(1)).alias("times"))
    grams = grams.join(grams.groupBy("q", "g").agg(F.count(F.lit(1)).alias("df")), ["q", "g"])
    passed = F.sum("times").over(Window.partitionBy("id", "q").orderBy("df", "g").rowsBetween(Window.unboundedPreceding, -1))
    kept = grams.withColumn("passed", F.coalesce(passed, F.lit(0))).filter(F.col("passed") <= F.col("q") * F.col("d"))
    return kept.select("id", "n", "q", (F.col("q") == _gram(F.col("n"), min_identity)).alias("own"), "g", "df")


def _in_blocks(one: DataFrame, common: DataFrame, min_identity: float) -> DataFrame:
    """(a, an, b, bn): pairs of sequences that have only common grams to meet by, within the edits: blocks of
    BLOCK sequences of like lengths are compared with each other."""
    step = -math.log(min(min_identity, 0.99))
    shelf = lambda n: F.floor(F.log(n) / step).cast("int")
    rows = common.join(one.select("id", "s"), "id")
    long = rows.filter("own").withColumn("shelf", shelf(F.col("n")))
    cut = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    cuts = rows.select("q", F.explode(F.sequence(shelf(F.col("n")), shelf(F.col("n") / min_identity + 1))).alias("shelf")).groupBy("q", "shelf").agg(cut.alias("cut"))
    brief = rows.withColumn("shelf", F.explode(F.sequence(shelf(F.col("n")), shelf(F.col("n") / min_identity + 1)))).join(cuts, ["q", "shelf"])
    every, mine = F.explode(F.sequence(F.lit(0), F.col("cut") - 1)), F.pmod(F.xxhash64("id"), F.col("cut")).cast("int")
    long = long.join(cuts, ["q", "shelf"]).withColumn("i", mine).withColumn("j", every).select("q", "shelf", "i", "j", F.col("id").alias("li"), F.col("s").alias("a"), F.col("n").alias("an"))
    brief = brief.withColumn("j", mine).withColumn("i", every).select("q", "shelf", "i", "j", F.col("id").alias("bi"), F.col("s").alias("b"), F.col("n").alias("bn"))
    like = (F.col("an") - F.col("bn") <= _edits(F.col("an"), min_identity)) & ((F.col("bn") < F.col("an")) | (F.col("bn") == F.col("an")) & (F.col("bi") < F.col("li")))
    met = long.join(brief, ["q", "shelf", "i", "j"]).filter(like)
    return met.select("a", "an", "b", "bn")


def similar_pairs(sequences: DataFrame, column: str, min_identity: float, *, short: int | None = None) -> DataFrame:
    """(a, b, distance, identity) of distinct sequences a < b with identity 1 - d / longer length of at
    least min_identity; with `short`, only pairs whose shorter is under that length.

    Pairs meet on rare grams (prefix_grams), of which a sequence has no more than letters, and are verified
    in the join; that finds every pair. A gram in more than COMMON sequences tells too little: sequences
    that have such a gram among their rarest meet block by block instead, once a pair. With few letters
    and low identities (four letters and 0.8) all long sequences are of that kind, and the work
    grows with the square of their number, though no longer with their length.
    """
    one = numbered(sequences, column)
    grams = write_shared(prefix_grams(one, min_identity), "grams")
    rare = grams.filter(F.col("df") <= COMMON)
    a = rare.filter("own").select("q", "g", F.col("id").alias("ai"), F.col("n").alias("an"))
    b = rare.select("q", "g", F.col("id").alias("bi"), F.col("n").alias("bn"))
    like = (F.col("an") - F.col("bn") <= _edits(F.col("an"), min_identity)) & ((F.col("bn") < F.col("an")) | (F.col("bn") == F.col("an")) & (F.col("bi") < F.col("ai")))
    met = a.join(b, ["q", "g"]).filter(like).select("ai", "an", "bi", "bn").distinct()
    text = lambda k: one.select(F.col("id").alias(k + "i"), F.col("s").alias(k))
    met = met.join(text("a"), "ai").join(text("b"), "bi").select("a", "an", "b", "bn")
    met = met.unionByName(_in_blocks(one, grams.filter(F.col("df") > COMMON).select("id", "n", "q", "own").distinct(), min_identity))
    if short is not None:
        met = met.filter(F.col("bn") < short)
    found = met.withColumn("d", _edits(F.col("an"), min_identity)).withColumn("distance", F.expr("levenshtein(b, a, d)")).filter("distance >= 0")
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", (1 - F.col("distance") / F.col("an")).alias("identity"))
    return pairs.distinct()


def filter_hits(hits: DataFrame, min_identity: float = 0.8, min_coverage: float = 0.8) -> DataFrame:
    """A supplied hit table at both thresholds; values above 1 are percent. A different measure from
    similar_pairs: a part of a longer sequence can pass here."""
    from helixlake.functions.scalars import fraction

    clean = hits.withColumns({c: fraction(F.col(c)) for c in ("identity", "qcov", "tcov")})
    return clean.filter((F.col("identity") >= min_identity - SLACK) & (F.col("qcov") >= min_coverage - SLACK) & (F.col("tcov") >= min_coverage - SLACK) & (F.col("query") != F.col("target")))


_TOKENS = re.compile(r"\([^)]*\)|[A-Za-z?]")
_MATCH, _COLUMN, _SCORE = 1 << 20, 1, 1 << 41


def _table(a: list[str], b: list[str]) -> np.ndarray:
    """Best alignments of all prefixes, as one number: score, then matches, then fewer columns."""
    names = {t: i for i, t in enumerate(dict.fromkeys(a + b))}
    y, gap, at = np.array([names[t] for t in b], np.int64), -_SCORE - _COLUMN, np.arange(len(b) + 1)
    rows = np.empty((len(a) + 1, len(b) + 1), np.int64)
    rows[0] = at * gap
    for i, t in enumerate(a, 1):
        step = np.where(y == names[t], _SCORE + _MATCH - _COLUMN, -_SCORE - _COLUMN)
        best = rows[i - 1] + gap
        best[1:] = np.maximum(best[1:], rows[i - 1, :-1] + step)
        rows[i] = np.maximum.accumulate(best - at * gap) + at * gap
    return rows


def global_identity(a: str | None, b: str | None) -> float | None:
    """Equal tokens over columns of the best global alignment (+1, -1, -1; ties: more matches, then
    fewer columns)."""
    if a is None or b is None:
        return None
    x, y = _TOKENS.findall(a), _TOKENS.findall(b)
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    code = int(_table(x, y)[-1, -1])
    rest = code - (code + _MATCH) // _SCORE * _SCORE
    matches = -(-rest // _MATCH)
    return matches / (matches * _MATCH - rest)


def aligned_residues(a: str, b: str) -> list[tuple[int, int]]:
    """Indexes of residues that stand in one column; diagonals first, then gaps in b."""
    x, y = _TOKENS.findall(a), _TOKENS.findall(b)
    rows, i, j, out = _table(x, y), len(x), len(y), []
    while i and j:
        step = _SCORE + _MATCH - _COLUMN if x[i - 1] == y[j - 1] else -_SCORE - _COLUMN
        if rows[i, j] == rows[i - 1, j - 1] + step:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i, j] == rows[i - 1, j] - _SCORE - _COLUMN:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def pair_identity(pairs: DataFrame, a: str, b: str, name: str = "identity") -> DataFrame:
    """pairs plus the global identity. Equal sequences are settled in SQL; each other distinct pair is
    aligned once."""
    @F.pandas_udf("double")
    def align(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([global_identity(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    todo = pairs.filter(F.col(a) != F.col(b)).select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct().withColumn("__id", align("__a", "__b"))
    met = pairs.join(todo, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")), "left")
    return met.withColumn(name, F.when(F.col(a) == F.col(b), 1.0).otherwise(F.col("__id"))).drop("__a", "__b", "__id")

