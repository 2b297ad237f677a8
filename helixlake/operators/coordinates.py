"""Coordinates: errors before and after superposition, displacement, radius graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

XYZ, CELL_ATOMS = ("x", "y", "z"), 1_000
#: Samples of so many atoms at most are one cell.
SAMPLE_ATOMS = 64
_FIT = "struct<rmsd:double,rotation:array<double>>"


def rmsd(pairs: DataFrame, sample: str) -> DataFrame:
    """Root mean square distance of x, y, z and x_pred, y_pred, z_pred, as they are."""
    d2 = sum((F.col(c) - F.col(f"{c}_pred")) ** 2 for c in XYZ)
    return pairs.groupBy(sample).agg(F.count(F.lit(1)).alias("num_atoms"), F.sqrt(F.avg(d2)).alias("rmsd"))


def _fit(cov: pd.Series, spread: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The proper rotation of least error from covariances (predicted by true) of centred points."""
    h = np.array(cov.tolist(), float).reshape(-1, 3, 3)
    u, s, vt = np.linalg.svd(h)
    sign = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
    turn = np.broadcast_to(np.eye(3), h.shape).copy()
    turn[:, 2, 2] = sign
    rotation = vt.transpose(0, 2, 1) @ turn @ u.transpose(0, 2, 1)
    error = np.sqrt(np.maximum(0.0, spread.to_numpy() - 2 * (s[:, 0] + s[:, 1] + sign * s[:, 2])))
    few = n.to_numpy() < 3
    return pd.DataFrame({"rmsd": [None if f else float(e) for e, f in zip(error, few, strict=True)], "rotation": [None if f else r.ravel().tolist() for r, f in zip(rotation, few, strict=True)]})


def superposition(pairs: DataFrame, sample: str) -> DataFrame:
    """Per sample the least RMSD over proper rigid motions of the predicted points, the rotation (row
    by row) and both centres; null for under three atoms. The sums are partial aggregates, so
    what a step of linear algebra gets is one row for each sample."""
    fit = F.pandas_udf(_fit, _FIT)
    cov = F.array(*[F.coalesce(F.covar_pop(f"{p}_pred", q), F.lit(0.0)) for p in XYZ for q in XYZ])
    spread = sum(F.coalesce(F.var_pop(c), F.lit(0.0)) + F.coalesce(F.var_pop(f"{c}_pred"), F.lit(0.0)) for c in XYZ)
    got = pairs.groupBy(sample).agg(F.count(F.lit(1)).alias("num_atoms"), cov.alias("cov"), spread.alias("spread"), F.array(*[F.avg(c) for c in XYZ]).alias("centre"), F.array(*[F.avg(f"{c}_pred") for c in XYZ]).alias("centre_pred"))
    return got.withColumn("fit", fit("cov", "spread", "num_atoms")).select(sample, "num_atoms", "fit.rmsd", "fit.rotation", "centre", "centre_pred")


def superpose(pairs: DataFrame, sample: str) -> DataFrame:
    """pairs with the predicted points moved onto the true ones; samples of under three atoms go."""
    fits = superposition(pairs, sample).filter(F.col("rotation").isNotNull()).drop("num_atoms", "rmsd")
    met = pairs.join(fits, sample)
    off = [F.col(f"{c}_pred") - F.col("centre_pred")[i] for i, c in enumerate(XYZ)]
    moved = {f"{c}_pred": sum(F.col("rotation")[3 * i + j] * off[j] for j in range(3)) + F.col("centre")[i] for i, c in enumerate(XYZ)}
    return met.withColumns(moved).drop("rotation", "centre", "centre_pred")


def centre(atoms: DataFrame, sample: str) -> DataFrame:
    """atoms with their sample's mean position taken off."""
    w = Window.partitionBy(sample)
    return atoms.withColumns({c: F.col(c) - F.avg(c).over(w) for c in XYZ})


def displacement(pairs: DataFrame, sample: str) -> DataFrame:
    """Squared, absolute and Euclidean displacement: the mean of each sample, then over samples."""
    d = [F.col(c) - F.col(f"{c}_pred") for c in XYZ]
    sq = sum(x * x for x in d)
    per = pairs.groupBy(sample).agg(F.avg(sq).alias("sq"), F.avg(sum(F.abs(x) for x in d)).alias("l1"), F.avg(F.sqrt(sq)).alias("l2"))
    return per.agg(F.count(F.lit(1)).alias("n_samples"), F.avg("sq").alias("mean_squared"), F.avg("l1").alias("mean_l1"), F.avg("l2").alias("mean_l2"))


def gridded(atoms: DataFrame, sample: str, atom: str, radius: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Atoms at home in the cells of a grid whose edge is the radius, the same atoms as guests of the cells
    around, and the columns that both are to meet on. Of two cells that touch only one has the other's
    atoms as guests. A cell of more than CELL_ATOMS atoms is dealt out to parts, each with all guests. A
    sample of SAMPLE_ATOMS atoms at most is one cell, without cells around: its atoms go out once, not 14 times."""
    small = F.coalesce(F.col("atoms") <= SAMPLE_ATOMS, F.lit(False))
    cell = {f"c{c}": F.when(small, F.lit(0)).otherwise(F.floor(F.col(c) / radius)).cast("long") for c in XYZ}
    home = atoms.select(F.col(sample).alias("sample"), F.col(atom).alias("src"), *XYZ)
    home = home.join(home.groupBy("sample").agg(F.count(F.lit(1)).alias("atoms")), "sample", "left").withColumns({**cell, "small": small}).drop("atoms")
    dense = home.groupBy("sample", *cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL_ATOMS).withColumn("parts", F.ceil(F.col("n") / CELL_ATOMS).cast("int")).drop("n")
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]
    around = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(cell, s, strict=True)]) for s in steps])
    step = F.explode(F.when(F.col("small"), F.slice(around, steps.index((0, 0, 0)) + 1, 1)).otherwise(around))
    away = home.withColumnsRenamed({"src": "dst"} | {c: f"{c}2" for c in XYZ}).withColumn("step", step)
    away = away.withColumn("inside", F.expr("step = struct(0L AS cx, 0L AS cy, 0L AS cz)")).withColumns({c: F.col(c) + F.col(f"step.{c}") for c in cell}).drop("step", "small")
    home = home.drop("small")
    keys = ["sample", *cell]
    home = home.join(dense, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("src", *XYZ), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    away = away.join(dense, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return home, away, [*keys, "part"]


def radius_graph(atoms: DataFrame, sample: str, atom: str, radius: float) -> DataFrame:
    """(sample, src, dst): ordered pairs of different atoms of a sample nearer than the radius. Atoms
    meet only in neighbouring cells of a grid of that edge, each pair once. Atoms without a place
    have no neighbours."""
    home, away, keys = gridded(atoms.dropna(subset=list(XYZ)), sample, atom, radius)
    met = home.join(away, keys).filter(F.when(F.col("inside"), F.col("src") < F.col("dst")).otherwise(F.col("src") != F.col("dst")))
    met = met.filter(sum((F.col(c) - F.col(f"{c}2")) ** 2 for c in XYZ) < radius * radius)
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return met.select(F.col("sample").alias(sample), both.alias("e")).select(sample, "e.src", "e.dst")


def _added(keys: list[pa.Array], sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first row of each distinct key, and the sums of vectors and counts over its rows."""
    code = np.zeros(len(counts), np.int64)
    for k in keys:
        number = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code * (number.max(initial=0) + 1) + number, return_inverse=True)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order[starts], np.add.reduceat(sums[order], starts, axis=0) if len(starts) else sums[:0], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def _vectors(flat: pa.Array, n: int) -> np.ndarray:
    """Numbers of n vectors, a row each; null is no number."""
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if n and len(values) % n:
        raise ValueError("vectors of unlike lengths")
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def window_mean(windows: DataFrame, key: str, start: str, vectors: str) -> DataFrame:
    """(key, place, mean, coverage) of windows (key, start, array of vectors): per place the mean vector over
    all windows that cover it, and how many do. Vectors have one length, else it's an error; null ones
    don't count, and a null number makes its mean NaN.

    Tasks add up whole vectors, first for each place of a batch, then for each place of a partition: a
    row is shuffled for each place of a batch, however long the vectors are."""
    kind = windows.schema[key].dataType.simpleString()
    schema = f"`key` {kind}, place bigint, sums array<double>, n bigint"

    def batch_of(keys: pa.Array, place: pa.Array, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
        return pa.record_batch({"key": keys, "place": place, "sums": lists, "n": counts})

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["vectors"]
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            inner = lists.flatten()
            owner, within = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            there = inner.is_valid().to_numpy(zero_copy_only=False)
            owner, within = owner[there], within[there]
            place = pa.array(batch["start"].to_numpy(zero_copy_only=False)[owner] + within, pa.int64())
            keys = batch["key"].take(pa.array(owner))
            first, sums, counts = _added([keys, place], _vectors(inner.flatten(), len(owner)), np.ones(len(owner), np.int64))
            if len(first):
                yield batch_of(keys.take(pa.array(first)), place.take(pa.array(first)), sums, counts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row = None  # the last place of a batch may go on in the next
        for batch in batches:
            table = pa.Table.from_batches([*([open_row] if open_row is not None else []), batch]).combine_chunks()
            cols = {c: table[c].chunk(0) for c in table.column_names}
            first, sums, counts = _added([cols["key"], cols["place"]], _vectors(cols["sums"].flatten(), table.num_rows), cols["n"].to_numpy())
            order = np.argsort(first)
            first = pa.array(first[order])
            out = batch_of(cols["key"].take(first), cols["place"].take(first), sums[order], counts[order])
            yield out.slice(0, out.num_rows - 1)
            open_row = out.slice(out.num_rows - 1)
        if open_row is not None:
            yield open_row

    rows = windows.filter(F.col(start).isNotNull()).select(F.col(key).alias("key"), F.col(start).cast("long").alias("start"), F.col(vectors).cast("array<array<double>>").alias("vectors"))
    sums = rows.mapInArrow(local, schema).repartition("key", "place").sortWithinPartitions("key", "place").mapInArrow(merged, schema)
    return sums.select(F.col("key").alias(key), "place", F.transform("sums", lambda x: x / F.col("n")).alias("mean"), F.col("n").alias("coverage"))


def index_integrity(stored: DataFrame, expected: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """How many rows differ from the expected in each column, and how many are on one side only."""
    left = stored.select(*keys, *[F.col(c).alias(f"{c}__s") for c in columns], F.lit(True).alias("__in_s"))
    right = expected.select(*keys, *[F.col(c).alias(f"{c}__e") for c in columns], F.lit(True).alias("__in_e"))
    met = left.join(right, keys, "full_outer")
    both = F.col("__in_s").isNotNull() & F.col("__in_e").isNotNull()
    return met.agg(F.count_if(both).alias("n_both"), F.count_if(F.col("__in_s").isNull()).alias("n_absent"), F.count_if(F.col("__in_e").isNull()).alias("n_unexpected"), *[F.count_if(both & ~F.col(f"{c}__s").eqNullSafe(F.col(f"{c}__e"))).alias(f"bad_{c}") for c in columns])


def observed_symbols(chains: DataFrame, sequence: str, tokens: DataFrame) -> DataFrame:
    """Letters of all sequences with their number, token and policy: those that tokens(letter, token)
    doesn't have are replaced by the unknown token."""
    seen = chains.select(F.explode(F.split(sequence, "")).alias("letter")).filter("letter <> ''").groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(tokens, "letter", "left").withColumn("policy", F.when(F.col("token").isNull(), "UNKNOWN_TOKEN").otherwise("NATIVE"))
