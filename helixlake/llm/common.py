"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.sources.shared import shared_folder, write_shared

__all__ = ["batches_of", "bounded", "mix64", "replacing", "shared_folder", "shielded", "table", "unused", "without_keys", "write_shared"]

BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replacing(df: DataFrame, **columns) -> DataFrame:
    """df plus the named columns; columns of df with these names (in any case) give way."""
    taken = {c.lower() for c in columns}
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what is written goes through Python by so many rows at once; for rows of megabytes, of which
    a batch would else hold all of a split."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shielded(operator: Callable) -> Callable:
    """An operator on a frame whose inner columns, named with two underscores before or after, can't meet
    the frame's own: such ones, and arguments that name them, have other names while it runs."""

    @wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        away: dict[str, str] = {}
        for c in df.columns:
            if c.startswith("__") or c.endswith("__"):
                away[c] = unused(df, f"apart_{len(away)}")
        if not away:
            return operator(df, *args, **options)
        named = lambda v: away.get(v, v) if isinstance(v, str) else v
        out = operator(df.withColumnsRenamed(away), *map(named, args), **{k: v if k.startswith("item_") else named(v) for k, v in options.items()})
        return out.withColumnsRenamed({a: c for c, a in away.items() if a in out.columns})

    return run


def bounded(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows, spelled out, have BROADCAST_BYTES at most, so
    that what it is joined to stays where it is; a larger one is joined as Spark sees fit."""
    size = rows.agg(F.sum(16 + F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def without_keys(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is one of gone's."""
    return docs.join(bounded(write_shared(gone.select(key).distinct(), "gone")), key, "left_anti")


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of uint64."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
