"""Sinks: delimited reports, sequence files, nested mask documents, event logs, sets of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.operators.joins import assert_unique


def report_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in that order as text, nulls as ''."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def write_report(df: DataFrame, path: str, columns: Sequence[str], sep: str = "\t") -> None:
    report_rows(df, columns).write.mode("overwrite").option("sep", sep).option("header", True).option("emptyValue", "").csv(path)


def fasta_rows(df: DataFrame, entry: str, entity: str, sequence: str) -> DataFrame:
    """Records `>ENTRY__ENTITY` with an entity part of letters, digits, dots, dashes and underscores;
    their names have to be unique."""
    name = F.concat_ws("__", F.col(entry), F.regexp_replace(entity, r"[^A-Za-z0-9._-]", "_"))
    return df.select(name.alias("record"), F.concat(F.lit(">"), name, F.lit("\n"), F.col(sequence)).alias("value"))


def write_fasta(df: DataFrame, path: str, entry: str, entity: str, sequence: str) -> None:
    assert_unique(fasta_rows(df, entry, entity, sequence), "record").select("value").write.mode("overwrite").text(path)


def mask_documents(chains: DataFrame, entry: str, chain: str, status: str) -> DataFrame:
    """(entry, mask): a JSON object of each entry's chains and their status, by chain."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(chain), F.col(status))))
    return chains.groupBy(entry).agg(F.to_json(F.map_from_entries(pairs)).alias("mask"))


def append_events(df: DataFrame, path: str) -> None:
    """One JSON object a line, added to what is there."""
    df.write.mode("append").json(path)


def write_tables(path: str, **tables: DataFrame) -> None:
    """A report of several sheets: a folder of Parquet for each name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_by(df: DataFrame, path: str, column: str) -> None:
    """One output for each value of the column (its few known values)."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)
