"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a session in one process gets a
    folder of its own (tests); a cluster has to name one. Whoever runs the job clears it."""
    folder, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder and not (app.master == "local" or app.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not folder and app.applicationId not in _LOCAL:
        _LOCAL[app.applicationId] = "file://" + tempfile.mkdtemp(prefix="helixlake-")
    return (folder or _LOCAL[app.applicationId]).rstrip("/")


def write_shared(df: DataFrame, label: str, *, group_rows: int | None = None) -> DataFrame:
    """df written as a table and read back, which ends its lineage. Writers and readers hold a whole row
    group, so rows of megabytes go into groups of group_rows."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    options = {} if group_rows is None else {"parquet.block.row.count.limit": group_rows}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables under a path whose write has ended."""
    at, files = _file_system(spark, path)
    if not files.exists(at):
        return []
    names = [x.getPath().getName() for x in files.listStatus(at) if x.isDirectory()]
    return sorted(n for n in names if files.exists(_file_system(spark, f"{path}/{n}/_SUCCESS")[0]))


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that was written."""
    at, files = _file_system(spark, path)
    files.delete(at, True)
