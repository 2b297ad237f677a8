"""Tables that a stream keeps: the last event of each key, and counts by window with all late rows.

Both are folders of numbered tables; a number is that of the batch that wrote it, so a batch that runs
again after a failure writes the same tables again. What newer tables replace is deleted, but for
one generation that readers may still be at. No state is held outside of these tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixlake.sources.shared import drop, finished
from helixlake.streaming.progress import last_wins

COMPACT_EVERY = 16


def _numbered(names: list[str], kind: str) -> dict[int, str]:
    return {int(n.rpartition("-")[2]): n for n in names if n.startswith(f"{kind}-")}


def _start(events: DataFrame, batch, checkpoint: str) -> StreamingQuery:
    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_last(events: DataFrame, path: str, checkpoint: str, key: str, ts: str, tie: str, *, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep the last event of each key, by ts and then by tie. A batch writes the last events of its own keys;
    every so many batches these and the table before become one table with a row for each key. So
    there are never more than two such tables and twice compact_every batches. Null keys are a key."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last_wins(batch, key, ts, tie).write.mode("overwrite").parquet(f"{path}/batch-{number:09}")
        names = finished(spark, path)
        whole, parts = _numbered(names, "whole"), _numbered(names, "batch")
        if (number + 1) % compact_every or number in whole:
            return
        read_last(spark, path, events.schema, key, ts, tie).write.mode("overwrite").parquet(f"{path}/whole-{number:09}")
        kept = max(whole, default=-1)  # the generation before
        for n, name in [*whole.items(), *parts.items()]:
            if n < kept or n == kept and name in parts.values():
                drop(spark, f"{path}/{name}")

    return _start(events, merge, checkpoint)


def read_last(spark: SparkSession, path: str, schema, key: str, ts: str, tie: str) -> DataFrame:
    """The last event of each key: the newest whole table and the batches after it."""
    names = finished(spark, path)
    whole = _numbered(names, "whole")
    newest = max(whole, default=-1)
    found = [*([whole[newest]] if whole else []), *(name for n, name in _numbered(names, "batch").items() if n > newest)]
    rows = spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in found]) if found else spark.createDataFrame([], schema)
    return last_wins(rows, key, ts, tie)


def count_windows(events: DataFrame, path: str, checkpoint: str, ts: str, state: str, *, width: str = "1 minute", slide: str | None = None, late_seconds: int = 600) -> StreamingQuery:
    """Count events by window and state, and keep what comes too late. The mark is the latest time of all batches
    before, less late_seconds; a window that ends at or before it is closed. A row is counted in its open
    windows; in its closed ones it's late, and is kept with the window's start. So windows and late rows
    together are all events, in whatever order and batches they come. Rows without a time are late, of
    no window.

    `open-n` are the windows that batch n leaves open, `mark-n` is the mark that it leaves, with the numbers of
    rows and of late rows so far; `closed-n` and `late-n` are there only if it had any."""

    def count(batch: DataFrame, number: int) -> None:
        spark, names = batch.sparkSession, finished(batch.sparkSession, path)
        marks, opens = ({n: v for n, v in _numbered(names, k).items() if n < number} for k in ("mark", "open"))
        old = spark.read.parquet(f"{path}/{marks[max(marks)]}").first() if marks else {"mark": None, "n_rows": 0, "n_late": 0}
        window = F.window(ts, width, slide) if slide else F.window(ts, width)
        rows = batch.withColumn("w", window).unionByName(batch.filter(F.col(ts).isNull()).withColumn("w", F.lit(None).cast("struct<start:timestamp,end:timestamp>")))
        rows = rows.withColumn("late", F.col("w").isNull() | F.coalesce(F.unix_micros("w.end") <= F.lit(old["mark"]).cast("long"), F.lit(False))).persist()
        try:
            late = rows.filter("late").withColumn("window_start", F.col("w.start")).drop("w", "late")
            n_late, latest = rows.agg(F.count_if("late"), F.unix_micros(F.max(ts))).first()
            mark = max((m for m in (old["mark"], None if latest is None else latest - late_seconds * 1_000_000) if m is not None), default=None)
            counts = rows.filter("NOT late").groupBy(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), state).agg(F.count(F.lit(1)).alias("n"))
            if opens:
                counts = counts.unionByName(spark.read.schema(counts.schema).parquet(f"{path}/{opens[max(opens)]}")).groupBy("window_start", "window_end", state).agg(F.sum("n").alias("n"))
            ended = F.coalesce(F.unix_micros("window_end") <= F.lit(mark).cast("long"), F.lit(False))
            closed = counts.filter(ended)
            counts.filter(~ended).write.mode("overwrite").parquet(f"{path}/open-{number:09}")
            if not closed.isEmpty():
                closed.write.mode("overwrite").parquet(f"{path}/closed-{number:09}")
            if n_late:
                late.write.mode("overwrite").parquet(f"{path}/late-{number:09}")
            done = spark.createDataFrame([(mark, old["n_rows"] + batch.count(), old["n_late"] + n_late)], "mark long, n_rows long, n_late long")
            done.coalesce(1).write.mode("overwrite").parquet(f"{path}/mark-{number:09}")
        finally:
            rows.unpersist()
        for kind in (marks, opens):
            for n in sorted(kind)[:-1]:
                drop(spark, f"{path}/{kind[n]}")

    return _start(events, count, checkpoint)


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame | None:
    return spark.read.parquet(*[f"{path}/{n}" for n in names]) if names else None


def read_windows(spark: SparkSession, path: str) -> DataFrame | None:
    """(window_start, window_end, state, n) of all windows, closed and open, as of the last batch that ended."""
    names = finished(spark, path)
    marks, opens = _numbered(names, "mark"), _numbered(names, "open")
    last = max(marks, default=-1)
    return _read(spark, path, [*(v for n, v in _numbered(names, "closed").items() if n <= last), *(v for n, v in opens.items() if n == last)])


def read_late(spark: SparkSession, path: str) -> DataFrame | None:
    """Late rows, with the start of the window that they missed; None if there are none."""
    names = finished(spark, path)
    last = max(_numbered(names, "mark"), default=-1)
    return _read(spark, path, [v for n, v in _numbered(names, "late").items() if n <= last])


def read_mark(spark: SparkSession, path: str):
    """The row (mark, n_rows, n_late) that the last batch left."""
    marks = _numbered(finished(spark, path), "mark")
    return spark.read.parquet(f"{path}/{marks[max(marks)]}").first() if marks else None
