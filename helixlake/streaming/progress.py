"""Job events as streams, with batch twins: exactly one row per task, live progress, liveness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.operators.ranking import first_by

PIECE_ROWS = 100_000


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = 64) -> DataFrame:
    """With None all files that are there make one batch: for backfills by watermark, as files
    needn't be in the order of event times and what a later batch brings would count as late."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def still_open(twin: DataFrame, events: DataFrame, ts: str, end, late_seconds: int) -> DataFrame:
    """The rows of a batch twin whose end the watermark over all these events has not passed."""
    mark = events.agg((F.unix_millis(F.max(ts)) - 1000 * late_seconds).alias("__mark"))
    return twin.join(F.broadcast(mark), F.unix_micros(end) > 1000 * F.col("__mark")).drop("__mark")


def first_seen(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """A stream with the first event of each key; the state goes with the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def last_wins(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last event of each key (batch)."""
    return first_by(events, [key], F.desc(ts), F.desc(tie))


def windowed_counts(events: DataFrame, ts: str, state: str, width: str = "1 minute", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events by window and state; with `late` on a stream."""
    timed = events.withWatermark(ts, late) if late else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed.groupBy(w.alias("w"), F.col(state)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), state, "n")


def progress(events: DataFrame, total: int, ts: str, done) -> DataFrame:
    """Done, remaining, rate per minute and minutes left."""
    n = F.count_if(done)
    minutes = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 60e6
    got = events.agg(n.alias("done"), (F.lit(total) - n).alias("remaining"), F.when(minutes > 0, n / minutes).alias("rate"))
    return got.withColumn("minutes_left", F.when(F.col("rate") > 0, F.col("remaining") / F.col("rate")))


def liveness(events: DataFrame, worker: str, ts: str, state: str, now, stale_seconds: int = 120) -> DataFrame:
    """Batch: each worker is COMPLETE or FAILED by its last event, else STALE or FRESH by its age."""
    last = events.groupBy(worker).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(state).alias("s"))).alias("m"))
    age = (F.unix_micros(now) - F.unix_micros("m.t")) / 1e6
    status = F.when(F.lower("m.s") == "complete", "COMPLETE").when(F.lower("m.s") == "failed", "FAILED").when(age > stale_seconds, "STALE").otherwise("FRESH")
    return last.select(worker, F.col("m.t").alias("last_seen"), status.alias("status"))


def last_of_pieces(events: DataFrame, worker: str, ts: str, state: str) -> DataFrame:
    """(worker, ts, state) of a worker's last event in each piece of a partition of about PIECE_ROWS events."""
    rows = events.select(worker, ts, state)

    def last(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.Table.from_batches(batches).combine_chunks()
        key = piece[0].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        time = piece[1].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.lexsort((time, key))
        yield from piece.take(pa.array(order[np.append(key[order][1:] != key[order][:-1], True)])).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= PIECE_ROWS:
                yield from last(held)
                held, n = [], 0
        if n:
            yield from last(held)

    return rows.mapInArrow(run, rows.schema)


def live_status(events: DataFrame, worker: str, ts: str, state: str, stale_seconds: int = 120, late: str | None = None) -> DataFrame:
    """Stream: a worker's status when it reports, and STALE once it hasn't for so long (event time). Of a
    piece of a batch only each worker's last event is shuffled: it alone can be the last of the batch."""
    out = "worker string, last_seen timestamp, status string"

    def update(key, frames: Iterator[pd.DataFrame], state_) -> Iterator[pd.DataFrame]:
        if state_.hasTimedOut:
            seen, status = state_.get
            state_.remove()
            if status == "FRESH":
                yield pd.DataFrame({"worker": [str(key[0])], "last_seen": [pd.Timestamp(seen, unit="us")], "status": ["STALE"]})
            return
        seen, status = state_.get if state_.exists else (0, "FRESH")
        for f in frames:
            for t, s in zip(f[ts], f[state], strict=True):
                us = int(pd.Timestamp(t).value // 1000)
                if us >= seen:
                    seen, status = us, {"complete": "COMPLETE", "failed": "FAILED"}.get(str(s).lower(), "FRESH")
        state_.update((seen, status))
        state_.setTimeoutTimestamp(max(seen // 1000 + stale_seconds * 1000, state_.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"worker": [str(key[0])], "last_seen": [pd.Timestamp(seen, unit="us")], "status": [status]})

    return last_of_pieces(events, worker, ts, state).withWatermark(ts, late or f"{stale_seconds} seconds").groupBy(worker).applyInPandasWithState(update, out, "seen long, status string", "append", "EventTimeTimeout")


def resume(manifest: DataFrame, results: DataFrame, keys: list[str], valid) -> DataFrame:
    """Tasks without a valid result."""
    return manifest.join(results.filter(valid).select(*keys), keys, "left_anti")


def sessions(events: DataFrame, worker: str, ts: str, gap: str = "120 seconds", late: str | None = None) -> DataFrame:
    """Sessions of activity: a gap without events ends one."""
    timed = events.withWatermark(ts, late) if late else events
    return timed.groupBy(worker, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(worker, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
