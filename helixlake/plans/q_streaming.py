"""Streams over the events table, and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixlake.operators import stats
from helixlake.sources.shared import shared_folder
from helixlake.streaming import ledger
from helixlake.streaming import progress as P

from .registry import query, table

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _events(spark, d):
    """Times are those of the session's zone while they are worked on."""
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, d, files_per_trigger=64):
    return P.read_stream(spark, f"{d}/events.parquet*", table(spark, d, "events").schema, files_per_trigger=files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(df, spark, name):
    """Run a stream over what is there and read its output."""
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return _plain(spark.read.schema(df.schema).parquet(f"{root}/out"))


def _plain(df):
    """Times as the tables have them, without a zone."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("SELECT user_id % 20 AS task, max_by(event_type, (ts, event_id)) AS state, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def last_event_wins(spark, d):
    e = _events(spark, d).withColumn("task", F.col("user_id") % 20)
    return P.last_wins(e, "task", "ts", "event_id").select("task", F.col("event_type").alias("state"), "event_id")


@query("SELECT user_id % 20 AS task, max_by(event_type, (ts, event_id)) AS state, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_last_event_wins(spark, d):
    root = f"{shared_folder(spark)}/last-{uuid.uuid4().hex}"
    e = _stream(spark, d).withColumn("task", F.col("user_id") % 20)
    ledger.merge_last(e, root, f"{root}-state", "task", "ts", "event_id").awaitTermination()
    return ledger.read_last(spark, root, e.schema, "task", "ts", "event_id").select("task", F.col("event_type").alias("state"), "event_id")


@query("SELECT DISTINCT event_id // 3 AS task FROM events")
def stream_first_seen(spark, d):
    e = _stream(spark, d).withColumn("task", F.floor(F.col("event_id") / 3))
    return _drain(P.first_seen(e, "task", "ts", "40 days").select("task"), spark, "first")


_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query(_WINDOWS)
def windowed_progress(spark, d):
    return _plain(P.windowed_counts(_events(spark, d), "ts", "event_type", "1 hour"))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS window_start, event_type, count(*) AS n FROM events, range(2) t(k) GROUP BY 1, 2")
def sliding_progress(spark, d):
    return _plain(P.windowed_counts(_events(spark, d), "ts", "event_type", "1 hour", "30 minutes"))


@query(_WINDOWS)
def stream_windowed_progress(spark, d):
    """Windows that the watermark has closed, and from the batch twin those that are still open."""
    closed = _drain(P.windowed_counts(_stream(spark, d, None), "ts", "event_type", "1 hour", late="10 minutes"), spark, "windows")
    e = _events(spark, d)
    twin = P.windowed_counts(e, "ts", "event_type", "1 hour")
    return closed.unionByName(_plain(P.still_open(twin, e, "ts", F.col("window_start") + F.expr("INTERVAL 1 HOUR"), 600)))


@query(_WINDOWS)
def stream_windows_and_late(spark, d):
    """Eight batches in no order of time: what windows count and what came late are all events."""
    root = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    _events(spark, d).repartition(8, "event_id").write.parquet(f"{root}/in")
    e = P.read_stream(spark, f"{root}/in", _events(spark, d).schema, files_per_trigger=1)
    ledger.count_windows(e, f"{root}/out", f"{root}/state", "ts", "event_type", width="1 hour", late_seconds=5 * 86_400).awaitTermination()
    rows, late = ledger.read_windows(spark, f"{root}/out"), ledger.read_late(spark, f"{root}/out")
    rows = rows.select("window_start", "event_type", "n")
    if late is not None:
        rows = rows.unionByName(late.groupBy("window_start", "event_type").agg(F.count(F.lit(1)).alias("n")))
    return _plain(rows.groupBy("window_start", "event_type").agg(F.sum("n").alias("n")))


@query("""
SELECT count(*) FILTER (event_type <> 'error') AS done, (20000 - count(*) FILTER (event_type <> 'error')) AS remaining, round(count(*) FILTER (event_type <> 'error') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6), 6) AS rate,
  round((20000 - count(*) FILTER (event_type <> 'error')) / (count(*) FILTER (event_type <> 'error') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6)), 4) AS minutes_left FROM events""")
def progress(spark, d):
    got = P.progress(_events(spark, d), 20_000, "ts", F.col("event_type") != "error")
    return got.select("done", "remaining", F.round("rate", 6).alias("rate"), F.round("minutes_left", 4).alias("minutes_left"))


@query(f"""
WITH l AS (SELECT user_id, max(ts) AS last_seen, max_by(event_type, (ts, event_type)) AS s FROM events GROUP BY 1)
SELECT user_id, last_seen, CASE WHEN s = 'purchase' THEN 'COMPLETE' WHEN s = 'error' THEN 'FAILED' WHEN epoch_us({NOW}) - epoch_us(last_seen) > 36000 * 1e6 THEN 'STALE' ELSE 'FRESH' END AS status FROM l""")
def worker_liveness(spark, d):
    e = _events(spark, d).withColumn("event_type", F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")))
    return _plain(P.liveness(e, "user_id", "ts", "event_type", F.expr(NOW), 36_000))


@query("WITH l AS (SELECT user_id::VARCHAR AS worker, max(ts) AS last_seen FROM events GROUP BY 1) SELECT worker, last_seen, 'FRESH' AS status FROM l UNION ALL SELECT worker, last_seen, 'STALE' FROM l WHERE last_seen < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_liveness(spark, d):
    """Each worker's status by its last event, and STALE too if that is an hour before the last of all."""
    e = _stream(spark, d, None).select(F.col("user_id").cast("string").alias("worker"), "ts", "event_type")
    return _drain(P.live_status(e, "worker", "ts", "event_type", 3600, late="0 seconds"), spark, "live")


_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k"""


@query(_SESSIONS)
def worker_sessions(spark, d):
    return _plain(P.sessions(_events(spark, d), "user_id", "ts", "6 hours"))


@query(_SESSIONS)
def stream_sessions(spark, d):
    """Sessions that the watermark has closed, and from the batch twin those that are still open."""
    closed = _drain(P.sessions(_stream(spark, d, None), "user_id", "ts", "6 hours", late="1 hour"), spark, "sessions")
    e = _events(spark, d)
    return closed.unionByName(_plain(P.still_open(P.sessions(e, "user_id", "ts", "6 hours"), e, "ts", F.col("session_end"), 3600)))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)")
def resume_tasks(spark, d):
    e = _events(spark, d)
    return P.resume(e.select("user_id").distinct(), e, ["user_id"], (F.col("event_type") == "purchase") & (F.col("value") > 150))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, d):
    return stats.value_counts(_events(spark, d), "event_type")
