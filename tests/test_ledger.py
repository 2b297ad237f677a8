"""Tables kept by streams, over many batches, a restart and batches that run twice."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from helixlake.sources.shared import finished
from helixlake.streaming import ledger
from helixlake.streaming import progress as P

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, worker string, state string"


def made(n, seed=1):
    rng = random.Random(seed)
    return [(i, None if i % 97 == 5 else BASE + dt.timedelta(seconds=rng.randrange(20_000)), None if i % 31 == 0 else f"w{rng.randrange(12)}", rng.choice(["run", "failed", "complete"])) for i in range(n)]


def write(spark, rows, path, files):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(path)


def test_last_of_each_key_over_many_batches(spark, tmp_path):
    at, rows = str(tmp_path), made(600)
    stream = lambda: P.read_stream(spark, f"{at}/in", SCHEMA, files_per_trigger=1)
    run = lambda: ledger.merge_last(stream(), f"{at}/last", f"{at}/state", "worker", "ts", "id", compact_every=5).awaitTermination()
    got = lambda: sorted(map(str, ledger.read_last(spark, f"{at}/last", SCHEMA, "worker", "ts", "id").collect()))
    want = lambda some: sorted(map(str, P.last_wins(spark.createDataFrame(some, SCHEMA), "worker", "ts", "id").collect()))
    assert got() == []
    write(spark, rows[:300], f"{at}/in", 12)
    run()
    assert got() == want(rows[:300])
    write(spark, rows[300:], f"{at}/in", 13)
    run()  # a restart from the checkpoint
    assert got() == want(rows)
    names = finished(spark, f"{at}/last")
    assert sum(n.startswith("whole") for n in names) <= 2 and len(names) <= 2 + 2 * 5
    # each whole table has a row for each key
    assert spark.read.parquet(f"{at}/last/{[n for n in names if n.startswith('whole')][-1]}").count() == len({r[2] for r in rows})


def test_a_batch_that_ends_halfway_is_not_read(spark, tmp_path):
    at, rows = str(tmp_path), made(50)
    write(spark, rows, f"{at}/in", 2)
    ledger.merge_last(P.read_stream(spark, f"{at}/in", SCHEMA), f"{at}/last", f"{at}/state", "worker", "ts", "id").awaitTermination()
    spark.createDataFrame([(10**6, BASE + dt.timedelta(days=9), "w1", "no")], SCHEMA).write.parquet(f"{at}/last/whole-000000009")
    os.remove(f"{at}/last/whole-000000009/_SUCCESS")
    assert all(r.state != "no" for r in ledger.read_last(spark, f"{at}/last", SCHEMA, "worker", "ts", "id").collect())


def counted(spark, at):
    out = {}
    for r in ledger.read_windows(spark, at).collect():
        out[r.window_start, r.state] = out.get((r.window_start, r.state), 0) + r.n
    return out


def test_windows_and_late_rows_are_all_events(spark, tmp_path):
    """Many batches out of order, a restart, sliding windows: nothing is lost, nothing counted twice."""
    rows = made(400, 2)
    for slide in (None, "5 minutes"):
        at = f"{tmp_path}/{slide and slide[0]}"
        run = lambda: ledger.count_windows(P.read_stream(spark, f"{at}/in", SCHEMA, files_per_trigger=1), f"{at}/out", f"{at}/state", "ts", "state", width="10 minutes", slide=slide, late_seconds=3_000).awaitTermination()  # noqa: B023, E731
        write(spark, rows[:200], f"{at}/in", 5)
        run()
        write(spark, rows[200:], f"{at}/in", 4)
        run()
        late = ledger.read_late(spark, f"{at}/out")
        met = counted(spark, f"{at}/out")
        on_time = dict(met)
        for r in late.collect():
            met[r.window_start, r.state] = met.get((r.window_start, r.state), 0) + 1
        every = spark.createDataFrame(rows, SCHEMA)
        w = F.window("ts", "10 minutes", slide) if slide else F.window("ts", "10 minutes")
        want = {(r.s, r.state): r.n for r in every.groupBy(w.alias("w"), "state").agg(F.count("*").alias("n")).select(F.col("w.start").alias("s"), "state", "n").collect()}
        no_time = {s: n for (t, s), n in met.items() if t is None}
        assert {k: n for k, n in met.items() if k[0] is not None} == want and sum(no_time.values()) == sum(r[1] is None for r in rows)
        mark = ledger.read_mark(spark, f"{at}/out")
        assert mark.n_rows == len(rows) and mark.n_late == late.count() > sum(no_time.values()) and sum(on_time.values()) > 100
        names = finished(spark, f"{at}/out")
        assert sum(n.startswith("open") for n in names) <= 2 and sum(n.startswith("mark") for n in names) <= 2
