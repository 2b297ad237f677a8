"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are numbered in a fixed random order and cut into blocks. A source of weight w
has its i-th block released at floor((i - 1) / w) and due by ceil(i / w); earliest deadline first
then fills one slot after another, and after every slot each source has had its share of the
slots give or take less than one block. Weights are exact fractions and the driver schedules all
blocks, of which there are MOST_BLOCKS at most and one for each source: larger inputs have larger
blocks. With a `period` weights are rounded to whole shares of it instead, the schedule repeats,
and the driver makes one period only. When a source runs out, a new phase begins with the weights
of those that are left; sources of weight 0 come when no others are left.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, bounded, replacing, shielded, table, write_shared

BLOCK_ROWS, MOST_BLOCKS, TEMPERATURE, BUCKET_ROWS, SEED = 50, 1_000_000, 0.5, 20_000, 7


def shares(weights: list[float], period: int) -> list[int]:
    """Whole shares of the period in proportion to the weights, at least 1 each, by largest remainder."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many slots; it has {period}")
    total = sum(weights)
    exact = [w / total * (period - len(weights)) for w in weights]
    out = [int(x) + 1 for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (int(exact[i]) - exact[i], i))[: period - sum(out)]:
        out[i] += 1
    return out


def release(i: int, share: int, period: int) -> int:
    """When block i (from 0) may go: floor(i / w) for w = share / period."""
    return i * period // share


def deadline(i: int, share: int, period: int) -> int:
    """The slot before which block i must be done: ceil((i + 1) / w)."""
    return -(-(i + 1) * period // share)


def schedule(share: list[int], period: int) -> list[int]:
    """The source of each slot of a period, earliest deadline first among released blocks; of
    equal deadlines the source that comes first."""
    waiting = [(0, deadline(0, a, period), s, 0) for s, a in enumerate(share)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i))
        due, s, i = heapq.heappop(ready)
        assert due > slot, "whole shares of the period always have a feasible schedule"
        out.append(s)
        if i + 1 < share[s]:
            heapq.heappush(waiting, (release(i + 1, share[s], period), deadline(i + 1, share[s], period), s, i + 1))
    return out


def _live(left: list[int], weights: list) -> list[int]:
    """The sources of a phase: those with a weight that have blocks, or else all that have blocks."""
    some = [s for s in range(len(left)) if left[s]]
    return [s for s in some if weights[s]] or some


def phases(blocks: list[int], weights: list[float], period: int) -> list[dict]:
    """The phases of a mix of sources with so many blocks each. A phase ends before the first slot
    whose source has no block left; it lists its first slot and, by source, the blocks before it,
    the blocks it takes, the share, and the slots of one period."""
    left, done, start, out = list(blocks), [0] * len(blocks), 0, []
    while any(left):
        live = _live(left, weights)
        share = shares([weights[s] or 1 for s in live], period)
        plan = np.array(schedule(share, period))
        slots = {s: np.flatnonzero(plan == k).tolist() for k, s in enumerate(live)}
        ends = {s: left[s] // share[k] * period + slots[s][left[s] % share[k]] for k, s in enumerate(live)}
        end = min(ends.values())
        takes = {s: end // period * share[k] + int(np.searchsorted(slots[s], end % period)) for k, s in enumerate(live)}
        out.append({"start": start, "length": end, "sources": {s: {"before": done[s], "take": takes[s], "share": share[k], "slots": slots[s]} for k, s in enumerate(live)}})
        for s, n in takes.items():
            left[s] -= n
            done[s] += n
        start += end
    return out


def exact_schedule(blocks: list[int], weights: list[float]) -> dict[str, array]:
    """The blocks of all sources in the order of their slots: source, number of the block in its
    source, phase, and release and deadline in slots of the phase. Earliest deadline first by the
    exact weights, over as many slots as there are blocks; a phase ends where phases() says."""
    out = {c: array("q") for c in ("source", "block", "phase", "release", "deadline")}
    left, done, phase = list(blocks), [0] * len(blocks), 0
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * unit) for w in exact]
    while live := _live(left, exact):
        if not any(whole[s] for s in live):
            whole = [1] * len(whole)
        total = sum(whole[s] for s in live)
        ready = [(-(-total // whole[s]), s, 0) for s in live]
        heapq.heapify(ready)
        waiting: dict[int, list[int]] = {}  # the sources whose next block is released at a slot
        number = dict.fromkeys(live, 0)
        slot = 0
        while True:
            for s in waiting.pop(slot, ()):
                heapq.heappush(ready, (-(-(number[s] + 1) * total // whole[s]), s, number[s] * total // whole[s]))
            due, s, released = heapq.heappop(ready)
            if not left[s]:
                break
            for c, x in zip(out.values(), (s, done[s], phase, released, due), strict=True):
                c.append(x)
            left[s] -= 1
            done[s] += 1
            number[s] += 1
            slot += 1
            waiting.setdefault(max(slot, number[s] * total // whole[s]), []).append(s)
        phase += 1
    return out


@shielded
def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", *, weights: dict | None = None, temperature: float = TEMPERATURE, block_rows: int | None = None, period: int | None = None, seed: int = SEED) -> DataFrame:
    """docs plus mix_phase, mix_release and mix_deadline (of its block, in slots of the phase),
    mix_slot (over all phases), and mix_position, by which the mixed corpus is read.

    Every row is kept once. `weights` gives the target of each source (null is a source); those
    it leaves out, or all without it, get their number of blocks to the power `temperature`. A
    weight of 0 puts a source behind all others. At each slot of a phase a source is less than a
    block off its target. With a `period` that holds for weights rounded to shares of so many
    slots, at least one. A block has `block_rows` rows, by default BLOCK_ROWS or, beyond
    MOST_BLOCKS of these, as many more; only a source's last block is short. Within a source rows
    go by a seeded hash of the whole row, so that rows of one key don't meet in one task; equal rows
    do, and take any order among themselves. Input columns with these names are replaced. The
    driver holds a count for each source and the schedule, 40 bytes a block; with a `period` a count
    for each source, of which there can be `period`, and one period for each phase.
    """
    names = ("mix_phase", "mix_release", "mix_deadline", "mix_slot", "mix_position")
    rows = docs.count()
    buckets = max(64, -(-rows // BUCKET_ROWS))
    block_rows = block_rows or max(BLOCK_ROWS, -(-rows // MOST_BLOCKS))
    content = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema if f.name != key]
    order = F.xxhash64(F.lit(seed), F.col(key).cast("string"), *content)
    dealt = docs.withColumns({"__src": F.col(source).cast("string"), "__h": order}).withColumn("__b", F.floor((F.col("__h") / 2.0**64 + 0.5) * buckets).cast("int"))
    counts = write_shared(dealt.groupBy("__src", "__b").agg(F.count("*").alias("n")), "mix-counts")
    totals = sorted(((r["__src"] is not None, r["__src"] or "", r["n"]) for r in counts.groupBy("__src").agg(F.sum("n").alias("n")).limit(period + 1 if period else 2**31 - 1).collect()))
    labels = [s if known else None for known, s, _ in totals]
    blocks = [-(-n // block_rows) for *_, n in totals]
    target = [float((weights or {}).get(s, b**temperature)) for s, b in zip(labels, blocks, strict=True)]
    if any(w < 0 for w in target):
        raise ValueError("weights can't be below 0")
    before = F.sum("n").over(Window.partitionBy("__src").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("__src").alias("__src2"), F.col("__b").alias("__b2"), F.col("n").alias("__n"), F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__src", "__b").orderBy("__h", F.col(key))) - 1
    dealt = dealt.withColumn("__nth", nth)
    own = ["__src", "__h", "__b", "__nth", "__i", "__block", "__src2", "__b2", "__before"]
    if not period:
        return _exact(dealt, offsets, labels, blocks, target, block_rows, names, own)
    plan = phases(blocks, target, period)
    met = dealt.join(offsets, F.col("__src").eqNullSafe(F.col("__src2")) & (F.col("__b") == F.col("__b2")))
    met = met.withColumn("__i", F.col("__before") + F.col("__nth")).withColumn("__block", F.floor(F.col("__i") / block_rows))

    spark = docs.sparkSession
    table_rows = [(p, labels[s], x["before"], x["before"] + x["take"], ph["start"], x["share"], x["slots"]) for p, ph in enumerate(plan) for s, x in ph["sources"].items() if x["take"]]
    steps = spark.createDataFrame(table_rows, "p__ int, s__ string, lo__ long, hi__ long, start__ long, share__ long, slots__ array<int>")
    met = met.join(F.broadcast(steps) if 8 * len(table_rows) * period <= BROADCAST_BYTES else steps, F.col("__src").eqNullSafe(F.col("s__")) & (F.col("lo__") <= F.col("__block")) & (F.col("__block") < F.col("hi__"))).withColumn("__k", F.col("__block") - F.col("lo__"))
    k, share = F.col("__k"), F.col("share__")
    in_phase = F.floor(k / share) * period + F.element_at(F.col("slots__"), (k % share + 1).cast("int"))
    slot = F.col("start__") + in_phase
    values = (F.col("p__"), F.floor(k * period / share), F.ceil((k + 1) * period / share), slot, slot * block_rows + F.col("__i") % block_rows)
    met = replacing(met, **dict(zip(names, (v.cast("long") for v in values), strict=True)))
    return met.drop(*own, "__n", "__k", *steps.columns)


def _exact(dealt: DataFrame, offsets: DataFrame, labels: list, blocks: list[int], target: list[float], block_rows: int, names: tuple, own: list[str]) -> DataFrame:
    """The end of mix by exact weights: each bucket of a source brings the slots of its blocks along."""
    spark, plan = dealt.sparkSession, exact_schedule(blocks, target)
    columns = {c: np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for c, x in plan.items()}
    named = spark.createDataFrame(list(enumerate(labels)), "source long, s__ string")
    slots = spark.createDataFrame(pa.table({**columns, "slot": np.arange(len(columns["source"]))})).join(named, "source")
    first, last = F.floor(F.col("__before") / block_rows), F.floor((F.col("__before") + F.col("__n") - 1) / block_rows)
    held = offsets.withColumn("block__", F.explode(F.sequence(first, last)))
    held = held.join(slots, F.col("__src2").eqNullSafe(F.col("s__")) & (F.col("block__") == F.col("block")))
    held = held.groupBy("__src2", "__b2", "__before").agg(F.array_sort(F.collect_list(F.struct("block", "phase", "release", "deadline", "slot"))).alias("held__"))
    met = dealt.join(bounded(write_shared(held, "mix-slots")), F.col("__src").eqNullSafe(F.col("__src2")) & (F.col("__b") == F.col("__b2")))
    met = met.withColumn("__i", F.col("__before") + F.col("__nth")).withColumn("__block", F.floor(F.col("__i") / block_rows))
    mine = F.element_at("held__", (F.col("__block") - F.floor(F.col("__before") / block_rows) + 1).cast("int"))
    met = met.withColumn("mine__", mine)
    slot = F.col("mine__.slot")
    values = (F.col("mine__.phase"), F.col("mine__.release"), F.col("mine__.deadline"), slot, slot * block_rows + F.col("__i") % block_rows)
    met = replacing(met, **dict(zip(names, (v.cast("long") for v in values), strict=True)))
    return met.drop(*own, "held__", "mine__")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of sources, with its block's release time and deadline."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
