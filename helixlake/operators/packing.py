"""Work that a rule deals out one item after another, done in parallel: batches and least-loaded bins.

Both results are those of one pass over all items in order. Items get their place in the whole order
first (in ranges, no task sees them all) and are cut into stretches of STRETCH places.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.sources.shared import shared_folder, write_shared

STRETCH, SEGMENTS_AT_ONCE = 65_536, 100_000
_PLACE, _STRETCH = "__place", "__stretch"


def placed(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """The written items with their place (from 0) and stretch in the order (nulls first). Items that the order
    leaves equal stand in any order, but always the same."""
    ranges = write_shared(items.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "in-order")
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    rows = ranges.withColumn("__inside", inside).join(F.broadcast(sizes.select("__range", ahead.alias("__ahead"))), "__range")
    rows = rows.withColumn(_PLACE, (F.col("__ahead") + F.col("__inside") - 1).cast("long")).drop("__range", "__inside", "__ahead")
    return write_shared(rows.withColumn(_STRETCH, F.floor(F.col(_PLACE) / STRETCH)), "placed")


def next_starts(sizes: np.ndarray, max_tokens: int, max_items: int) -> np.ndarray:
    """For a batch that begins at each item, where the next one begins: the longest item of each run of items
    comes from running maxima, and the first run over a budget ends the batch."""
    n, longest, fits, steps = len(sizes), sizes.copy(), np.ones(len(sizes), bool), np.ones(len(sizes), np.int64)
    for k in range(1, min(max_items, n)):
        longest[: n - k] = np.maximum(longest[: n - k], sizes[k:])
        fits[n - k :] = False
        fits &= longest * (k + 1) <= max_tokens
        if not fits.any():
            break
        steps += fits
    return np.arange(n) + steps


def _jumps(starts: np.ndarray, own: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Where 1, 2, 4, ... batches lead from each item, up to the first start beyond the stretch; and how many
    batches begin in the stretch from there."""
    at = np.arange(len(starts))
    jump, count = np.where(at < own, starts, at), (at < own).astype(np.int64)
    held = [jump]
    while (jump[: own] < own).any():
        count = count + count[jump]
        jump = jump[jump]
        held.append(jump)
    return held, count


def _padded(starts: np.ndarray, own: int, max_items: int) -> np.ndarray:
    """With room for starts beyond the last item."""
    return np.concatenate([starts, np.arange(len(starts), own + max_items + 1)])


def pack_batches(items: DataFrame, shard: str, order: str, length: str, *, special: int = 2, max_tokens: int = 4096, max_items: int = 64) -> DataFrame:
    """items plus batch_no: batches in input order, by shard and then by `order`. A batch is closed when
    one more item would take its padded size over max_tokens or its number over max_items; an item
    over the budget is a batch of its own. A null length counts as 0.

    Where a batch begins decides where the next one does, and that is known from max_items items. So each
    stretch is summed up as a table: from each place where its first batch can begin, where the next
    stretch's first one does and how many batches there are between (by pointer doubling). Tables
    of neighbours are joined into tables of two, four, ... stretches and the first batch of each is
    handed back down. Stretches are numbered on their own then.
    """
    rows = placed(items, [shard, order])
    size = F.coalesce(F.col(length).cast("long"), F.lit(0)) + special
    own = rows.select(F.col(_STRETCH).alias("c"), F.col(_PLACE).alias("i"), size.alias("size"))
    ahead = own.filter((F.col("c") > 0) & (F.col("i") - F.col("c") * STRETCH < max_items - 1)).withColumn("c", F.col("c") - 1)
    seen = own.unionByName(ahead)

    def begun(group: pa.Table) -> tuple[int, int, np.ndarray]:
        c, i, sizes = group["c"][0].as_py(), group["i"].to_numpy(), group["size"].to_numpy()
        mine = int((i < (c + 1) * STRETCH).sum())
        return c, mine, _padded(next_starts(sizes[np.argsort(i)], max_tokens, max_items), mine, max_items)

    def summed(group: pa.Table) -> pa.Table:
        c, mine, starts = begun(group)
        held, count = _jumps(starts, mine)
        n = min(max_items, mine)
        return pa.table({"c": np.full(n, c, np.int64), "enter": np.arange(n), "leave": held[-1][:n] - mine, "batches": count[:n]})

    kind = "c bigint, enter bigint, leave bigint, batches bigint"
    tables = [write_shared(seen.groupBy("c").applyInArrow(summed, kind), "batch-starts")]
    n = tables[0].agg(F.max("c")).first()[0]
    n = 0 if n is None else n + 1
    while n > 1:
        two = lambda odd: tables[-1].filter(F.col("c") % 2 == odd).withColumn("c", F.floor(F.col("c") / 2))
        second = two(1).select("c", F.col("enter").alias("leave"), F.col("leave").alias("out"), F.col("batches").alias("more"))
        both = two(0).join(second, ["c", "leave"], "left").select("c", "enter", F.coalesce("out", "leave").alias("leave"), (F.col("batches") + F.coalesce("more", F.lit(0))).alias("batches"))
        tables.append(write_shared(both, "batch-starts"))
        n = -(-n // 2)
    first = items.sparkSession.createDataFrame([(0, 0, 0)], "c bigint, enter bigint, before bigint")
    for table in tables[-2::-1]:
        half = first.withColumn("c", F.col("c") * 2).join(table, ["c", "enter"], "left")
        right = half.filter(F.col("leave").isNotNull()).select((F.col("c") + 1).alias("c"), F.col("leave").alias("enter"), (F.col("before") + F.col("batches")).alias("before"))
        first = write_shared(half.select("c", "enter", "before").unionByName(right), "batch-starts")

    def numbered(group: pa.Table) -> pa.Table:
        c, mine, starts = begun(group)
        enter, before = group["enter"][0].as_py(), group["before"][0].as_py()
        held, _ = _jumps(starts, mine)
        reached = np.zeros(len(starts), bool)
        reached[enter] = True
        for jump in held[::-1]:
            reached[jump[reached]] = True
        return pa.table({_PLACE: np.arange(mine) + c * STRETCH, "batch_no": before - 1 + np.cumsum(reached[:mine])})

    numbers = seen.join(first, "c").groupBy("c").applyInArrow(numbered, f"{_PLACE} bigint, batch_no bigint")
    return rows.drop(_STRETCH).join(numbers, _PLACE).drop(_PLACE)


def fill(loads: list[int], weight: int, n: int) -> list[tuple[int, list[int]]]:
    """n items of one weight to the least loaded bins, as (items, bins in turn); loads are brought up to date.

    Bin b takes its items at loads b, b + w, b + 2w, ...; all bins' items go in the order of these loads. So
    bins whose loads are within one weight of each other take turns, and more join them as the loads rise.
    """
    if not weight:
        return [(n, [loads.index(min(loads))])]
    base, out = min(loads), []
    level, rest = zip(*(divmod(x - base, weight) for x in loads), strict=True)
    steps = sorted(set(level))
    for now, after in zip(steps, [*steps[1:], None], strict=True):
        turns = sorted((b for b in range(len(loads)) if level[b] <= now), key=lambda b: (rest[b], b))
        take = n if after is None else min(n, (after - now) * len(turns))
        for k, b in enumerate(turns):
            loads[b] += weight * (take // len(turns) + (k < take % len(turns)))
        out.append((take, turns))
        n -= take
        if not n:
            break
    return out


def least_loaded(items: DataFrame, order: Sequence[str], weight: str, bins: int) -> DataFrame:
    """items plus bin (int): each item, in order, to the bin with the least weight so far, of equal ones the
    first. Weights are whole numbers; null and negative ones count as 0.

    Runs of equal weight (at most STRETCH long) fill the bins like water: the driver passes over the runs
    with no more than the bins' loads and writes which bins take turns from which place on. In an
    order by weight there are few runs; in another one there may be as many as items, and
    the driver's time grows with them.
    """
    rows = placed(items, order)
    heavy = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0))
    at = Window.partitionBy(_STRETCH).orderBy(_PLACE)
    marked = rows.select(_STRETCH, _PLACE, heavy.alias("w")).withColumn("old", F.lag("w").over(at))
    runs = marked.filter(F.col("old").isNull() | (F.col("old") != F.col("w"))).select(_PLACE, "w")
    runs = write_shared(runs.repartitionByRange(_PLACE).sortWithinPartitions(_PLACE), "runs")
    n, session = rows.count(), items.sparkSession
    path, kind = f"{shared_folder(session)}/turns-{uuid.uuid4().hex}", f"{_STRETCH} bigint, {_PLACE} bigint, turns array<int>"
    loads, held, last = [0] * bins, [], None

    def spread(begin: int, end: int, w: int) -> None:
        for size, turns in fill(loads, w, end - begin):
            held.append((begin // STRETCH, begin, turns))
            begin += size

    def flush() -> None:
        session.createDataFrame(held, kind).write.mode("append").parquet(path)
        held.clear()

    for place, w in runs.orderBy(_PLACE).toLocalIterator():
        if last is not None:
            spread(last[0], place, last[1])
        last = place, w
        if len(held) >= SEGMENTS_AT_ONCE:
            flush()
    if last is not None:
        spread(last[0], n, last[1])
    flush()
    turns = session.read.schema(kind).parquet(path).select(_STRETCH, _PLACE, "turns", F.col(_PLACE).alias("begin"))
    met = rows.join(turns, [_STRETCH, _PLACE], "left").withColumn("t", F.when(F.col("begin").isNotNull(), F.struct("begin", "turns")))
    met = met.withColumn("t", F.last("t", ignorenulls=True).over(at))
    turn = F.get("t.turns", F.pmod(F.col(_PLACE) - F.col("t.begin"), F.size("t.turns")).cast("int"))
    return met.withColumn("bin", turn).select(*items.columns, "bin")
