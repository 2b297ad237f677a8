from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from helixlake.llm import mixing as M


@pytest.mark.parametrize("share", [[3, 5, 2], [1, 1, 8], [333, 333, 334], [1, 999], [7], [1] * 20])
def test_schedule_stays_within_a_block(share):
    period, seen = sum(share), Counter()
    for slot, s in enumerate(M.schedule(share, period), 1):
        seen[s] += 1
        assert M.release(seen[s] - 1, share[s], period) < slot <= M.deadline(seen[s] - 1, share[s], period)
        assert all(abs(seen[i] - Fraction(a * slot, period)) < 1 for i, a in enumerate(share))
    assert [seen[i] for i in range(len(share))] == share


def edf(blocks, weights, period):
    """Brute force: slot by slot over all blocks, with new phases when a source has run out."""
    left, out = list(blocks), []
    while any(left):
        live = [s for s in range(len(left)) if left[s]]
        share = dict(zip(live, M.shares([weights[s] for s in live], period), strict=True))
        done, slot = Counter(), 0
        while True:
            ready = [(-(-(done[s] + 1) * period // share[s]), s) for s in live if done[s] * period // share[s] <= slot]
            s = min(ready)[1]
            if not left[s]:
                break
            out.append(s)
            left[s] -= 1
            done[s] += 1
            slot += 1
    return out


def test_mix_matches_brute_force_and_keeps_all_rows(spark):
    sizes = {"hot": 700, "b": 90, "c": 33, None: 12, "": 3}
    rows = [(i, s, f"t{i}", 5) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(None, "b", "null key", 5), (3, "hot", "repeat", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot int").repartition(5)
    got = M.mix(df, block_rows=10, period=50).collect()
    assert sorted(r.text for r in got) == sorted(r[2] for r in rows)
    assert len({r.mix_position for r in got}) == len(rows)
    order = sorted(got, key=lambda r: r.mix_position)
    slots = {}
    for r in order:
        slots.setdefault(r.mix_slot, r.source)
        assert slots[r.mix_slot] == r.source
    assert sorted(slots) == list(range(len(slots)))
    n = Counter(r[1] for r in rows)
    labels = sorted(n, key=lambda s: (s is not None, s or ""))
    blocks = [-(-n[s] // 10) for s in labels]
    assert [labels.index(slots[i]) for i in range(len(slots))] == edf(blocks, [b**0.5 for b in blocks], 50)
    again = M.mix(df.repartition(2), block_rows=10, period=50).collect()
    assert {(r.text, r.mix_slot) for r in again if r.text != "repeat" and r.doc_id != 3} == {(r.text, r.mix_slot) for r in got if r.text != "repeat" and r.doc_id != 3}


def test_weights_empty_table_and_errors(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(400)], "doc_id long, source string")
    got = M.mix(df, weights={"a": 3.0, "b": 1.0}, block_rows=5, period=100).filter("mix_phase = 0 and mix_slot < 40").collect()
    assert Counter(r.source for r in got) == {"a": 150, "b": 50}
    assert M.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.mix(df, weights={"a": -1.0})


@pytest.mark.parametrize("period", [None, 20])
def test_sources_of_weight_0_come_last(spark, period):
    df = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(400)], "doc_id long, source string")
    got = M.mix(df, weights={"a": 0.0, "b": 1.0, "c": 1.0, "d": 0.0}, block_rows=5, period=period).orderBy("mix_position").collect()
    assert Counter(r.source for r in got[:200]) == {"b": 100, "c": 100} and Counter(r.source for r in got[200:300])["a"] == 50
    assert sorted(r.doc_id for r in got) == list(range(400))


def test_null_keys_are_spread_and_blocks_grow_with_the_rows(spark, monkeypatch):
    df = spark.createDataFrame([(None, "a", f"t{i}") for i in range(3000)], "doc_id long, source string, text string").repartition(3)
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = M.mix(df).withColumn("p", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.mix_position for r in got) == list(range(3000)) and max(Counter(r.p for r in got).values()) < 1500
    monkeypatch.setattr(M, "MOST_BLOCKS", 10)
    assert {r.mix_slot for r in M.mix(df).collect()} == set(range(10))


def test_exact_weights_stay_within_a_block_over_many_periods():
    weights = [0.2, *[0.8 / 19] * 18, 0.8 / 19 - 0.0007, 0.0007]
    plan = M.exact_schedule([5_000] * 21, weights)
    exact = [Fraction(w) for w in weights]
    total, n = sum(exact), Counter()
    first = [s for s, p in zip(plan["source"], plan["phase"], strict=True) if p == 0]
    assert len(first) > 20_000
    for slot, s in enumerate(first, 1):
        n[s] += 1
        if slot % 97 == 0:
            assert all(abs(n[i] - w / total * slot) < 1 for i, w in enumerate(exact))
    assert Counter(plan["source"]) == dict.fromkeys(range(21), 5_000)


def test_more_sources_than_slots_of_a_period(spark):
    rows = [(i, None if i % 1501 == 7 else f"host{i % 1501}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    got = M.mix(df, block_rows=2).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000)) and len({r.mix_position for r in got}) == 4000
    slots = {}
    for r in got:
        assert slots.setdefault(r.mix_slot, (r.source, r.mix_phase, r.mix_release, r.mix_deadline)) == (r.source, r.mix_phase, r.mix_release, r.mix_deadline)
    assert sorted(slots) == list(range(len(slots)))
    starts = {}
    for k, (_, phase, *_) in sorted(slots.items()):
        starts.setdefault(phase, k)
    assert all(a <= k - starts[p] < b for k, (_, p, a, b) in slots.items())
