"""Global alignment with affine gaps, of many pairs at once.

Two rules tell how alike two sequences are, and they are never mixed: `sequences.pair_identity` counts
a gap's columns alike (+1, -1, -1) and divides by the columns; the one here is that of reports and
residue maps: a match 2, a mismatch -1, a gap -3 and each further column of it -1, matches over
the longer length.

A task aligns a group of pairs together: for each row of the tables of all pairs, three states (both
residues, a gap in b, a gap in a) are computed with array operations over pairs and columns. The way
back is followed for all pairs at a time as well. Of equally good alignments the one is taken that, seen
from the end, has residues in both before a gap in b, and that before a gap in a.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rule.
MATCH, MISMATCH, OPEN, EXTEND = 2, -1, -3, -1
CELLS_AT_ONCE = 8_000_000
_NEVER = -(10**9)


def _codes(texts: list[str], width: int, filler: int) -> np.ndarray:
    out = np.full((len(texts), width), filler, np.int32)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _first_of(value: np.ndarray, *ways: np.ndarray) -> np.ndarray:
    """The number of the first way that gives the value."""
    return np.where(ways[0] == value, 0, np.where(ways[1] == value, 1, 2)).astype(np.uint8)


def align(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, i, j, same) of residues that stand in one column, by pair and place."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    x, y = _codes(a, int(la.max()), -1), _codes(b, int(lb.max()), -2)
    n, m, each = x.shape[1], y.shape[1], np.arange(len(a))
    ways = np.zeros((n + 1, len(a), m + 1), np.uint8)  # two bits for each state: where it came from
    at = np.arange(m + 1, dtype=np.int32)
    both, gap_b, gap_a = (np.full((len(a), m + 1), _NEVER, np.int32) for _ in range(3))
    both[:, 0] = 0
    gap_a[:, 1:] = OPEN + EXTEND * (at[1:] - 1)
    ways[0, :, 2:] = 2 << 4
    last = np.zeros((3, len(a)), np.int32)
    for i in range(n + 1):
        if i:
            old_both, old_b, old_a = both, gap_b, gap_a
            best = np.maximum(np.maximum(old_both, old_b), old_a)
            both = np.full_like(best, _NEVER)
            both[:, 1:] = best[:, :-1] + np.where(y == x[:, i - 1 : i], MATCH, MISMATCH)
            opened_both, more, opened_a = old_both + OPEN, old_b + EXTEND, old_a + OPEN
            gap_b = np.maximum(np.maximum(opened_both, more), opened_a)
            # a gap in a of any length ends here: a running maximum over where it begins
            begun = np.maximum.accumulate(np.maximum(both, gap_b) - EXTEND * at, axis=1)
            gap_a = np.full_like(best, _NEVER)
            gap_a[:, 1:] = begun[:, :-1] + OPEN + EXTEND * (at[1:] - 1)
            way = _first_of(gap_b, opened_both, more) << 2
            way[:, 1:] |= _first_of(best[:, :-1], old_both[:, :-1], old_b[:, :-1])
            way[:, 1:] |= _first_of(gap_a[:, 1:], both[:, :-1] + OPEN, gap_b[:, :-1] + OPEN) << 4
            ways[i] = way
        done = np.flatnonzero(la == i)
        for k, state in enumerate((both, gap_b, gap_a)):
            last[k, done] = state[done, lb[done]]
    i, j, state, found = la.copy(), lb.copy(), last.argmax(axis=0), []
    while len(each):
        found.append((each[state == 0], i[state == 0] - 1, j[state == 0] - 1))
        before = ways[i, each, j] >> (2 * state).astype(np.uint8) & 3
        i, j = i - (state != 2), j - (state != 1)
        # a way back that has used up one sequence is in the gap of the other
        state = np.where((i == 0) & (j > 0), 2, np.where((j == 0) & (i > 0), 1, before))
        left = (i > 0) | (j > 0)
        each, i, j, state = each[left], i[left], j[left], state[left]
    pair, i, j = (np.concatenate(p) for p in zip(*found, strict=True))
    order = np.lexsort((i, pair))
    pair, i, j = pair[order], i[order], j[order]
    return pair, i, j, x[pair, i] == y[pair, j]


def _groups(a: list[str], b: list[str]) -> Iterator[np.ndarray]:
    """Numbers of pairs with both sequences, those of like lengths together, few enough for the tables."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    todo = np.flatnonzero((la > 0) & (lb > 0))
    todo = todo[np.lexsort((lb[todo], la[todo]))]
    begin = 0
    while begin < len(todo):
        end, wide = begin, 0
        while end < len(todo):
            wide = max(wide, int(lb[todo[end]]) + 1)
            if end > begin and (end - begin + 1) * wide * (int(la[todo[end]]) + 1) > CELLS_AT_ONCE:
                break
            end += 1
        yield todo[begin:end]
        begin = end


def aligned(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, matches, residues): each distinct pair of sequences, the number of equal residues, and the places
    array<struct<gt_idx, pred_idx>> of all that stand in one column.

    Sequences are taken as they are, a character a residue; null is like empty, and has nothing to align.
    Equal sequences aren't aligned but stand place by place. A pair takes a byte for each two residues,
    and has to fit in a task.
    """
    kind = pa.list_(pa.struct([("gt_idx", pa.int32()), ("pred_idx", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([t or "" for t in batch[k].to_pylist()] for k in (0, 1))
            matches, parts = np.zeros(len(left), np.int32), [[np.zeros(0, np.int64)] for _ in range(3)]
            for group in _groups(left, right):
                pair, i, j, same = align([left[g] for g in group], [right[g] for g in group])
                matches += np.bincount(group[pair[same]], minlength=len(left)).astype(np.int32)
                for part, values in zip(parts, (group[pair], i, j), strict=True):
                    part.append(values)
            pair, i, j = (np.concatenate(p) for p in parts)
            order = np.lexsort((i, pair))
            starts = np.searchsorted(pair[order], np.arange(len(left) + 1)).astype(np.int32)
            places = pa.StructArray.from_arrays([pa.array(i[order], pa.int32()), pa.array(j[order], pa.int32())], ["gt_idx", "pred_idx"])
            yield pa.record_batch([batch[0], batch[1], pa.array(matches), pa.ListArray.from_arrays(pa.array(starts), places).cast(kind)], names=["a", "b", "matches", "residues"])

    one = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct()
    schema = "a string, b string, matches int, residues array<struct<gt_idx:int,pred_idx:int>>"
    same = F.col("a") == F.col("b")
    equal = one.filter(same).select("a", "b", F.length("a").alias("matches"), F.expr("transform(filter(sequence(0, length(a)), i -> i < length(a)), i -> struct(i AS gt_idx, i AS pred_idx))").alias("residues"))
    return one.filter(~F.coalesce(same, F.lit(False))).mapInArrow(run, schema).unionByName(equal)


def _met(pairs: DataFrame, a: str, b: str) -> tuple[DataFrame, str, str]:
    found = aligned(pairs, a, b).alias("found")
    met = pairs.alias("given").join(found, F.col(f"given.`{a}`").eqNullSafe(F.col("found.a")) & F.col(f"given.`{b}`").eqNullSafe(F.col("found.b")))
    return met, F.col(f"given.`{a}`"), F.col(f"given.`{b}`")


def report_identity(pairs: DataFrame, a: str, b: str, name: str = "identity", count: str = "aligned") -> DataFrame:
    """pairs plus the share of equal residues in the longer length, and how many residues stand in one column.
    Where a sequence is null or empty both are 0. Columns of these names are replaced."""
    met, x, y = _met(pairs, a, b)
    longer = F.greatest(F.length(x), F.length(y))
    share = F.when(F.size("found.residues") > 0, F.col("found.matches") / longer).otherwise(0.0)
    kept = [F.col(f"given.`{c}`") for c in pairs.columns if c.lower() not in (name.lower(), count.lower())]
    return met.select(*kept, share.alias(name), F.size("found.residues").alias(count))


def residue_maps(pairs: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """(key, gt_idx, pred_idx) of aligned residues; nothing where a sequence is null or empty."""
    met, *_ = _met(pairs, truth, predicted)
    return met.select(F.col(f"given.`{key}`"), F.explode("found.residues").alias("m")).select(key, "m.gt_idx", "m.pred_idx")
