"""Which predicted chain is which true chain, by the coordinates that they share.

The error of a mapping after the best rigid motion only needs sums over its chain pairs: number of
common residues, coordinate sums, cross products and squares. Spark aggregates these once for each
pair of chains that may be mapped; what chooses a mapping gets one small table for each candidate
and never sees a point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.operators import coordinates, sequences
from helixlake.operators.joins import common_residues

SCHEMA = "target string, sample string, mapping_key string, rmsd double, exact boolean, issue string"
COUNTS_DIFFER, SEQUENCES_DIFFER, FEW_ATOMS = "chain counts differ", "sequences differ", "under three common atoms"
_XYZ = coordinates.XYZ
_SUMS = ["n", *[f"p{c}" for c in _XYZ], *[f"t{c}" for c in _XYZ], *[f"p{a}t{b}" for a in _XYZ for b in _XYZ], "pp", "tt"]


def cheapest(cost: np.ndarray) -> list[int]:
    """The column of each row of a square cost table, of least sum (shortest augmenting paths)."""
    n = len(cost)
    if n == 1:
        return [0]
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j, least, way, used = i, 0, np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[j]:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[match[j] - 1, free - 1] - u[match[j]] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j
            k = free[np.argmin(least[free])]
            step = least[k]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j = k
        while j:
            match[j], j = match[way[j]], way[j]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def motions(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations, shifts and errors of the best rigid motions, of tables of sums (last axis _SUMS)."""
    n = sums[..., :1]
    p, t = sums[..., 1:4] / n, sums[..., 4:7] / n
    cross = sums[..., 7:16].reshape(*sums.shape[:-1], 3, 3) / n[..., None] - p[..., :, None] * t[..., None, :]
    u, s, vt = np.linalg.svd(cross)
    s[..., 2] *= np.sign(np.linalg.det(u @ vt))
    vt[..., 2, :] *= np.sign(np.linalg.det(u @ vt))[..., None]
    rotation = np.swapaxes(u @ vt, -1, -2)
    spread = sums[..., 16] / n[..., 0] - (p * p).sum(-1) + sums[..., 17] / n[..., 0] - (t * t).sum(-1)
    return rotation, t - np.einsum("...ab,...b", rotation, p), np.sqrt(np.maximum(0.0, spread - 2 * s.sum(-1)))


def distances(sums: np.ndarray, rotation: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Mean squared distance of each pair of chains once the predicted ones are moved."""
    n, p, t = sums[..., 0], sums[..., 1:4], sums[..., 4:7]
    cross = np.einsum("ab,...ba", rotation, sums[..., 7:16].reshape(*sums.shape[:-1], 3, 3))
    total = sums[..., 16] + sums[..., 17] + n * (shift @ shift) + 2 * (p @ rotation.T @ shift - cross - t @ shift)
    return np.maximum(0.0, total) / n


def best_mappings(sums: np.ndarray, group: np.ndarray, rounds: int) -> dict[tuple[int, ...], float]:
    """Errors of the mappings (the true chain of each predicted one) met on the way to those that a
    refit doesn't change.

    sums: predicted x true x _SUMS, whose n is 0 where two chains may not be mapped or share
    nothing; group: for each predicted chain the number of its sequence. The first fit is of what is
    certain, the chains without copies, or else of each pair of the sequence with fewest copies in
    turn. Chains are then dealt at least cost and the whole is fitted anew, until it stays."""
    copies = np.bincount(group)[group]
    pairs = np.argwhere(sums[..., 0] >= 3)
    rare = pairs[copies[pairs[:, 0]] == copies[pairs[:, 0]].min()] if len(pairs) else pairs
    starts = [(sums[i, j], i, j) for i, j in rare]
    sure = sums[copies == 1].sum(axis=(0, 1))
    if sure[0] >= 3:
        starts = [(sure, None, None)]
    out: dict[tuple[int, ...], float] = {}
    for whole, i, j in starts:
        met = sums[..., 0] > 0
        if i is not None:  # held for the first deal
            met[i, np.arange(len(met)) != j] = False
        for _ in range(rounds):
            rotation, shift, _ = motions(whole)
            cost = np.zeros(met.shape)
            cost[met] = distances(sums[met], rotation, shift)
            cost[~met] = 1 + len(met) * cost.max()
            now = tuple(cheapest(cost))
            if now in out or not met[range(len(now)), now].all():
                break
            whole = sums[range(len(now)), now].sum(axis=0)
            out[now] = float(motions(whole)[2])
            met = sums[..., 0] > 0
    return out


def _choose(chains_a: list[str], chains_b: list[str], sequences_a: list[str], identity: list, exact: bool, numbers: np.ndarray, rounds: int, tolerance: float) -> list[tuple]:
    """(mapping_key, rmsd, exact, issue) of one candidate, of chain pairs with their sums."""
    preds, trues = sorted(set(chains_a)), sorted(set(chains_b))
    row, column = {c: i for i, c in enumerate(preds)}, {c: i for i, c in enumerate(trues)}
    at = [row[c] for c in chains_a], [column[c] for c in chains_b]
    sums = np.zeros((len(preds), len(trues), len(_SUMS)))
    sums[at] = numbers
    name = lambda m: ",".join(f"{p}:{trues[j]}" for p, j in zip(preds, m, strict=True))
    if not exact:
        cost = np.ones((len(preds), len(trues)))
        cost[at] = 1 - np.array(identity, float)
        dealt = cheapest(cost)
        whole = sums[range(len(dealt)), dealt].sum(axis=0)
        return [(name(dealt), float(motions(whole)[2]) if whole[0] >= 3 else None, False, SEQUENCES_DIFFER)]
    of = dict(zip(chains_a, sequences_a, strict=True))
    _, group = np.unique([of[c] for c in preds], return_inverse=True)
    found = best_mappings(sums, group, rounds)
    if not found:
        return [(None, None, True, FEW_ATOMS)]
    top = min(found.values()) + tolerance
    return sorted((name(m), e, True, "") for m, e in found.items() if e <= top)


def mapping_options(predicted: DataFrame, truth: DataFrame, *, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(target, sample, mapping_key, rmsd, exact, issue): the chain mappings of each candidate whose
    error is within the tolerance of the best; a candidate without one has a row that says why.
    predicted has target, sample, chain, sequence, seq_id, x, y, z; truth the same without sample.

    Chains of equal sequence may be mapped, at residues that both have. Where as many chains have
    other sequences, the mapping of least summed 1 - identity is given for inspection, with its
    error, exact false and an issue; where their numbers differ there is none."""
    candidate = ["target", "sample"]
    of = lambda df, keys, out: df.groupBy(*keys, F.col("chain").alias(f"chain_{out}")).agg(F.min("sequence").alias(f"seq_{out}"))
    pred, true = of(predicted, candidate, "a"), of(truth, ["target"], "b")
    bag = lambda df, keys, c: df.groupBy(*keys).agg(F.array_sort(F.collect_list(f"seq_{c}")).alias(f"bag_{c}"))
    both = bag(pred, candidate, "a").join(bag(true, ["target"], "b"), "target").select(*candidate, (F.size("bag_a") == F.size("bag_b")).alias("even"), (F.col("bag_a") == F.col("bag_b")).alias("exact"))
    pairs = pred.join(both.filter("even").drop("even"), candidate).join(true, "target").filter(~F.col("exact") | (F.col("seq_a") == F.col("seq_b")))
    unlike = sequences.pair_identity(pairs.filter(~F.col("exact")).select("seq_a", "seq_b").distinct(), "seq_a", "seq_b")
    pairs = pairs.join(unlike, ["seq_a", "seq_b"], "left")

    points = common_residues(coordinates.centre(predicted, candidate), coordinates.centre(truth, ["target"]), pairs.select(*candidate, "chain_a", "chain_b"), candidate, by=["target"])
    p, t = {c: F.col(c) for c in _XYZ}, {c: F.col(f"{c}_b") for c in _XYZ}
    every = [*p.values(), *t.values(), *[p[a] * t[b] for a in _XYZ for b in _XYZ], sum(x * x for x in p.values()), sum(x * x for x in t.values())]
    sums = points.groupBy(*candidate, "chain_a", "chain_b").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x).alias(c) for c, x in zip(_SUMS[1:], every, strict=True)])
    table = pairs.join(sums, [*candidate, "chain_a", "chain_b"], "left").withColumnRenamed("seq_a", "sequence").drop("seq_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, out, at = batch["rows"].flatten(), [], 0
            told = [flat.field(c).to_pylist() for c in ("chain_a", "chain_b", "sequence", "identity", "exact")]
            numbers = np.column_stack([flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _SUMS]) if len(flat) else np.zeros((0, len(_SUMS)))
            numbers[np.isnan(numbers)] = 0.0
            for i, n in enumerate(batch["rows"].value_lengths().to_pylist()):
                a, b, sequence, identity, exact = (x[at : at + n] for x in told)
                out += [(i, *found) for found in _choose(a, b, sequence, identity, exact[0], numbers[at : at + n], rounds, tolerance)]
                at += n
            if out:
                number, key, error, exact, issue = zip(*out, strict=True)
                of = [batch[c].take(pa.array(number)) for c in candidate]
                yield pa.record_batch([*of, pa.array(key, pa.string()), pa.array(error, pa.float64()), pa.array(exact, pa.bool_()), pa.array(issue, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    told = table.groupBy(*[F.col(c).cast("string").alias(c) for c in candidate]).agg(F.collect_list(F.struct("chain_a", "chain_b", "sequence", "identity", "exact", *_SUMS)).alias("rows"))
    uneven = both.filter(~F.col("even")).select(*candidate, F.lit(None).cast("string").alias("mapping_key"), F.lit(None).cast("double").alias("rmsd"), F.lit(False).alias("exact"), F.lit(COUNTS_DIFFER).alias("issue"))
    return told.mapInArrow(run, SCHEMA).unionByName(uneven)


def unequal_assignment(identities: DataFrame) -> DataFrame:
    """identities(target, pred, truth, identity): the pairs of least summed 1 - identity where both
    sides have as many chains; a pair without an identity has 0. Such maps never pass by themselves.
    Targets go to Python many at once, each as a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets, sizes = batch["target"], batch["rows"].value_lengths().to_numpy()
            flat = batch["rows"].flatten()
            preds, truths, values = (flat.field(k).to_pylist() for k in range(3))
            out: list[tuple] = []
            at = 0
            for i, n in enumerate(sizes.tolist()):
                p, t = sorted(set(preds[at : at + n])), sorted(set(truths[at : at + n]))
                if len(p) == len(t):
                    row, column = {c: k for k, c in enumerate(p)}, {c: k for k, c in enumerate(t)}
                    cost = np.ones((len(p), len(t)))
                    for a, b, v in zip(preds[at : at + n], truths[at : at + n], values[at : at + n], strict=True):
                        cost[row[a], column[b]] = 1 - v
                    out += [(i, p[k], t[j], 1 - float(cost[k, j])) for k, j in enumerate(cheapest(cost))]
                at += n
            if out:
                number, p, t, v = zip(*out, strict=True)
                yield pa.record_batch([targets.take(pa.array(number)), pa.array(p, pa.string()), pa.array(t, pa.string()), pa.array(v, pa.float64())], names=["target", "pred", "truth", "identity"])

    met = identities.filter("pred IS NOT NULL AND truth IS NOT NULL AND identity IS NOT NULL AND NOT isnan(identity)").groupBy("target", "pred", "truth").agg(F.max("identity").alias("identity"))
    rows = met.groupBy(F.col("target").cast("string").alias("target")).agg(F.collect_list(F.struct("pred", "truth", F.col("identity").cast("double").alias("identity"))).alias("rows"))
    return rows.mapInArrow(run, "target string, pred string, truth string, identity double").withColumn("exact", F.lit(False))
