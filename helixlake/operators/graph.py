"""Connected components and redundancy masking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.operators.ranking import best_hits, number_components, representatives
from helixlake.sources.shared import write_shared


CHUNK_EDGES = 500_000


def _local_roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For edges between numbers from 0 the smallest number that each is connected to."""
    roots = np.arange(max(a.max(), b.max()) + 1)
    while True:
        x, y = roots[a], roots[b]
        if (x == y).all():
            return roots
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while (roots[roots] != roots).any():
            roots = roots[roots]


def contracted(edges: DataFrame, chunks: int) -> DataFrame:
    """Edges (a, b) cut into chunks by number, each end of a chunk with the smallest that it is connected
    to within the chunk: the same components, fewer edges and shorter ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            whole = pa.Table.from_batches(parts)
            names, number = np.unique(np.concatenate([whole["a"].to_numpy(), whole["b"].to_numpy()]), return_inverse=True)
            roots = _local_roots(*np.split(number, 2))
            moved = np.flatnonzero(roots != np.arange(len(names)))
            kind = whole.schema.field("a").type
            yield pa.record_batch([pa.array(names[moved], kind), pa.array(names[roots[moved]], kind)], names=["a", "b"])

    return edges.repartition(chunks).mapInArrow(run, edges.schema)


def component_roots(edges: DataFrame, max_rounds: int = 60, chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """(node, root) of every node that isn't the smallest of its component, for undirected edges
    (a, b). Chunks of a bounded number of edges are contracted on their own first. Then, in a round,
    each node takes the smallest end of its edges as parent, hands the other ends to it, and jumps
    to the parent's parent; the driver only sees whether anything moved."""
    now = write_shared(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph-edges")
    chunks = max(1, -(-now.count() // chunk_edges))
    now = contracted(now, chunks).withColumn("moved", F.lit(chunks > 1))
    for _ in range(max_rounds):
        now = write_shared(now, "graph")
        if not now.filter("moved").head(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        parent = now.groupBy("a").agg(F.min("b").alias("m"))
        hooks = now.join(parent, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        grand = parent.select(F.col("a").alias("m"), F.col("m").alias("up"))
        jumps = parent.join(grand, "m", "left").select("a", F.coalesce("up", "m").alias("b"), F.col("up").isNotNull().alias("moved"))
        now = jumps.unionByName(hooks).groupBy("a", "b").agg(F.max("moved").alias("moved"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """nodes plus `component`, the smallest key reachable; isolated nodes are their own."""
    roots = component_roots(edges)
    return nodes.join(roots, nodes[key] == roots["node"], "left").withColumn("component", F.coalesce("root", F.col(key))).drop("node", "root")


def mask_redundant(entities: DataFrame, reference_hits: DataFrame, internal_hits: DataFrame, key: str, resolution: str, day: str) -> DataFrame:
    """entities plus status and cluster. First those with a hit in the reference sets are masked
    (MASK_REFERENCE, with the best hit); the rest is clustered by its internal hits, and of each
    cluster only the representative is evaluated (EVALUATE, else MASK_INTERNAL)."""
    best = best_hits(reference_hits, ["query"], ["target"]).select(F.col("query").alias(key), F.col("target").alias("match"))
    left = entities.join(best, key, "left_anti")
    mine = left.select(F.col(key).alias("k"))
    inner = internal_hits.join(mine, F.col("query") == F.col("k"), "left_semi").join(mine, F.col("target") == F.col("k"), "left_semi")
    named = number_components(components(left, inner.select(F.col("query").alias("a"), F.col("target").alias("b")), key), "component")
    chosen = representatives(named, "component", resolution, day, key).select("component", F.col(key).alias("representative"))
    kept = named.join(chosen, "component").withColumns({"status": F.when(F.col(key) == F.col("representative"), "EVALUATE").otherwise("MASK_INTERNAL"), "match": F.when(F.col(key) != F.col("representative"), F.col("representative"))}).drop("component", "representative")
    masked = entities.join(best, key).withColumns({"status": F.lit("MASK_REFERENCE"), "cluster_id": F.lit(None).cast("string")})
    return kept.unionByName(masked)


def entry_status(chains: DataFrame, entry: str, chain: str, evaluate: str) -> DataFrame:
    """Entries by their chains' flags: KEEP_ALL, KEEP_PARTIAL or DROP, with both id lists."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col(evaluate))
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col(chain)))), ",")
    status = F.when(ok == n, "KEEP_ALL").when(ok > 0, "KEEP_PARTIAL").otherwise("DROP")
    return chains.groupBy(entry).agg(status.alias("status"), n.alias("total_chains"), ok.alias("evaluate_count"), (n - ok).alias("masked_count"), ids(F.col(evaluate)).alias("evaluate_ids"), ids(~F.col(evaluate)).alias("masked_ids"))


def accept_maps(checks: DataFrame, target: str, **conditions) -> DataFrame:
    """PASS where all rows of a target meet all conditions, else REVIEW with the names of those that
    some row doesn't."""
    flags = [F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]
    got = checks.groupBy(target).agg(*flags)
    reasons = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in conditions]))
    return got.select(target, F.when(F.size(reasons) == 0, "PASS").otherwise("REVIEW").alias("status"), F.array_join(reasons, ";").alias("reasons"))
