"""SimHash near-duplicates: exact pairs of fingerprints within a Hamming radius, by vantage-point trees.

Fingerprints are computed once per document and written; the search works on distinct ones. A
top tree, fitted on a bounded sample, deals every fingerprint to its home shard and, as a guest,
to the shards whose region its ball of the radius crosses. Shards are cut into cells of a bounded
number of home points and guests. Each cell goes on with a tree of its own over its points and
returns links to the smallest member of each local component, never all pairs. The components of
these links are found by rounds of joins over written tables.

Radii that reach a Jaccard similarity of 0.8 are too wide for the triangle inequality to rule out
anything. For these, `similar_texts` grows a forest of vantage-point trees over longer fingerprints:
each has its own vantage points and deals every point to one leaf, without guests, and there are as many
trees as a pair needs to meet in a leaf with the wanted probability. What is near in a leaf is
verified by its shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.operators.graph import component_roots

from .common import bounded, mix64, replacing, shielded, table, without_keys, write_shared

SHARD_POINTS, MIN_DEPTH, MAX_DEPTH, SAMPLE_PER_SHARD = 65_536, 4, 16, 64
LEAF = 64
LANES, SHARD_TEXTS, CELL_TEXTS, RECALL, SPREAD = 4, 16_384, 32_768, 0.995, 4.5
PROBES = 4_096
CHAINS, NEAREST, MARKS_PER_SHINGLE, PAIRS_AT_ONCE, MARKED_PAIRS_AT_ONCE = 2, 8, 4, 250_000, 20_000
_LANES = np.uint64(0x0101010101010101)


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes, of these sizes, the bits set in over half of it; 0 for an empty run.
    Eight bits at a time are counted in the bytes of a word, over pieces of 255 hashes at most."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    pieces = -(-n // 255)
    first = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(first, pieces)
    starts = np.repeat(np.cumsum(n) - n, pieces) + 255 * nth
    bits = np.zeros(len(full), np.uint64)
    for b in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            bits |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + b)
    out[full] = bits
    return out


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of each run of so many words (repeats included), or of all words if there are fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]).tolist()
    starts, h = [0, *ends], xxhash.xxh64_intdigest
    if len(found) <= words:
        return [h(joined, seed)]
    return [h(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)]


@shielded
def fingerprints(docs: DataFrame, text: str = "text", *, words: int = 4, seed: int = 42, name: str = "fingerprint") -> DataFrame:
    """docs plus the 64-bit SimHash of the whole text as a long. Words are runs of anything but
    ASCII white space, A-Z lower-cased. Null, empty and blank texts have fingerprint 0."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        parts: list[int] = []
        done: list[np.ndarray] = []
        sizes: list[int] = []

        def flush() -> None:
            done.append(_majority(np.array(parts, np.uint64), np.array(sizes, np.int64)))
            parts.clear(), sizes.clear()

        for t in texts:
            got = shingle_hashes(t.as_py(), words, seed)
            parts.extend(got)
            sizes.append(len(got))
            if len(parts) > 500_000:
                flush()
        flush()
        return pa.array(np.concatenate(done).view(np.int64))

    return replacing(docs.withColumn("__simhash", run(F.col(text).cast("string"))), **{name: F.col("__simhash")}).drop("__simhash")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _wide_distance(points: np.ndarray, v) -> np.ndarray:
    """Differing bits of points of several words, a row each."""
    return np.bitwise_count(points ^ v).sum(axis=1, dtype=np.int64)


def _cut_at(d: np.ndarray) -> int:
    """The distance m that splits d into d <= m and d > m, both with members; -1 if it can't."""
    m = int(np.sort(d)[(len(d) - 1) // 2])
    if m == d.max():
        m = int(d[d < m].max()) if d.min() < m else -1
    return m


class TopTree:
    """The upper levels: nodes hold a vantage point and a radius, leaves a shard number."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.nodes: list[tuple] = []
        self.shards = 0
        self._grow(np.unique(sample), depth)

    def _grow(self, points: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        m = -1
        if depth and len(points) > 1:
            v = points[(at * 2654435761) % len(points)]
            d = _distance(points, v)
            m = _cut_at(d)
        if m < 0:
            self.nodes[at] = (self.shards,)
            self.shards += 1
        else:
            self.nodes[at] = (v, m, self._grow(points[d <= m], depth - 1), self._grow(points[d > m], depth - 1))
        return at

    def route(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indexes of home points, indexes of guests): each pair within the radius meets
        in a shard where one of the two is at home."""
        todo = [(0, np.arange(len(points)), np.arange(0))]
        while todo:
            node, home, guest = todo.pop()
            if len(self.nodes[node]) == 1:
                yield self.nodes[node][0], home, guest
                continue
            v, m, near, far = self.nodes[node]
            d, g = _distance(points[home], v).astype(int), _distance(points[guest], v).astype(int)
            todo.append((near, home[d <= m], guest[g <= m + radius]))
            todo.append((far, home[d > m], np.concatenate([guest[g > m - radius], home[(d <= m) & (d > m - radius)]])))


class _Forest:
    """Union-find over local indexes, the smallest index of a set its root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        r = self.parent[of]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[of] = r
                return r
            r = up

    def join(self, members: np.ndarray) -> None:
        roots = self.roots(members)
        self.parent[roots] = roots.min()


def local_roots(points: np.ndarray, home: np.ndarray, radius: int, leaf: int = LEAF, among_home: bool = True) -> np.ndarray:
    """For sorted distinct points the index of the smallest point each is connected to, over the
    pairs within the radius that have a member at home (or, not among_home, just one). Branches
    that the triangle inequality rules out, and those whose points are all connected already, are
    not entered."""
    forest, rng = _Forest(len(points)), np.random.default_rng(len(points))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, guest = todo.pop()
        everyone = np.concatenate([own, guest])
        if not len(own) or len(everyone) < 2 or not (among_home or len(guest)):
            continue
        roots = forest.roots(everyone)
        if (roots == roots[0]).all():
            continue
        d = None
        if len(own) > leaf:
            v = own[rng.integers(len(own))]
            every = _distance(points[everyone], points[v]).astype(int)
            forest.join(everyone[every <= radius])
            d, g = every[: len(own)], every[len(own) :]
            m = _cut_at(d)
        if d is None or m < 0:
            mine, others = points[own][:, None], everyone if among_home else guest
            step = max(1, 2 * PAIRS_AT_ONCE // len(own))
            for at in range(0, len(others), step):
                some = others[at : at + step]
                row, col = np.nonzero(_distance(mine, points[some][None, :]) <= radius)
                other = own[row] != some[col]
                row, col = row[other], col[other]
                cuts = np.flatnonzero(np.diff(row)) + 1
                for r, c in zip(row[np.concatenate([[0], cuts])] if len(row) else (), np.split(col, cuts), strict=False):
                    forest.join(np.append(some[c], own[r]))
            continue
        near = own[d <= m]
        over = near[d[d <= m] > m - radius] if among_home else near[:0]
        todo.append((near, guest[g <= m + radius]))
        todo.append((own[d > m], np.concatenate([guest[g > m - radius], over])))
    return forest.roots(np.arange(len(points)))


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _cells(dealt: DataFrame, shard_points: int) -> DataFrame:
    """Rows (shard, fp, home) plus the cells (a, k) they go to: home points in chunks `a`, and each
    chunk with one chunk after another of what it has to meet. Guests' chunks have the numbers
    from 0; the chunk's own pairs are found where k is 0. After them come the later home chunks,
    as guests."""
    sizes = dealt.groupBy("shard").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / shard_points)).cast("int").alias(c)
    met = dealt.join(F.broadcast(sizes.select("shard", chunks("h"), chunks("g"))), "shard")  # a row for each leaf of the top tree
    met = met.withColumn("c", F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("h")).otherwise(F.col("g"))).cast("int"))
    cell = lambda a, k, home: F.struct(a.cast("int").alias("a"), k.cast("int").alias("k"), F.lit(home).alias("home"))
    first = F.sequence(F.lit(0), F.col("h") - 1)
    as_home = F.transform(F.sequence(F.lit(0), F.col("g") + F.col("h") - F.col("c") - 2), lambda k: cell(F.col("c"), k, True))
    later = F.transform(F.filter(first, lambda a: a < F.col("c")), lambda a: cell(a, F.col("g") - 1 + F.col("c") - a, False))
    as_guest = F.transform(first, lambda a: cell(a, F.col("c"), False))
    return met.select("shard", "fp", F.explode(F.when(F.col("home"), F.concat(as_home, later)).otherwise(as_guest)).alias("x")).select("shard", "fp", "x.*")


def links(points: DataFrame, radius: int = 4, *, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(a, b) with b < a, for a frame of one distinct long column `fp`: their components are
    those of all pairs within the radius. No task gets more than about twice shard_points."""
    n = points.count()
    depth = min(MAX_DEPTH, max(MIN_DEPTH, math.ceil(math.log2(max(1, n / shard_points)))))
    sample = points.orderBy(F.xxhash64("fp")).limit(SAMPLE_PER_SHARD << depth).collect()
    tree = TopTree(np.array([r[0] for r in sample], np.int64).view(np.uint64), depth)
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for shard, home, guest in shared.value.route(fps.view(np.uint64), radius):
                at = np.concatenate([home, guest])
                if len(at):
                    yield pa.record_batch({"shard": np.full(len(at), shard, np.int32), "fp": fps[at], "home": np.arange(len(at)) < len(home)})

    def search(group: pa.Table) -> pa.Table:
        fps = _unsigned(group["fp"])
        order = np.argsort(fps)
        fps, home = fps[order], group["home"].to_numpy(zero_copy_only=False)[order]
        roots = local_roots(fps, home, radius, among_home=group["k"][0].as_py() == 0)
        moved = np.flatnonzero(roots != np.arange(len(fps)))
        return pa.table({"a": fps[moved].view(np.int64), "b": fps[roots[moved]].view(np.int64)})

    dealt = write_shared(points.mapInArrow(deal, "shard int, fp bigint, home boolean"), "simhash-dealt")
    return _cells(dealt, shard_points).groupBy("shard", "a", "k").applyInArrow(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", *, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of docs: its key, fingerprint (16 hex digits) and component_id.

    Fingerprints link at `radius` or fewer differing bits, component_id is the smallest key
    reachable. Texts without words have fingerprint 0 and link like any other. Rows of null key
    belong to their component but never name it (null if none of its rows has a key).
    Repeated rows stay.
    """
    seen = write_shared(fingerprints(docs.select(F.col(key), F.col(text)), text, words=words, seed=seed, name="__fp").select(F.col(key).alias("key"), F.col("__fp").alias("fp")), "simhash")
    first = write_shared(seen.groupBy("fp").agg(F.min("key").alias("first")), "simhash-distinct")
    roots = component_roots(links(first.select("fp"), radius))
    classed = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = classed.join(classed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return seen.join(named, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose key is not the smallest of their near-duplicate component.
    Rows of null key stay: nothing names them. Rows that repeat the smallest key stay."""
    return without_keys(docs, near_duplicates(docs, text, key, **options).filter(F.col("component_id") != F.col(key)), key)


def _shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words, seed), np.uint64))


_F = [f"f{i}" for i in range(LANES)]


def _profiles(docs: DataFrame, text: str, words: int, seed: int) -> DataFrame:
    """docs plus `p`: of the set of shingles a 64-bit name, its size, and LANES SimHash fingerprints."""
    names = ["sig", "n", *_F]

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in names) + ">")
    def run(texts: pa.Array) -> pa.Array:
        done: list[list[np.ndarray]] = []
        sets: list[np.ndarray] = []
        sigs: list[int] = []

        def flush() -> None:
            sizes = np.array([len(x) for x in sets], np.int64)
            every = np.concatenate([*sets, np.zeros(0, np.uint64)])
            lanes = [_majority(mix64(every, i) if i else every, sizes).view(np.int64) for i in range(LANES)]
            done.append([np.array(sigs, np.uint64).view(np.int64), sizes, *lanes])
            sets.clear(), sigs.clear()

        waiting = 0
        for t in texts:
            sets.append(_shingle_set(t.as_py(), words, seed))
            sigs.append(xxhash.xxh64_intdigest(sets[-1].tobytes(), seed))
            waiting += len(sets[-1])
            if waiting > 500_000:
                flush()
                waiting = 0
        flush()
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], names=names)

    return docs.withColumn("p", run(F.col(text).cast("string")))


def differing_bits(similarity: float) -> float:
    """The share of SimHash bits in which two sets of about equal size and that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


class ForestTree:
    """A vantage-point tree over points of several words, a row each: of a node's sample those at most as
    far from a random one as the median go to one side, the rest to the other."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth, self.rng = depth, rng
        self.points: list[np.ndarray] = []
        self.cuts: list[int] = []
        self.sides: list[tuple[int, int]] = []
        self._grow(sample, depth)
        self.vantage, self.cut, self.side = np.array(self.points), np.array(self.cuts), np.array(self.sides)
        del self.points, self.cuts, self.sides, self.rng

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        at, m = len(self.cuts), -1
        v = sample[self.rng.integers(len(sample))]
        if depth and len(sample) > 1:
            d = _wide_distance(sample, v)
            m = _cut_at(d)
        self.points.append(v), self.cuts.append(m), self.sides.append((at, at))
        if m >= 0:
            self.sides[at] = (self._grow(sample[d <= m], depth - 1), self._grow(sample[d > m], depth - 1))
        return at

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point; leaves lead to themselves."""
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            far = _wide_distance(points, self.vantage[at]) > self.cut[at]
            at = self.side[at, far.astype(np.int64)]
        return at


def forest(sample: np.ndarray, depth: int, similarity: float, seed: int) -> list[ForestTree]:
    """As many trees as points of the sample need to meet partners of that similarity (as many random
    bits turned) in a leaf with probability RECALL. Where even twice as many as even splits would
    need are too few, as among points that lie closer than such partners, trees are less deep."""
    rng, p = np.random.default_rng(seed), differing_bits(similarity)
    points = sample[rng.integers(len(sample), size=PROBES)]
    turned = np.packbits(rng.random((PROBES, 64 * sample.shape[1])) < p, axis=1).view(np.uint64)
    partners, together = points ^ turned, 1 - math.acos(1 - 2 * p) / math.pi
    for d in range(depth, 0, -1):
        trees, apart = [], np.ones(PROBES, bool)
        while len(trees) < 2 * math.log(1 - RECALL) / math.log(1 - together**d):
            trees.append(ForestTree(sample, d, rng))
            apart[apart] = trees[-1].leaves(points[apart]) != trees[-1].leaves(partners[apart])
            if apart.mean() <= 1 - RECALL:
                return trees
    return [ForestTree(sample, 0, rng)]


def _sampled(lanes: list[np.ndarray], positions: np.ndarray) -> np.ndarray:
    """The bits at these positions of the lanes, as one number."""
    out = np.zeros(len(lanes[0]), np.uint64)
    for p in positions.tolist():
        out = out << np.uint64(1) | lanes[p >> 6] >> np.uint64(p & 63) & np.uint64(1)
    return out


def marks_of(shingles: np.ndarray) -> bytes:
    """A bit map of a set of hashes by their low bits, of a power of two of bits, at least 64 and
    MARKS_PER_SHINGLE for each hash."""
    size = max(64, 1 << math.ceil(math.log2(max(1, MARKS_PER_SHINGLE * len(shingles)))))
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Marks:
    """The bit maps of a group of sets, and what they say of pairs: a bit that only one of two has is a
    hash that the other hasn't."""

    def __init__(self, maps: list[bytes], n: np.ndarray):
        self.n, self.size = n, np.array([len(m) for m in maps], np.int64)
        self.at, self.folded = np.zeros(len(maps), np.int64), {}
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            self.at[own] = np.arange(len(own))
            self.folded[size, size] = np.frombuffer(b"".join(maps[i] for i in own), np.uint64).reshape(len(own), -1)

    def rows(self, points: np.ndarray, own: int, size: int) -> np.ndarray:
        """The maps, `own` bytes long, of these points, folded to `size` bytes."""
        if (own, size) not in self.folded:
            wide = self.folded[own, own]
            self.folded[own, size] = np.bitwise_or.reduce(wide.reshape(len(wide), own // size, -1), axis=1)
        return self.folded[own, size][self.at[points]]

    def possible(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether pairs can be that similar: no pair that is, is ruled out."""
        out = np.zeros(len(a), bool)
        sizes = self.size[a] * (1 << 40) + self.size[b]
        for both in np.unique(sizes).tolist():
            own, other = divmod(both, 1 << 40)
            same = np.flatnonzero(sizes == both)
            for at in range(0, len(same), MARKED_PAIRS_AT_ONCE):
                i = same[at : at + MARKED_PAIRS_AT_ONCE]
                x, y = self.rows(a[i], own, min(own, other)), self.rows(b[i], other, min(own, other))
                common = np.minimum(self.n[a[i]] - np.bitwise_count(x & ~y).sum(axis=1), self.n[b[i]] - np.bitwise_count(y & ~x).sum(axis=1))
                out[i] = common * (1 + similarity) >= similarity * (self.n[a[i]] + self.n[b[i]]) - 1e-9
        return out


def near_pairs(n: np.ndarray, comp: np.ndarray, lanes: list[np.ndarray], home: np.ndarray, similarity: float, most: int, marks: Marks | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home point, other point, whether the home point has more): of each home point the `most`
    nearest others of other components that can be so similar by their sizes, fingerprints and marks."""
    p = differing_bits(similarity)
    one, every = (math.floor(b * p + SPREAD * math.sqrt(b * p * (1 - p))) for b in (64, 64 * LANES))
    order = np.argsort(n, kind="stable")
    size, comp, lanes = n[order], comp[order], [x[order] for x in lanes]
    own, out, at = np.flatnonzero(home[order]), [], 0
    low = np.searchsorted(size, np.ceil(size[own] * similarity - 1e-9))
    high = np.searchsorted(size, np.floor(size[own] / similarity + 1e-9), "right")
    while at < len(own):
        stop = at + max(1, PAIRS_AT_ONCE // max(1, int(high[at] - low[at])))
        while stop > at + 1 and (min(stop, len(own)) - at) * int(high[min(stop, len(own)) - 1] - low[at]) > 2 * PAIRS_AT_ONCE:
            stop = at + (stop - at) // 2
        mine, first, last = own[at:stop], low[at], high[min(stop, len(own)) - 1]
        row, col = np.nonzero(_distance(lanes[0][mine][:, None], lanes[0][None, first:last]) <= one)
        a, b = mine[row], col + first
        good = (comp[a] != comp[b]) & (b >= low[at + row]) & (b < high[at + row])
        a, b = a[good], b[good]
        d = sum(_distance(x[a], x[b]).astype(np.int64) for x in lanes)
        good = d <= every
        if marks is not None:
            good[good] = marks.possible(order[a[good]], order[b[good]], similarity)
        a, b, d = a[good], b[good], d[good]
        by = np.lexsort((b, d, a))
        a, b = a[by], b[by]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        more = np.bincount(a, minlength=len(n))[a] > most
        out.append((order[a[nth < most]], order[b[nth < most]], more[nth < most]))
        at = stop
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([*x]) for x in zip((none, none, none.astype(bool)), *out, strict=True))


def _chained(points: DataFrame, similarity: float, seed: int) -> DataFrame:
    """(a, b): pairs of near neighbours in a few orders of the points by a shuffle of their bits.
    Large groups of near copies are chained by these before their members are compared."""
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(64 * LANES)[:64] for _ in range(CHAINS)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = [batch[c].to_numpy().view(np.uint64) for c in _F]
            for i, positions in enumerate(orders):
                rest = {c: batch[c] for c in ("sig", "n", *_F)}
                yield pa.record_batch({"turn": np.full(batch.num_rows, i, np.int32), "at": _sampled(lanes, positions).view(np.int64), **rest})

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            part = pa.Table.from_batches([batch] if last is None else [last, batch])
            last = batch.slice(max(0, batch.num_rows - 1))
            turn, sig, n = (part[c].to_numpy() for c in ("turn", "sig", "n"))
            lanes = [_unsigned(part[c]) for c in _F]
            p = differing_bits(similarity)
            near = sum(_distance(x[1:], x[:-1]).astype(np.int64) for x in lanes) <= 64 * LANES * p + SPREAD * math.sqrt(64 * LANES * p * (1 - p))
            near &= (turn[1:] == turn[:-1]) & (np.minimum(n[1:], n[:-1]) >= similarity * np.maximum(n[1:], n[:-1]) - 1e-9)
            yield pa.record_batch({"a": sig[1:][near], "b": sig[:-1][near]})

    columns = "sig bigint, n bigint, " + ", ".join(f"{c} bigint" for c in _F)
    dealt = points.mapInArrow(deal, f"turn int, at bigint, {columns}").repartitionByRange("turn", "at").sortWithinPartitions("turn", "at")
    return dealt.mapInArrow(chain, "a bigint, b bigint")


def _candidates(points: DataFrame, total: int, similarity: float, most: int, seed: int, shard_texts: int, cell_texts: int) -> DataFrame:
    """(a, b, more) by name, see near_pairs, of points (sig, n, comp, f0..., and marks if they are to be
    used). In each tree of the forest (`turn`) a point goes to the leaf (`shard`) that its distances from
    the vantage points lead to. Of a leaf with more than cell_texts the points are cut into chunks, and
    what isn't of the leaf's largest component meets them all."""
    depth = max(0, math.ceil(math.log2(max(1, total / shard_texts))))
    sample = points.select(*_F).orderBy(F.xxhash64(*_F)).limit(SAMPLE_PER_SHARD << depth).toArrow()
    sample = np.column_stack([_unsigned(sample[c]) for c in _F])
    shared = points.sparkSession.sparkContext.broadcast(forest(sample, depth, similarity, seed + 1) if len(sample) else [])

    def keys(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.column_stack([batch[c].to_numpy().view(np.uint64) for c in _F])
            for i, tree in enumerate(shared.value):
                yield pa.record_batch({"turn": np.full(batch.num_rows, i, np.int32), "shard": tree.leaves(fps), **{c: batch[c] for c in names}})

    where, columns = "turn int, shard bigint", tuple(c for c in ("sig", "n", "comp", *_F, "marks") if c in points.columns)
    few = points.mapInArrow(lambda b: keys(b, ("comp",)), f"{where}, comp bigint")
    hot = write_shared(few.groupBy("turn", "shard").count().filter(F.col("count") > cell_texts), "simhash-hot")
    dealt = points.mapInArrow(lambda b: keys(b, columns), f"{where}, " + ", ".join(f"{c} {'binary' if c == 'marks' else 'bigint'}" for c in columns))
    if hot.isEmpty():
        dealt = dealt.withColumns({"c": F.lit(0), "k": F.lit(0), "home": F.lit(True)})
    else:
        sizes = few.join(hot.drop("count"), ["turn", "shard"], "left_semi").groupBy("turn", "shard", "comp").count()
        sizes = sizes.groupBy("turn", "shard").agg(F.sum("count").alias("all"), F.max(F.struct("count", "comp")).alias("top"))
        chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / cell_texts)).cast("int")
        sizes = write_shared(sizes.select("turn", "shard", chunks(F.col("all")).alias("h"), chunks(F.col("all") - F.col("top.count")).alias("g"), F.col("top.comp").alias("top")), "simhash-hot-sizes")
        met = dealt.join(sizes, ["turn", "shard"], "left").withColumns({"h": F.coalesce("h", F.lit(1)), "g": F.coalesce("g", F.lit(1))})
        met = met.withColumns({"mine": F.pmod(F.xxhash64("sig"), F.col("h")).cast("int"), "guest": F.pmod(F.xxhash64("sig", F.lit(1)), F.col("g")).cast("int")})
        cell = lambda c, k, home: F.struct(c.cast("int").alias("c"), k.cast("int").alias("k"), F.lit(home).alias("home"))
        at_home = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: cell(F.col("mine"), k, True))
        away = F.transform(F.filter(F.sequence(F.lit(0), F.col("h") - 1), lambda c: (c != F.col("mine")) & ~F.col("comp").eqNullSafe(F.col("top"))), lambda c: cell(c, F.col("guest"), False))
        dealt = met.select("turn", "shard", *columns, F.explode(F.concat(at_home, away)).alias("x")).select("turn", "shard", *columns, "x.*")

    def search(group: pa.Table) -> pa.Table:
        sig, n = group["sig"].to_numpy(), group["n"].to_numpy()
        marks = Marks(group["marks"].to_pylist(), n) if "marks" in columns else None
        a, b, more = near_pairs(n, group["comp"].to_numpy(), [_unsigned(group[c]) for c in _F], group["home"].to_numpy(zero_copy_only=False), similarity, most, marks)
        return pa.table({"a": sig[a], "b": sig[b], "more": more})

    return dealt.groupBy("turn", "shard", "c", "k").applyInArrow(search, "a bigint, b bigint, more boolean")


def _verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, text: str, key: str, words: int, seed: int, similarity: float) -> DataFrame:
    """The pairs of names whose sets of shingles have at least that Jaccard similarity, exactly."""

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
        return pa.array(out, pa.bool_())

    named = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    sets = _of_texts(named, points, docs, text, key, "s", lambda t: _shingle_set(t, words, seed).tobytes())
    a, b = (sets.select(F.col("sig").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").filter(alike("sa", "sb")).select("a", "b")


def _of_texts(named: DataFrame, points: DataFrame, docs: DataFrame, text: str, key: str, column: str, make) -> DataFrame:
    """(sig, column) of the named points, written: what `make` makes of their texts."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([make(t.as_py()) for t in texts], pa.binary())

    wanted = points.join(named, "sig").select("sig", F.col("key").alias("__key"), F.col("row").alias("__row"))
    own = docs.select(F.col(key).alias("__k"), F.col(text).cast("string").alias("t"))
    met = own.join(bounded(write_shared(wanted, "simhash-wanted")), (F.col("__k") == F.col("__key")) & F.xxhash64("t").eqNullSafe(F.col("__row")))
    return write_shared(met.dropDuplicates(["sig"]).select("sig", run("t").alias(column)), f"simhash-{column}")


def similar_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", *, words: int = 5, similarity: float = 0.8, seed: int = 42, nearest: int = NEAREST, shard_texts: int = SHARD_TEXTS, cell_texts: int = CELL_TEXTS) -> DataFrame:
    """(key, component_id), a row for each row of docs with a key: texts link when the sets of their
    runs of so many words have at least that Jaccard similarity; component_id is the smallest key
    reachable. Null, empty and blank texts have the empty set, and are alike.

    Equal sets are one point with a SimHash of 256 bits. Points meet in the leaves of vantage-point
    trees, of as many as a pair of the least similarity needs to meet with probability
    RECALL; nearer pairs meet more surely. What is near by size and bits is verified
    exactly. Chains of neighbours connect large groups of near copies first; then each point
    names its `nearest` near points of other components. What has more near points goes round
    again, with bit maps of its shingles that rule out most pairs of less similarity, with the
    components so far and four times as many, until none has more: a pair can only be missing if
    both its points had more.
    """
    told = _profiles(docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t")), "t", words, seed)
    seen = write_shared(told.select("key", F.xxhash64(F.col("t").cast("string")).alias("row"), "p.*"), "simhash-profiles")
    first = seen.groupBy("sig").agg(F.min(F.struct("key", "row")).alias("m"), *[F.first(c).alias(c) for c in ("n", *_F)])
    points = write_shared(first.select("sig", "m.key", "m.row", "n", *_F), "simhash-points")
    verify = lambda pairs: write_shared(_verified(pairs, points, docs, text, key, words, seed, similarity), "simhash-links")
    ordered = (F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
    tried = write_shared(_chained(points, similarity, seed).select(*ordered).distinct(), "simhash-chains")
    roots, total, live = component_roots(verify(tried)), points.count(), points.select("sig", "n", *_F)
    while True:
        met = live.join(roots, live["sig"] == roots["node"], "left").withColumn("comp", F.coalesce("root", "sig")).drop("node", "root")
        near = _candidates(write_shared(met, "simhash-live"), total, similarity, nearest, seed, shard_texts, cell_texts)
        near = near.groupBy(*ordered).agg(F.max(F.col("more") & (F.col("a") > F.col("b"))).alias("more_a"), F.max(F.col("more") & (F.col("a") < F.col("b"))).alias("more_b"))
        near = write_shared(near, "simhash-pairs")
        new = write_shared(near.select("a", "b").join(tried, ["a", "b"], "left_anti"), "simhash-new")
        if not new.isEmpty():
            good = verify(new)
            roots = component_roots(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(good.select("a", "b")))
            tried = tried.unionByName(new)
        again = write_shared(near.filter("more_a").select(F.col("a").alias("sig")).unionByName(near.filter("more_b").select(F.col("b").alias("sig"))).distinct(), "simhash-again")
        if again.isEmpty():
            break
        if "marks" not in live.columns:
            marked = _of_texts(again, points, docs, text, key, "marks", lambda t: marks_of(_shingle_set(t, words, seed)))
            live = live.join(marked, "sig")
        else:
            live = live.join(again, "sig", "left_semi")
        nearest *= 4
    classed = write_shared(points.join(roots, points["sig"] == roots["node"], "left").select("sig", "key", F.coalesce("root", "sig").alias("root")), "simhash-classed")
    named = classed.join(classed.groupBy("root").agg(F.min("key").alias("component_id")), "root").select("sig", "component_id")
    return seen.join(named, "sig").select(F.col("key").alias(key), "component_id")


def drop_similar(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose key is not the smallest of their component by similar_texts.
    Rows of null key stay, and rows that repeat the smallest key."""
    return without_keys(docs, similar_texts(docs, text, key, **options).filter(F.col("component_id") != F.col(key)), key)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id reachable by links of four differing bits at most."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
