"""Line dedup: lines held by several documents go from all of them but one.

The line keys that stand in several documents are counted in Spark and dealt to shards by hash. Each shard gets a
minimal perfect hash and three arrays at its indexes: the key's fingerprint, how many documents
hold it (saturating), and the largest doc_id among them. Documents probe these arrays: where the
index is small (its size is measured) every task holds all of it, beyond that the line hashes
travel to their shard. Both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mph
from .common import table, write_shared

BROADCAST_BYTES = 64 << 20
SHARD_KEYS = 500_000
PROBE_ROWS = 200_000
_MADE = "__line_dedup_"  # columns made on the way start with this
_INDEX = "shard int, shards int, sizes binary, words binary, fingerprints binary, counts binary, keepers binary"


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _hashes(text: str | None, min_chars: int) -> tuple[list[bytes], list[int]]:
    """The lines of a text and, line by line, the key's signed 64-bit hash, 0 if it is short."""
    lines, out = (text or "").encode("utf-8", "surrogatepass").split(b"\n"), []
    for line in lines:
        key = line_key(line)
        long_ = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars
        h = (xxhash.xxh64_intdigest(key) or 1) if long_ else 0
        out.append(h - (1 << 64) if h >> 63 else h)
    return lines, out


def _lists(rows: list) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int64()))


def _distinct_hashes(min_chars: int):
    @F.arrow_udf("array<bigint>")
    def run(text: pa.Array) -> pa.Array:
        return _lists([list({h for h in _hashes(t.as_py(), min_chars)[1] if h}) for t in text])

    return run


def line_index(docs: DataFrame, text: str = "text", key: str = "doc_id", *, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """One row per shard of the keys that several distinct documents hold (or as few as min_docs);
    whether they are enough is for the probe to say. A document that repeats a line, or a repeated
    row, counts once; rows of null key don't count."""
    held = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.explode(_distinct_hashes(min_chars)(F.col(text).cast("string"))).alias("h"))
    counted = held.groupBy("h").agg(F.countDistinct("k").alias("n"), F.max("k").alias("keeper")).filter(F.col("n") >= min(2, min_docs))
    counted = write_shared(counted, "line-counts")
    shards = max(1, -(-counted.count() // SHARD_KEYS))

    def build(group: pa.Table) -> pa.Table:
        keys = group["h"].to_numpy().view(np.uint64)
        sizes, words = mph.build(keys)
        at = np.argsort(mph.PerfectHash(sizes, words).index(keys))
        part = [group["shard"][0].as_py(), shards, sizes.tobytes(), words.tobytes(), keys[at].tobytes(), np.minimum(group["n"].to_numpy()[at], 65535).astype(np.uint16).tobytes(), group["keeper"].to_numpy()[at].tobytes()]
        names = [f.split()[0] for f in _INDEX.split(", ")]
        return pa.table({n: pa.array([v], pa.int32() if n[:5] == "shard" else pa.binary()) for n, v in zip(names, part, strict=True)})

    dealt = counted.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    return write_shared(dealt.groupBy("shard").applyInArrow(build, _INDEX), "line-index")


class Shard:
    """The arrays of one shard."""

    def __init__(self, sizes: bytes, words: bytes, fingerprints: bytes, counts: bytes, keepers: bytes):
        self.hash = mph.PerfectHash(np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64))
        self.fingerprints, self.counts, self.keepers = np.frombuffer(fingerprints, np.uint64), np.frombuffer(counts, np.uint16), np.frombuffer(keepers, np.int64)

    def probe(self, hashes: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the index holds each hash min_docs times, and the doc_id that keeps it."""
        if not len(self.keepers):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = self.hash.index(hashes.view(np.uint64))
        hit = (at >= 0) & (self.fingerprints[at] == hashes.view(np.uint64)) & (self.counts[at] >= min(min_docs, 65535))
        return hit, np.where(hit, self.keepers[at], 0)


def _cut(lines: list[bytes], hashes: list[int], drop: set) -> tuple[str, int, int]:
    kept = [line for line, h in zip(lines, hashes, strict=True) if h not in drop]
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)


_CUT = pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
_CUT_DDL = "struct<kept:string,n_lines:bigint,n_dropped:bigint>"


def _probing(parts: Broadcast, shards: int, min_docs: int, min_chars: int):
    """The narrow way: every task holds the whole index."""
    cache: dict = {}

    @F.arrow_udf(_CUT_DDL)
    def run(text: pa.Array, doc: pa.Array) -> pa.Array:
        if "index" not in cache:
            cache["index"] = {s: Shard(*rest) for s, *rest in parts.value}
        split = [_hashes(t.as_py(), min_chars) for t in text]
        ids = doc.to_pylist()
        flat = np.array([h for _, hs in split for h in hs], np.int64)
        hit, keeper = np.zeros(len(flat), bool), np.zeros(len(flat), np.int64)
        home = np.mod(flat, shards)
        for s, shard in cache["index"].items():
            own = np.flatnonzero((home == s) & (flat != 0))
            hit[own], keeper[own] = shard.probe(flat[own], min_docs)
        out, at = [], 0
        for (lines, hs), d in zip(split, ids, strict=True):
            drop = {hs[i] for i in np.flatnonzero(hit[at : at + len(hs)]) if keeper[at + i] != d}
            at += len(hs)
            out.append(dict(zip(("kept", "n_lines", "n_dropped"), _cut(lines, hs, drop), strict=True)))
        return pa.array(out, _CUT)

    return run


def _routed(docs: DataFrame, index: DataFrame, shards: int, text: str, key: str, min_docs: int, min_chars: int) -> DataFrame:
    """The wide way: (document, hash) pairs meet the one shard that can hold the hash, in chunks
    of bounded size; what must go travels back to the document."""
    @F.arrow_udf("array<boolean>")
    def probe(ks: pa.Array, hs: pa.Array, sizes: pa.Array, words: pa.Array, fps: pa.Array, counts: pa.Array, keepers: pa.Array) -> pa.Array:
        out = []
        for i in range(len(hs)):
            shard = Shard(*(a[i].as_py() for a in (sizes, words, fps, counts, keepers)))
            ids, hashes = ks[i].values, hs[i].values.to_numpy()
            hit, keeper = shard.probe(hashes, min_docs)
            mine = np.array([k == v for k, v in zip(ids.to_pylist(), keeper, strict=True)], bool)
            out.append(hit & ~mine)
        return pa.array(out, pa.list_(pa.bool_()))

    pairs = docs.select(F.col(key).cast("long").alias("k"), F.explode(_distinct_hashes(min_chars)(F.col(text).cast("string"))).alias("h"))
    pairs = write_shared(pairs, "line-pairs")
    chunks = max(1, -(-pairs.count() // (PROBE_ROWS * shards)))
    dealt = pairs.groupBy(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("k", "h"), F.lit(chunks)).alias("chunk"))
    dealt = dealt.agg(F.collect_list(F.struct("k", "h")).alias("rows")).join(index, "shard")
    found = dealt.select("rows", probe(F.col("rows.k"), F.col("rows.h"), *(F.col(c) for c in ("sizes", "words", "fingerprints", "counts", "keepers"))).alias("drop"))
    found = found.select(F.explode(F.arrays_zip("rows", "drop")).alias("x")).filter("x.drop").select("x.rows.k", "x.rows.h")
    gone = found.groupBy("k").agg(F.collect_set("h").alias("gone")).select(F.col("k").alias(f"{_MADE}k"), F.col("gone").alias(f"{_MADE}gone"))

    @F.arrow_udf(_CUT_DDL)
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        rows = [_cut(*_hashes(t.as_py(), min_chars), set(g.as_py() or ())) for t, g in zip(texts, gone, strict=True)]
        return pa.array([dict(zip(("kept", "n_lines", "n_dropped"), r, strict=True)) for r in rows], _CUT)

    met = docs.join(gone, F.col(key).cast("long").eqNullSafe(F.col(f"{_MADE}k")), "left")
    return met.withColumn(f"{_MADE}cut", cut(F.col(text).cast("string"), F.col(f"{_MADE}gone"))).drop(f"{_MADE}k", f"{_MADE}gone")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", *, min_docs: int = 3, min_chars: int = 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with `text` cut to the lines that stay, plus n_lines (before) and n_dropped.

    Lines whose key has min_chars code points or more and stands in min_docs distinct documents
    stay only in the largest key holding it, with all its repeats there. Null and empty texts
    are one empty line. Rows that share a key are one document. A row of null key never counts
    and never keeps a repeated line. Input columns named n_lines or n_dropped are replaced.
    Lines are told apart by 64 bits of hash. Column names are found in any case. The key has to be an
    integer, or text that spells one; other text keys are an error of the cast.
    """
    names = {c.lower(): c for c in docs.columns}
    text, key = names[text.lower()], names[key.lower()]
    index = line_index(docs, text, key, min_docs=min_docs, min_chars=min_chars)
    size = index.agg(F.count("*"), F.max("shards"), F.sum(sum(F.length(c) for c in index.columns[2:]))).first()
    shards = size[1] or 1
    if (size[2] or 0) <= broadcast_bytes:
        parts = docs.sparkSession.sparkContext.broadcast([(r[0], *map(bytes, r[2:])) for r in index.collect()])  # of the size just measured
        met = docs.withColumn(f"{_MADE}cut", _probing(parts, shards, min_docs, min_chars)(F.col(text).cast("string"), F.col(key).cast("long")))
    else:
        met = _routed(docs, index, shards, text, key, min_docs, min_chars)
    out = {c: F.col(f"{_MADE}cut.kept") if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")}
    return met.select(*[v.alias(n) for n, v in out.items()], F.col(f"{_MADE}cut.n_lines").alias("n_lines"), F.col(f"{_MADE}cut.n_dropped").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold, kept in the largest doc_id only; digests of what is left of each document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (r.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (r.key IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN r ON r.key = k.key GROUP BY doc_id
"""
