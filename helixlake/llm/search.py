"""Exact top-k search by BM25 over an inverted index with block-max WAND pruning.

Documents are cut into shards of bounded size, each a row of the written index: its documents'
keys and lengths, its sorted terms, and their postings. Global statistics (documents, average
length, document frequencies) come from the index. Queries are taken in blocks of bounded size,
one after another, each broadcast and forgotten once its hits are written.

In every shard the postings of a query's terms are runs, one for each term and block of documents,
each with its largest score. Terms that many of a shard's documents have are bounded by document
instead, together, by a matrix product for many queries at once. A cursor goes through the blocks in
the order of documents: the next pivot is the first block ahead where the largest scores of the
terms that have a run there, and the largest bound of the frequent terms, add up to the k-th best
score that the task has seen, and all blocks before it are skipped. Pivots are found and scored
some at a time. Within them frequent terms are only looked up for documents that others lift near
it. Each task returns k rows a query, and these are merged exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, table, write_shared
from .decontaminate import text_words

K, K1, B, MICRO = 10, 1.2, 0.75, 1_000_000
SHARD_DOCS, SHARD_WORDS, DOC_BLOCK_BITS, SEED_BLOCKS, PIVOTS_AT_ONCE = 8_192, 4_000_000, 7, 3, 64
QUERIES_PER_BLOCK, TERMS_PER_BLOCK, DOCS_AT_ONCE, QUERIES_AT_ONCE, FREQUENT, MOST_FREQUENT = 4_000, 1_500_000, 2_000, 128, 32, 512
OVER = 1.001  # more than all rounding of 32-bit sums of MOST_FREQUENT scores
_INDEX = "docs binary, lengths binary, terms binary, counts binary, posting_docs binary, posting_tf binary, n_docs bigint, n_words bigint"


def index_row(ids: list[int], words: list[np.ndarray]) -> dict:
    """One shard: postings sorted by term and document."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    terms, term = np.unique(flat, return_inverse=True)
    pairs, tf = np.unique(term.astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    counts = np.bincount(pairs // max(1, len(ids)), minlength=len(terms))
    return {
        "docs": np.array(ids, np.int64).tobytes(), "lengths": lengths.tobytes(), "terms": terms.tobytes(), "counts": counts.astype(np.int32).tobytes(),
        "posting_docs": (pairs % max(1, len(ids))).astype(np.int32).tobytes(), "posting_tf": tf.astype(np.int32).tobytes(), "n_docs": len(ids), "n_words": int(lengths.sum()),
    }


def _terms_of(text) -> np.ndarray:
    return text_words(text.as_py())


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", *, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The written index: a row for each shard. Rows of null key can't be named and aren't indexed."""
    schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("bigint") else pa.binary()) for f in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, n = [], [], 0
        for batch in batches:
            for k, t in zip(batch[0].to_pylist(), batch[1], strict=True):
                w = _terms_of(t)
                if ids and (len(ids) >= shard_docs or n + len(w) > shard_words):
                    yield pa.RecordBatch.from_pylist([index_row(ids, words)], schema=schema)
                    ids, words, n = [], [], 0
                ids.append(k)
                words.append(w)
                n += len(w)
        if ids:
            yield pa.RecordBatch.from_pylist([index_row(ids, words)], schema=schema)

    return write_shared(docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, _INDEX), "search-index", group_rows=1)


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards; terms are their 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch["terms"], batch["counts"], strict=True):
                yield pa.record_batch({"term": np.frombuffer(terms.as_py(), np.int64), "n": np.frombuffer(counts.as_py(), np.int32).astype(np.int64)})

    return index.select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Queries:
    """A block of queries: their distinct terms, each with its idf, and by query the terms' numbers."""

    def __init__(self, rows: list, n_docs: int):
        self.ids = [r[0] for r in rows]
        flat = np.array([t for r in rows for t in r[1]], np.int64).view(np.uint64)
        df = np.array([d for r in rows for d in r[2]], np.float64)
        self.terms, first, self.number = np.unique(flat, return_index=True, return_inverse=True)
        self.idf = np.log(1 + (n_docs - df[first] + 0.5) / (df[first] + 0.5))
        self.offsets = np.cumsum([0] + [len(r[1]) for r in rows])


class Top:
    """The k best (score, document) of a query so far: higher scores first, then smaller keys."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this can't get in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, docs = np.concatenate([self.scores, scores[good]]), np.concatenate([self.docs, docs[good]])
            best = np.lexsort((docs, -scores))[: self.k]
            self.scores, self.docs = scores[best], docs[best]


class Shard:
    """A shard's postings with the scores they add, for the terms of a block of queries."""

    def __init__(self, row: dict, queries: Queries, average: float):
        self.docs = np.frombuffer(row["docs"], np.int64)
        lengths, terms = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["terms"], np.uint64)
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        at = np.minimum(np.searchsorted(terms, queries.terms), max(0, len(terms) - 1))
        hit = terms[at] == queries.terms if len(terms) else np.zeros(len(queries.terms), bool)
        # only the postings of the block's terms are kept, term after term
        self.row = np.where(hit, np.cumsum(hit) - 1, -1)
        begin = (np.cumsum(counts) - counts)[at[hit]]
        size = counts[at[hit]]
        take = _ranges(begin, size)
        self.doc = np.frombuffer(row["posting_docs"], np.int32)[take].astype(np.int64)
        tf = np.frombuffer(row["posting_tf"], np.int32)[take].astype(np.float64)
        norm = K1 * (1 - B + B * lengths / max(average, 1e-9))
        self.add = np.rint(MICRO * np.repeat(queries.idf[hit], size) * (tf * (K1 + 1) / (tf + norm[self.doc]))).astype(np.int64)
        self.weight = self.add.astype(np.float64)  # whole as well; what bincount takes
        self.size, self.start = size, np.cumsum(size) - size
        # runs of postings of one term in one block of documents, and the largest score in each
        owner = np.repeat(np.arange(len(size)), size)
        block = self.doc >> DOC_BLOCK_BITS
        new = np.ones(len(block), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
        self.run_at = np.flatnonzero(new)
        self.run_size = np.diff(np.append(self.run_at, len(block)))
        self.run_block, self.run_owner = block[self.run_at], owner[self.run_at]
        self.run_max = np.maximum.reduceat(self.add, self.run_at) if len(self.add) else np.zeros(0, np.int64)
        runs = np.bincount(owner[self.run_at], minlength=len(size))
        self.runs, self.run_start = runs, np.cumsum(runs) - runs
        self.blocks = (len(self.docs) >> DOC_BLOCK_BITS) + 1
        # rows of frequent terms by document, and no less than these as 32-bit floats
        common = np.flatnonzero(size > len(self.docs) // FREQUENT)
        common = common[np.argsort(-size[common], kind="stable")[:MOST_FREQUENT]]
        self.dense_of = np.full(len(size), -1)
        self.dense_of[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks << DOC_BLOCK_BITS), np.int32)
        for i, t in enumerate(common):
            own = slice(self.start[t], self.start[t] + size[t])
            self.dense[i, self.doc[own]] = self.add[own]
        self.over = self.dense.astype(np.float32) * np.float32(OVER)

    def lifts(self, asked: list[np.ndarray]) -> np.ndarray:
        """For each query what its frequent terms add to every document, or a little more."""
        has = np.zeros((len(asked), len(self.dense)), np.float32)
        for i, terms in enumerate(asked):
            dense = self.dense_of[terms[terms >= 0]]
            has[i, dense[dense >= 0]] = 1
        return has @ self.over

    def _sum(self, postings: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[postings], self.weight[postings], self.blocks << DOC_BLOCK_BITS)

    def search(self, terms: np.ndarray, top: Top, lift: np.ndarray | None = None) -> None:
        """Offer every document that can be among the k best. Scores are whole numbers, so sums
        are exact and bounds are safe. `lift` is the query's row of lifts(), if that is there."""
        terms = terms[terms >= 0]
        if not len(terms):
            return
        lift = self.lifts([terms])[0] if lift is None else lift
        dense = self.dense_of[terms]
        rare, dense = terms[dense < 0], dense[dense >= 0]
        runs = _ranges(self.run_start[rare], self.runs[rare])
        block = self.run_block[runs]
        bound = np.bincount(block, self.run_max[runs], self.blocks) + lift.reshape(self.blocks, -1).max(axis=1)
        # the most promising blocks first, for a good threshold
        waiting = np.ones(self.blocks, bool)
        seeds = np.argsort(-bound, kind="stable")[:SEED_BLOCKS]
        seeds = seeds[bound[seeds] >= top.least]
        waiting[seeds] = False
        if len(seeds):
            self._score(seeds, rare, runs, block, lift, dense, top)
        cursor = 0
        while len(pivots := np.flatnonzero(waiting[cursor:] & (bound[cursor:] >= top.least))[:PIVOTS_AT_ONCE] + cursor):
            self._score(pivots, rare, runs, block, lift, dense, top)
            cursor = int(pivots[-1]) + 1

    def _score(self, pivots: np.ndarray, rare: np.ndarray, runs: np.ndarray, block: np.ndarray, lift: np.ndarray, dense: np.ndarray, top: Top) -> None:
        """Offer the documents of these blocks; frequent terms are looked up last, where they can still matter."""
        chosen = np.zeros(self.blocks, bool)
        chosen[pivots] = True
        own = runs[chosen[block]]
        whole = 2 * len(own) > len(runs)  # then few terms' postings are faster to list than many runs of them
        total = self._sum(_ranges(self.start[rare], self.size[rare]) if whole else _ranges(self.run_at[own], self.run_size[own]))
        near = np.flatnonzero(total.reshape(self.blocks, -1)[pivots] + lift.reshape(self.blocks, -1)[pivots] >= top.least)
        if len(near):
            found = (pivots[near >> DOC_BLOCK_BITS] << DOC_BLOCK_BITS) + (near & ((1 << DOC_BLOCK_BITS) - 1))
            top.offer(total[found].astype(np.int64) + self.dense[np.ix_(dense, found)].sum(axis=0, dtype=np.int64), self.docs[found])


def query_terms(queries: DataFrame, frequencies: DataFrame, text: str, key: str) -> DataFrame:
    """(query, terms, dfs): the distinct terms of each query that some document has."""
    @F.arrow_udf("array<bigint>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(_terms_of(t)).view(np.int64) for t in texts], pa.list_(pa.int64()))

    terms = queries.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query"), F.explode(split(F.col(text).cast("string"))).alias("term")).distinct()
    met = terms.join(frequencies, "term")
    return met.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("t")).select("query", F.col("t.term").alias("terms"), F.col("t.df").alias("dfs"))


def top_k(docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id", *, k: int = K, **sizes) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row of queries the k rows of docs that score best.

    Whole texts on both sides; terms are runs of ASCII letters, digits and non-ASCII bytes, A-Z
    lower-cased, and a query's repeats count once. BM25 with k1 = 1.2, b = 0.75 and
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); what each term adds is rounded to a millionth, so
    scores don't depend on the order of adding. Equal scores rank by key; rows that repeat a
    key are hits of their own. Rows that share no term aren't hits, so null and empty texts neither
    find nor are found. Queries that share a key are one query. Rows of null key are left out.
    """
    with batches_of(docs.sparkSession, DOCS_AT_ONCE):
        index = build_index(docs, text, key, **sizes)
    n_docs, n_words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    with batches_of(docs.sparkSession, 1):  # a shard
        frequencies = write_shared(document_frequencies(index), "search-frequencies")
    asked = write_shared(query_terms(queries, frequencies, text, key), "search-queries")
    n, terms = asked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-n // QUERIES_PER_BLOCK), -(-(terms or 0) // TERMS_PER_BLOCK))
    average, found = (n_words or 0) / max(1, n_docs or 0), None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()  # one block
        shared = docs.sparkSession.sparkContext.broadcast(Queries(sorted(map(tuple, rows)), n_docs or 0))
        hits = index.mapInArrow(_searcher(shared, average, k), "query_id bigint, doc_id bigint, micro bigint")
        with batches_of(docs.sparkSession, 1):
            hits = write_shared(hits, "search-hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("micro"), "doc_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", (F.col("micro") / MICRO).alias("score"))


def _searcher(shared, average: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        tops = [Top(k) for _ in queries.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({n: batch[n][i].as_py() for n in batch.schema.names}, queries, average)
                numbers = shard.row[queries.number]
                asked = np.split(numbers, queries.offsets[1:-1])
                for at in range(0, len(tops), QUERIES_AT_ONCE):
                    some = slice(at, at + QUERIES_AT_ONCE)
                    for terms, top, lift in zip(asked[some], tops[some], shard.lifts(asked[some]), strict=True):
                        shard.search(terms, top, lift)
        sizes = [len(t.docs) for t in tops]
        if sum(sizes):
            yield pa.record_batch({"query_id": np.repeat(np.array(queries.ids, np.int64), sizes), "doc_id": np.concatenate([t.docs for t in tops]), "micro": np.concatenate([t.scores for t in tops])})

    return run


def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for every hundredth document, against all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return top_k(docs, docs.filter(F.col("doc_id") % 100 == 0))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id),
s AS (SELECT count(*) AS n, avg(dl) AS av FROM l),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (
  SELECT q.doc_id AS query_id, p.doc_id,
         sum(round_even(1000000 * ln(1 + (n - df + 0.5) / (df + 0.5)) *
             (tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / av))), 0)::BIGINT) AS micro
  FROM (SELECT DISTINCT doc_id, term FROM p WHERE doc_id % 100 = 0) q JOIN p USING (term) JOIN df USING (term)
  JOIN l ON l.doc_id = p.doc_id CROSS JOIN s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY micro DESC, doc_id) AS rank FROM c)
SELECT query_id, rank, doc_id, (micro / 1000000)::DOUBLE AS score FROM r WHERE rank <= 10
"""
