"""Ranked lexical search by MaxScore with bounds of pairs of terms.

Documents are cut into shards; each is a row of the written index with postings whose impacts are
computed when it is built, and the largest impact of every term in every block of documents. For
the most frequent terms, whose postings are most of the work, the index also has intersection
lists: for each pair of them the blocks in which some document has both, with the largest joint
score there. In a block, or a shard, two terms together add no more than the larger of their own
maxima and their joint one, which is less than the sum of both.

A query pairs its frequent terms so as to save most. Blocks whose bound is under the k-th best
score so far are skipped without a look at their postings. Terms whose joint bound stays under it
aren't essential: only the others' postings make candidates, and of these only the ones that the
rest can still lift near it are completed. Scores are whole numbers, so bounds are safe and sums
don't depend on order.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, shared_folder, table, write_shared
from .search import Top, _ranges, _terms_of, build_index, document_frequencies

K, PAIR_TERMS, BLOCK_BITS, SEED_BLOCKS, BLOCKS_AT_ONCE = 20, 128, 7, 2, 16
QUERIES_PER_BLOCK, TERMS_PER_BLOCK, DOCS_AT_ONCE, SHARD_WORDS = 4_000, 1_500_000, 2_000, 1_000_000
_INTS = {"docs": np.int64, "terms": np.uint64, "counts": np.int32, "posting_docs": np.int32, "impacts": np.int32, "run_counts": np.int32, "run_block": np.int32, "run_size": np.int32, "run_max": np.int32,
         "hot": np.int32, "pair_a": np.int32, "pair_b": np.int32, "pair_counts": np.int32, "pair_block": np.int32, "pair_max": np.int64}
_ROW = ", ".join(f"{c} binary" for c in _INTS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def with_impacts(row: dict, n_docs: int, n_words: int, hot: np.ndarray, hot_weights: np.ndarray) -> dict:
    """An index row with impacts, block maxima and pair lists, from one with counts."""
    lengths, counts = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["counts"], np.int32)
    doc, tf = np.frombuffer(row["posting_docs"], np.int32), np.frombuffer(row["posting_tf"], np.int32).astype(np.int64)
    terms, size = np.frombuffer(row["terms"], np.uint64), counts.astype(np.int64)
    m = 75 + 25 * lengths * n_docs // max(1, n_words)
    impact = (1_000_000_000 * tf) // (1_000 * tf + 12 * m[doc])
    owner, block = np.repeat(np.arange(len(size)), size), doc >> BLOCK_BITS
    new = np.ones(len(doc), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    blocks, width = (len(lengths) >> BLOCK_BITS) + 1, 1 << BLOCK_BITS
    place = np.searchsorted(terms, hot)
    there = np.flatnonzero(terms[np.minimum(place, max(0, len(terms) - 1))] == hot) if len(terms) else np.zeros(0, np.int64)
    dense = np.zeros((len(there), blocks * width), np.int64)
    starts = np.cumsum(size) - size
    for i, h in enumerate(there):
        own = slice(starts[place[h]], starts[place[h]] + size[place[h]])
        dense[i, doc[own]] = hot_weights[h] * impact[own]
    held = np.zeros(dense.shape, bool)
    for i, h in enumerate(there):
        held[i, doc[starts[place[h]] : starts[place[h]] + size[place[h]]]] = True
    first, second, per, pair_block, pair_max = [], [], [], [], []
    for i in range(len(there) - 1):
        both = held[i + 1 :] & held[i]
        joint = np.where(both, dense[i + 1 :] + dense[i], -1).reshape(len(both), blocks, width).max(axis=2)
        pair, where = np.nonzero(joint >= 0)
        first.append(np.full(len(both), there[i]))
        second.append(there[i + 1 :])
        per.append(np.bincount(pair, minlength=len(both)))
        pair_block.append(where)
        pair_max.append(joint[pair, where])
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    values = {
        "docs": np.frombuffer(row["docs"], np.int64), "terms": terms, "counts": counts, "posting_docs": doc, "impacts": impact, "run_counts": np.bincount(owner[at], minlength=len(size)),
        "run_block": block[at], "run_size": np.diff(np.append(at, len(doc))), "run_max": np.maximum.reduceat(impact, at) if len(at) else at,
        "hot": there, "pair_a": flat(first), "pair_b": flat(second), "pair_counts": flat(per), "pair_block": flat(pair_block), "pair_max": flat(pair_max),
    }
    return {c: values[c].astype(kind).tobytes() for c, kind in _INTS.items()}


class Queries:
    """A block of queries: their distinct terms with weights, and by query the terms' numbers and times."""

    def __init__(self, rows: list, n_docs: int, hot: np.ndarray):
        self.ids = [r[0] for r in rows]
        flat = np.array([t for r in rows for t in r[1]], np.int64).view(np.uint64)
        df = np.array([d for r in rows for d in r[3]], np.int64)
        self.terms, first, self.number = np.unique(flat, return_index=True, return_inverse=True)
        self.weights = np.array([weight(n_docs, d) for d in df[first].tolist()], np.int64)
        self.times = np.array([n for r in rows for n in r[2]], np.int64)
        self.offsets = np.cumsum([0] + [len(r[1]) for r in rows])
        at = {t: i for i, t in enumerate(hot.tolist())}
        self.hot = np.array([at.get(t, -1) for t in self.terms.tolist()], np.int64)


class Shard:
    """A shard of the index, for the terms of a block of queries. `scored` counts postings read and looked up."""

    def __init__(self, row: dict, queries: Queries, n_hot: int, pairs: bool = True):
        got = {c: np.frombuffer(row[c], kind) for c, kind in _INTS.items()}
        self.docs, self.doc, self.impact = got["docs"], got["posting_docs"], got["impacts"]
        self.blocks, self.scored = (len(self.docs) >> BLOCK_BITS) + 1, 0
        terms = got["terms"]
        at = np.minimum(np.searchsorted(terms, queries.terms), max(0, len(terms) - 1))
        self.term = np.where(terms[at] == queries.terms, at, -1) if len(terms) else np.full(len(queries.terms), -1)
        self.size = got["counts"].astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.runs = got["run_counts"].astype(np.int64)
        self.run_start = np.cumsum(self.runs) - self.runs
        self.run_size, self.run_block, self.run_max = got["run_size"].astype(np.int64), got["run_block"], got["run_max"].astype(np.int64)
        self.run_at = np.cumsum(self.run_size) - self.run_size
        self.weights, self.hot = queries.weights, queries.hot
        # joint maxima of pairs of frequent terms: by block, and of the whole shard; -1 where no document has both
        self.pairs = pairs
        self.list_of = np.full((n_hot, n_hot), -1, np.int64)
        per = got["pair_counts"].astype(np.int64)
        self.list_of[got["pair_a"], got["pair_b"]] = np.arange(len(per))
        self.list_of[got["pair_b"], got["pair_a"]] = np.arange(len(per))
        self.list_size, self.list_at = per, np.cumsum(per) - per
        self.list_block, self.list_max = got["pair_block"], got["pair_max"]
        self.joint = np.full(len(per) + 1, -1, np.int64)
        np.maximum.at(self.joint, np.repeat(np.arange(len(per)), per), self.list_max)

    def _matched(self, hot: np.ndarray, times: np.ndarray, top: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Pairs of a query's terms, no term twice, those that save most first: (i, j, list, saving)."""
        own = np.flatnonzero(hot >= 0)
        if not self.pairs or len(own) < 2:
            return []
        i, j = (own[x] for x in np.triu_indices(len(own), 1))
        lists = self.list_of[hot[i], hot[j]]
        fewer = np.minimum(times[i], times[j])
        joint = self.joint[lists]
        bound = np.where(joint >= 0, fewer * joint + (times[i] - fewer) * top[i] * weights[i] + (times[j] - fewer) * top[j] * weights[j], 0)
        alone_i, alone_j = times[i] * weights[i] * top[i], times[j] * weights[j] * top[j]
        saving = alone_i + alone_j - np.maximum(bound, np.maximum(alone_i, alone_j))
        free, out = np.ones(len(hot), bool), []
        for p in np.argsort(-saving, kind="stable"):
            if saving[p] <= 0:
                break
            if free[i[p]] and free[j[p]]:
                free[[i[p], j[p]]] = False
                out.append((int(i[p]), int(j[p]), int(lists[p]), int(saving[p])))
        return out

    def search(self, numbers: np.ndarray, times: np.ndarray, top: Top) -> None:
        """Offer every document that can be among the k best."""
        here = self.term[numbers] >= 0
        numbers, times = numbers[here], times[here]
        term, weights, hot = self.term[numbers], self.weights[numbers], self.hot[numbers]
        if not len(term):
            return
        runs = _ranges(self.run_start[term], self.runs[term])
        owner = np.repeat(np.arange(len(term)), self.runs[term])
        factor = times * weights
        most = np.zeros((len(term), self.blocks), np.int64)  # what each term adds at most in each block
        block = self.run_block[runs]
        most[owner, block] = factor[owner] * self.run_max[runs]
        impact_top = np.maximum.reduceat(self.run_max[runs], np.cumsum(self.runs[term]) - self.runs[term])
        limit = factor * impact_top
        order = np.argsort(limit, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        matched = self._matched(hot, times, impact_top, weights)
        saved, slack = np.zeros(len(order), np.int64), []
        for i, j, at, saving in matched:
            later = max(place[i], place[j])
            saved[later] += saving
            joint, fewer = np.full(self.blocks, -1, np.int64), min(times[i], times[j])
            if at >= 0:
                own = slice(self.list_at[at], self.list_at[at] + self.list_size[at])
                joint[self.list_block[own]] = self.list_max[own]
            rest = [most[x] // times[x] * (times[x] - fewer) for x in (i, j)]
            both = np.where(joint >= 0, fewer * joint + rest[0] + rest[1], 0)
            slack.append((later, np.maximum(0, most[i] + most[j] - np.maximum(both, np.maximum(most[i], most[j])))))
        reach = np.cumsum(limit[order]) - np.cumsum(saved)  # bounds of the first terms together
        rest = np.zeros((len(order) + 1, self.blocks), np.int64)  # what the first terms add at most in each block
        np.cumsum(most[order], axis=0, out=rest[1:])
        for later, s in slack:
            rest[later + 1 :] -= s
        bound = rest[-1]
        ready = np.argsort(-bound, kind="stable")
        ready = ready[bound[ready] > 0]
        at, step = 0, SEED_BLOCKS
        while at < len(ready) and bound[ready[at]] >= top.least:
            chosen = ready[at : at + step]
            chosen = chosen[bound[chosen] >= top.least]
            few = int(np.searchsorted(np.maximum.accumulate(reach), top.least, "left"))
            if few == len(order):
                return
            wanted = np.zeros(self.blocks, bool)
            wanted[chosen] = True
            own = wanted[block] & (place[owner] >= few)
            total = self._sum(runs[own], factor[owner[own]])
            self._complete(total, order[:few], term, factor, rest, top)
            at, step = at + step, BLOCKS_AT_ONCE

    def _sum(self, runs: np.ndarray, factors: np.ndarray) -> np.ndarray:
        size = self.run_size[runs]
        postings = _ranges(self.run_at[runs], size)
        self.scored += len(postings)
        out = np.zeros(self.blocks << BLOCK_BITS, np.int64)
        np.add.at(out, self.doc[postings], np.repeat(factors, size) * self.impact[postings])
        return out

    def _complete(self, total: np.ndarray, light: np.ndarray, term: np.ndarray, factor: np.ndarray, rest: np.ndarray, top: Top) -> None:
        """Offer the documents that essential terms found: the other terms are looked up, those that add most
        first, for documents that can still get in."""
        found = np.flatnonzero(total)
        block, total = found >> BLOCK_BITS, total[found]
        for i in range(len(light), -1, -1):
            near = total + rest[i][block] >= top.least
            found, block, total = found[near], block[near], total[near]
            if not i or not len(found):
                break
            t = term[light[i - 1]]
            own = slice(self.start[t], self.start[t] + self.size[t])
            docs = self.doc[own]
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            total = total + np.where(docs[at] == found, factor[light[i - 1]] * self.impact[own][at], 0)
            self.scored += len(found)
        top.offer(total, self.docs[found])


def impact_index(docs: DataFrame, text: str = "text", key: str = "doc_id", *, pair_terms: int = PAIR_TERMS, **sizes) -> tuple[DataFrame, DataFrame, int, np.ndarray]:
    """The written index, all terms' document frequencies, the number of documents with a term, and the
    terms that have pair lists (at most pair_terms, those in most documents)."""
    spark = docs.sparkSession
    with batches_of(spark, DOCS_AT_ONCE):
        plain = build_index(docs, text, key, **({"shard_words": SHARD_WORDS} | sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [np.frombuffer(x.as_py(), np.int64) for x in batch[0]]
            yield pa.record_batch({"n": pa.array([int((x > 0).sum()) for x in lengths], pa.int64()), "l": pa.array([int(x.sum()) for x in lengths], pa.int64())})

    n_docs, n_words = plain.select("lengths").mapInArrow(count, "n bigint, l bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    with batches_of(spark, 1):  # a shard
        frequencies = write_shared(document_frequencies(plain), "term-frequencies")
    often = frequencies.orderBy(F.desc("df"), "term").limit(pair_terms).collect()
    hot = np.array([r["term"] for r in often], np.int64).view(np.uint64)
    weights = np.array([weight(n_docs, r["df"]) for r in often], np.int64)
    schema = pa.schema([(c, pa.binary()) for c in _INTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = with_impacts({c: batch[c][i].as_py() for c in batch.schema.names}, n_docs, n_words, hot, weights)
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    with batches_of(spark, 1):
        return write_shared(plain.drop("n_docs", "n_words").mapInArrow(run, _ROW), "impact-index", group_rows=1), frequencies, n_docs, hot


def query_terms(queries: DataFrame, frequencies: DataFrame, text: str, key: str) -> DataFrame:
    """(query, terms, times, dfs): the terms of each query that some document has, with their repeats."""

    @F.arrow_udf("array<struct<term:bigint,times:bigint>>")
    def split(texts: pa.Array) -> pa.Array:
        found = [np.unique(_terms_of(t), return_counts=True) for t in texts]
        ends = np.cumsum([0] + [len(t) for t, _ in found])
        flat = [np.concatenate([x[i] for x in found]).view(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["term", "times"]))

    asked = queries.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query"), F.explode(split(F.col(text).cast("string"))).alias("t"))
    terms = asked.groupBy("query", F.col("t.term").alias("term")).agg(F.sum("t.times").alias("times"))
    met = terms.join(frequencies, "term")
    rows = met.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "times", "df"))).alias("t"))
    return rows.select("query", F.col("t.term").alias("terms"), F.col("t.times").alias("times"), F.col("t.df").alias("dfs"))


def rank(docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id", query_text: str = "text", query_key: str = "item_id", *, k: int = K, pair_terms: int = PAIR_TERMS, **sizes) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of queries the k documents that score best.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; the whole texts
    count on both sides, and a query's repeats count again. A term's weight is
    floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is 75 + 25 * n * N div L, and a term adds its
    weight times 1000000000 * tf div (1000 * tf + 12 * m). Only scores above 0 are hits; equal ones rank
    by doc_id, and rows that repeat a doc_id are hits of their own. Null and empty texts neither find
    nor are found, and don't count in N. Queries that share an id are one query of all their
    terms. Rows of null id are left out on both sides. Other columns are ignored.
    """
    index, frequencies, n_docs, hot = impact_index(docs, text, key, pair_terms=pair_terms, **sizes)
    asked = write_shared(query_terms(queries, frequencies, query_text, query_key), "ranked-queries")
    n, terms = asked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-n // QUERIES_PER_BLOCK), -(-(terms or 0) // TERMS_PER_BLOCK))
    path, kind = f"{shared_folder(docs.sparkSession)}/ranked-hits-{uuid.uuid4().hex}", "item_id bigint, doc_id bigint, score bigint"
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()  # one block
        shared = docs.sparkSession.sparkContext.broadcast(Queries(sorted(map(tuple, rows)), n_docs, hot))
        with batches_of(docs.sparkSession, 1):
            index.mapInArrow(_searcher(shared, len(hot), k), kind).write.mode("append").parquet(path)
        shared.destroy()
    found = docs.sparkSession.read.schema(kind).parquet(path)
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searcher(shared, n_hot: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        tops = [Top(k) for _ in queries.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({c: batch[c][i].as_py() for c in batch.schema.names}, queries, n_hot)
                for q, top in enumerate(tops):
                    own = slice(queries.offsets[q], queries.offsets[q + 1])
                    shard.search(queries.number[own], queries.times[own], top)
        sizes = [len(t.docs) for t in tops]
        if sum(sizes):
            yield pa.record_batch({"item_id": np.repeat(np.array(queries.ids, np.int64), sizes), "doc_id": np.concatenate([t.docs for t in tops]), "score": np.concatenate([t.scores for t in tops])})

    return run


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
l AS (SELECT doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN s GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark) GROUP BY ALL),
c AS (SELECT item_id, p.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN l ON l.doc_id = p.doc_id CROSS JOIN s GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= 20
"""
