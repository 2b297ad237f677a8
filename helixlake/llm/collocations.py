"""Collocations: phrases of two words and more whose words come together more often than apart.

Texts become chunks of word numbers once. Which phrases can be frequent is found by length: phrases of
n words whose both parts of n - 1 words can be are counted by COUNTED_BITS of their hash, and a bitmap
of bounded size keeps the hashes that come often enough (false alarms only cost time). Then all
phrases that pass are counted by their words. A chunk's phrases are counted before they are shuffled.

The counts are then a stream in prefix order (by first word, second word, ...; shorter first), cut
into ranges of bounded size. Going through it in step with its own shorter phrases gives every
phrase the counts of all its beginnings, and every phrase the largest count of its extensions to
the right. The same stream in suffix order (by last word, the one before, ...) gives the counts of
endings and the extensions to the left. Neither pass looks anything up by hash; phrases that are
still open where a range begins are handed to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, mix64, table, write_shared

MIN_COUNT, MAX_WORDS, TOP, CONTAINED = 30, 4, 2_000, 80
CHUNK_WORDS, SLICE_BYTES, RANGE_ROWS, MOST_BITS, COUNTED_BITS, ROWS_AT_ONCE, DOCS_AT_ONCE = 1_000_000, 4 << 20, 200_000, 28, 40, 100_000, 2_000
_GAP = b"\xff"  # in no text
_BREAKS = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " + _GAP * 10)
_CHUNK = "langs array<string>, totals array<bigint>, lang_of binary, words array<binary>, ids binary, own bigint"


class Chunks:
    """Word numbers of texts, from 1; 0 stands between pieces. A chunk leaves the last `reach` numbers
    to the next one, so that a phrase is counted once, where it starts."""

    def __init__(self, reach: int):
        self.reach = reach
        self._clear([])

    def _clear(self, tail: list[tuple[str, bytes]]) -> None:
        self.numbers: dict[tuple[str, bytes], int] = {}
        self.parts, self.size = [], 0
        self._push([self._number(*x) if x[1] else 0 for x in tail])

    def _number(self, lang: str, word: bytes) -> int:
        return self.numbers.setdefault((lang, word), len(self.numbers) + 1)

    def _push(self, ids: list[int]) -> None:
        self.parts.append(np.array(ids, np.int32))
        self.size += len(ids)

    def add(self, lang: str, text: bytes) -> Iterator[dict]:
        """The chunks that this text completes."""
        plain, at, numbers = text.lower().translate(_BREAKS), 0, self.numbers
        while at < len(plain):
            end = plain.find(b" ", at + SLICE_BYTES) if len(plain) > at + SLICE_BYTES else -1
            part = plain[at:] if end < 0 else plain[at:end]
            at += len(part)
            found = part.replace(_GAP, b" \xff ").split()
            self._push([0 if w == _GAP else numbers.setdefault((lang, w), len(numbers) + 1) for w in found])
            if self.size >= CHUNK_WORDS:
                yield self.take(self.reach)
                numbers = self.numbers
        self._push([0])

    def take(self, left: int = 0) -> dict:
        ids, spelled = np.concatenate(self.parts), list(self.numbers)
        langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in spelled))}
        lang_of, own = np.array([langs[lang] for lang, _ in spelled], np.int32), len(ids) - left
        totals = np.bincount(lang_of[ids[:own][ids[:own] > 0] - 1], minlength=len(langs)).tolist()
        row = {"langs": list(langs), "totals": totals, "lang_of": lang_of.tobytes(), "words": [w for _, w in spelled], "ids": ids.tobytes(), "own": own}
        self._clear([spelled[i - 1] if i else ("", b"") for i in ids[len(ids) - left :].tolist()])
        return row


def chunks(docs: DataFrame, text: str, lang: str, max_words: int) -> DataFrame:
    """The written chunks of all texts, each a row group of its own: a task that reads them holds one."""
    schema = pa.schema([("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("lang_of", pa.binary()), ("words", pa.list_(pa.binary())), ("ids", pa.binary()), ("own", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Chunks(max_words - 1)
        for batch in batches:
            for name, spelled in zip(batch[0].to_pylist(), batch[1].cast(pa.binary()), strict=True):
                for row in held.add(name, spelled.as_py()):
                    yield pa.RecordBatch.from_pylist([row], schema=schema)
        if held.numbers:
            yield pa.RecordBatch.from_pylist([held.take()], schema=schema)

    named = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    with batches_of(docs.sparkSession, DOCS_AT_ONCE):
        return write_shared(docs.select(named, F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(run, _CHUNK), "phrase-chunks", group_rows=1)


def _word_hashes(langs: list[str], lang_of: np.ndarray, words: list[bytes]) -> np.ndarray:
    seeds = [xxhash.xxh64_intdigest(name.encode()) for name in langs]
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[i]) for i, w in zip(lang_of.tolist(), words, strict=True)), np.uint64, len(words))


def _next_hash(begun: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all its words but the last, and that of the last."""
    with np.errstate(over="ignore"):
        return mix64(begun * np.uint64(0x9E3779B97F4A7C15) + word)


class Known:
    """A bitmap of hashes: says of each that was put in that it's known, and of few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def known(frequent: DataFrame) -> Known:
    """The bitmap of a table of hashes (h): at least 16 bits a hash up to 2 ** MOST_BITS bits, the most
    that is broadcast; of more hashes it lets more others pass."""
    size = 1 << min(MOST_BITS, max(15, (16 * max(1, frequent.count()) - 1).bit_length()))
    bit = F.col("h").bitwiseAND(size - 1) + 1
    rows = frequent.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for bucket, part in rows:  # 4,096 bytes each
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, np.uint8)
    return Known(bits)


class Chunk:
    """A chunk's phrases: where they start and their hashes, by length."""

    def __init__(self, row: dict):
        self.ids, self.own, self.words = np.frombuffer(row["ids"], np.int32), row["own"], row["words"]
        self.langs, self.lang_of = row["langs"], np.frombuffer(row["lang_of"], np.int32)
        word = np.concatenate([np.zeros(1, np.uint64), _word_hashes(self.langs, self.lang_of, self.words)])
        self.hashes = word[self.ids]

    def phrases(self, filters: list[Known], every: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, starts, hashes) for n from 1 to the number of filters, of phrases that they know; then, or
        with `every` only, of phrases with one word more that begin and end with known ones."""
        at, n_ids = np.flatnonzero(self.ids), len(self.ids)
        whole = self.hashes[at]
        for n, knows in enumerate(filters, 1):
            good = knows(whole)
            at, whole = at[good], whole[good]
            if not every:
                yield n, at[at < self.own], whole[at < self.own]
            if n < len(filters) or every:
                ends = np.zeros(n_ids + 1, bool)
                ends[at] = True
                longer = (at + n < n_ids) & ends[np.minimum(at + 1, n_ids)]
                at, whole = at[longer], whole[longer]
                last = self.ids[at + n] > 0
                at = at[last]
                whole = _next_hash(whole[last], self.hashes[at + n])
        if every:
            own = at < self.own
            yield len(filters) + 1, at[own], whole[own]

    def counted(self, n: int, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n, a): phrases of n words by what they say."""
        key = self.ids[starts].astype(np.int64)
        for k in range(1, n):
            _, key = np.unique(key, return_inverse=True)
            key = key.astype(np.int64) * (len(self.words) + 1) + self.ids[starts + k]
        _, at, counts = np.unique(key, return_index=True, return_counts=True)
        spelled, langs = pa.array(self.words, pa.binary()), pa.array(self.langs, pa.string())
        for begin in range(0, len(at), ROWS_AT_ONCE):
            first = starts[at[begin : begin + ROWS_AT_ONCE]]
            parts = [spelled.take(pa.array(self.ids[first + k] - 1)) for k in range(n)]
            phrase = pc.binary_join_element_wise(*parts, b" ") if n > 1 else parts[0]
            lang = langs.take(pa.array(self.lang_of[self.ids[first] - 1]))
            yield pa.record_batch({"lang": lang, "phrase": phrase, "n": np.full(len(first), n, np.int32), "a": counts[begin : begin + ROWS_AT_ONCE].astype(np.int64)})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch[c][i].as_py() for c in batch.schema.names}


def likely(parts: DataFrame, filters: list[Known], min_count: int) -> Known:
    """The bitmap of phrases with one word more than there are filters, by hashes that come often enough."""
    shared = parts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for *_, hashes in Chunk(row).phrases(shared.value, True):
                found, counts = np.unique(hashes & np.uint64((1 << COUNTED_BITS) - 1), return_counts=True)
                for at in range(0, len(found), ROWS_AT_ONCE):
                    yield pa.record_batch({"h": found[at : at + ROWS_AT_ONCE].view(np.int64), "a": counts[at : at + ROWS_AT_ONCE].astype(np.int64)})

    # chunks are counted already; most hashes come once, and a map of them on this side would only take memory
    counted = parts.drop("totals").mapInArrow(run, "h bigint, a bigint").repartition("h").groupBy("h").agg(F.sum("a").alias("a"))
    with batches_of(parts.sparkSession, 1):  # a chunk
        frequent = write_shared(counted.filter(F.col("a") >= min_count).select("h"), "likely-phrases")
    shared.destroy()
    return known(frequent)


def frequent_phrases(docs: DataFrame, text: str, lang: str, max_words: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """All phrases (lang, phrase, n, a) of at most max_words words that come min_count times at least, and the
    words of each language (lang, n)."""
    parts = chunks(docs, text, lang, max_words)
    filters: list[Known] = []
    for _ in range(max_words):
        filters.append(likely(parts, filters, min_count))
    shared = parts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            for n, starts, _ in chunk.phrases(shared.value, False):
                yield from chunk.counted(n, starts)

    found = parts.drop("totals").mapInArrow(run, "lang string, phrase binary, n int, a bigint")
    found = found.groupBy("lang", "phrase", "n").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)
    every = found.withColumn("phrase", F.col("phrase").cast("string"))
    totals = parts.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    with batches_of(parts.sparkSession, 1):
        every = write_shared(every, "phrases")
    shared.destroy()
    return every, totals


def lockstep(rows: DataFrame, order: list[str], heads: str, longest: str) -> DataFrame:
    """rows plus `heads`, the counts of each phrase's beginnings in this order (of 1, 2, ... words less than
    its own), and `longest`, the largest count of a phrase with one more word at the end.

    `order` names the language and then the words, first to last; missing words are null. All beginnings
    of a phrase have to be among the rows. Ranges have about RANGE_ROWS rows."""
    n_words = len(order) - 1
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    cut = rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    cut = write_shared(cut.withColumn("lent", F.lit(False)), "phrase-order")
    # the beginnings of each range's first phrase stand in ranges before it
    first = cut.groupBy("part").agg(F.min(F.struct(*order)).alias("f")).select(F.col("part").alias("to"), "f.*")
    cuts = F.array(*[F.struct(*[F.col(w) if i <= k else F.lit(None).cast("string").alias(w) for i, w in enumerate(order)]) for k in range(1, n_words)])
    begun = first.select("to", F.explode(cuts).alias("h")).select("to", "h.*").distinct()
    same = [F.col(f"h.{w}").eqNullSafe(F.col(f"r.{w}")) for w in order]
    met = cut.alias("r").join(F.broadcast(begun.alias("h")), _all(same)).filter(F.col("to") > F.col("part"))
    lent = met.select(*[F.col("to").alias(c) if c == "part" else F.lit(True).alias(c) if c == "lent" else F.col(f"r.{c}").alias(c) for c in cut.columns])

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[(w, "ascending") for w in order], null_placement="at_start"))
        n, a = group["n"].to_numpy(), group["a"].to_numpy()
        at, more = np.arange(len(n)), np.zeros(len(n), np.int64)
        sizes = n.astype(np.int64) - 1
        ends = np.cumsum(sizes)
        flat = np.zeros(int(sizes.sum()), np.int64)
        for k in range(1, n_words):
            last = np.maximum.accumulate(np.where(n == k, at, -1))
            longer = np.flatnonzero(n > k)
            flat[(ends - sizes)[longer] + k - 1] = a[last[longer]]
            one = longer[n[longer] == k + 1]
            np.maximum.at(more, last[one], a[one])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
        return group.append_column(heads, lists).append_column(longest, pa.array(more))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    out = write_shared(cut.unionByName(lent).groupBy("part").applyInArrow(run, f"{schema}, `{heads}` array<bigint>, `{longest}` bigint"), "phrase-passed")
    # what later ranges found for the phrases lent to them: a few rows for each range
    told = out.filter("lent").groupBy(*order).agg(F.max(longest).alias("told")).alias("t")
    mine = out.filter("NOT lent").alias("m").join(F.broadcast(told), _all([F.col(f"m.{w}").eqNullSafe(F.col(f"t.{w}")) for w in order]), "left")
    return mine.select(*[F.col(f"m.{c}").alias(c) for c in (*rows.columns, heads)], F.greatest(f"m.{longest}", F.coalesce("t.told", F.lit(0))).alias(longest))


def scored(rows: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) by the lowest-scoring cut, from the counts of beginnings and endings."""
    score = "cast(2000000 * cast(a as decimal(19,0)) div (cast(heads[k - 1] as decimal(19,0)) + cast(tails[n - k - 1] as decimal(19,0))) as bigint)"
    cuts = F.expr(f"transform(sequence(1, n - 1), k -> struct({score} as score, k, heads[k - 1] as l, tails[n - k - 1] as r))")
    return rows.withColumn("c", F.array_min(cuts)).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best `top` phrases of 2 to max_words words that
    come min_count times at least.

    Texts are lower-cased (A-Z) and cut at `.,;:!?` and line ends into pieces, and at spaces and tabs into
    words; phrases lie within a piece. a is a phrase's count. A cut after k words gives l and r, the
    counts of both parts, and the score 2000000 * a div (l + r); of all cuts the one of the lowest
    score counts, of equal ones that of smallest k. Phrases with a longer frequent phrase around
    them that has at least `contained` per cent of their count are left out. Equal scores rank by
    count, then by the phrase's bytes. n counts the language's words.

    Null languages are `und`; null and empty texts have no words. Repeated rows count again. Any length of
    text or word is taken. All columns but the two are ignored, whatever their names.
    """
    every, totals = frequent_phrases(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")), "text", "lang", max_words, min_count)
    words = [f"w{k}" for k in range(1, max_words + 1)]
    spelled = F.split("phrase", " ", -1)
    rows = every.select("lang", "phrase", "n", "a", *[F.get(spelled, F.lit(k)).alias(w) for k, w in enumerate(words)])
    rows = lockstep(rows, ["lang", *words], "heads", "right")
    back = [f"b{k}" for k in range(1, max_words + 1)]
    turned = F.reverse(F.array_compact(F.array(*words)))
    rows = rows.select("lang", "phrase", "n", "a", "heads", "right", *[F.get(turned, F.lit(k)).alias(b) for k, b in enumerate(back)])
    rows = lockstep(rows, ["lang", *back], "tails", "left").filter("n > 1")
    big = "decimal(38,0)"
    rows = rows.filter(F.greatest("left", "right").cast(big) * 100 < F.col("a").cast(big) * contained)
    best = scored(rows)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", nth.cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, by language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest([ws[i:i + k - 1] for i in range(1, len(ws) - k + 2)]) AS ph FROM w, (VALUES (1), (2), (3), (4)) t(k)),
c AS (SELECT lang, k, ph, count(*)::BIGINT AS a FROM g GROUP BY ALL),
f AS (SELECT * FROM c WHERE a >= 30),
s AS (SELECT x.lang, x.k, x.ph, x.a, cut, l.a AS l, r.a AS r, ((2000000 * x.a::HUGEINT) // (l.a + r.a))::BIGINT AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1) x
      JOIN f l ON l.lang = x.lang AND l.ph = x.ph[1:cut] JOIN f r ON r.lang = x.lang AND r.ph = x.ph[cut + 1:x.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
e AS (SELECT lang, sub, max(a) AS most FROM (
        SELECT lang, a, unnest(flatten([[ph[i:j] for j in range(i + 1, k + 1) if j - i + 1 < k] for i in range(1, k)])) AS sub FROM f WHERE k > 2) GROUP BY ALL),
q AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, b.a, l, r, score FROM b LEFT JOIN e ON e.lang = b.lang AND e.sub = b.ph
      WHERE NOT coalesce(100 * most >= 80 * b.a, false)),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang)
SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM q JOIN n USING (lang) QUALIFY rank <= 2000
"""
