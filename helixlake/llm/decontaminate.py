"""Benchmark decontamination: passages of documents within an edit distance of benchmark items.

Words are numbers (64-bit hashes). The CGK random walk turns edit distance into Hamming distance:
at step j it reads the word under its pointer and a random function of (j, word) says whether the
pointer goes on. A repetition samples a few steps of the walk as one hash key; windows of
documents, of the items' size and at every word that can start a match, are looked up among the
items' keys. What meets an item in any repetition is verified by exact edit distance.

Walks drift apart with the number of edits, so long items would be lost that way. Each item is also
cut into one piece more than edits are allowed: whatever the edits, one piece stays whole, and
its words are looked up as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, replacing, shielded, table, write_shared

SIMILARITY, REPETITIONS, SAMPLED_STEPS, MIN_WORDS, SEED = 0.8, 24, 2, 5, 20240229
ITEMS_PER_BLOCK, CHARS_PER_BLOCK = 5_000, 4_000_000
MOST_PIECE = 8
LENGTH_STEP, VOCABULARY_BITS, CHUNK_BYTES, PIECE_BYTES = 1.15, 20, 2 << 20, 256 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base, and of its inverse, modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _scripts(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Where letters of scripts without spaces begin (Thai, Lao, Khmer, kana, ideographs), each of which
    is a word; general and ideographic punctuation is taken out of `inside`."""
    lead = np.flatnonzero(data >= 0xE0)
    lead = lead[lead + 2 < len(data)]
    a, b = data[lead], data[lead + 1]
    marks = lead[(a == 0xE2) & (b == 0x80) | (a == 0xE3) & (b == 0x80) | (a == 0xEF) & (b == 0xBC) & (data[lead + 2] < 0x90)]
    for k in range(3):
        inside[marks + k] = False
    three = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & (b >= 0x9E) & (b <= 0x9F) | (a == 0xE3) & (b >= 0x81) | (a > 0xE3) & (a <= 0xE9)
    return lead[three | (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)]


def words_of(data: np.ndarray, offsets: np.ndarray, scripts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts that stand one after another in bytes, and where each text's words
    start (n + 1 entries). Words are runs of ASCII letters, digits and non-ASCII bytes; A-Z are
    lower-cased. With `scripts` typographic marks aren't part of words, and letters of scripts
    without spaces are words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    alone = _scripts(data, inside) if scripts else np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[alone] = True
    after = alone + np.where(data[alone] >= 0xF0, 4, 3)
    after = after[after < n]
    first[after] = inside[after]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, i = np.zeros(len(a), np.uint64), 0
    while i < len(a):  # pieces of about PIECE_BYTES, so that a long text needs no long tables
        j = max(i + 1, int(np.searchsorted(b, a[i] + PIECE_BYTES, "right")))
        part = data[a[i] : b[j - 1]]
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LOWER[part] * up[: len(part)], out=sums[1:])
        out[i:j] = (sums[b[i:j] - a[i]] - sums[a[i:j] - a[i]]) * down[a[i:j] - a[i]]
        i = j
    return mix64(out), np.searchsorted(a, offsets)


def text_words(text: str | None, scripts: bool = False) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return words_of(data, np.array([0, len(data)]), scripts)[0]


def allowed_edits(n: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def best_edits(item: np.ndarray, region: np.ndarray) -> int:
    """The least edit distance of the item to any stretch of the region, in words."""
    return best_match(item, region)[0]


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any stretch of the region, and where the first such ends."""
    at = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (region != word), out=new[1:])
        new[0] = i + 1
        row = np.minimum.accumulate(new - at) + at
    return int(row.min()), int(row.argmin())


def runs_of(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """One number for each run of n words."""
    keys = np.zeros(len(starts), np.uint64)
    for j in range(n):
        keys = (keys ^ words[starts + j]) * np.uint64(_BASE)
        keys ^= keys >> np.uint64(29)
    return keys


class Items:
    """A block of benchmark items: their words, by groups of about equal length, and for each
    repetition and group the steps to sample and the items' keys."""

    def __init__(self, words: list[np.ndarray], similarity: float, repetitions: int, sampled: int, min_words: int, seed: int):
        rng = np.random.default_rng(seed)
        self.words, self.similarity, self.repetitions = words, similarity, repetitions
        self.edits = np.array([allowed_edits(len(w), similarity) for w in words], np.int64)
        longest = max(map(len, words), default=0)
        self.bits = rng.integers(0, 64, (repetitions, 2 * longest + 2)).astype(np.uint64)
        self.flips = rng.integers(0, 2, (repetitions, 2 * longest + 2)).astype(np.uint64)
        self.vocabulary = np.zeros(1 << VOCABULARY_BITS, np.uint64)
        self.groups = []
        order = sorted((len(w), i) for i, w in enumerate(words) if len(w) >= max(1, min_words))
        while order:
            low = order[0][0]
            own = [i for n, i in order if n <= low * LENGTH_STEP]
            order = order[len(own) :]
            edits = int(self.edits[own].max())
            steps = [np.sort(rng.choice(max(1, int(1.8 * low)), min(sampled, max(1, int(1.8 * low))), replace=False)) for _ in range(repetitions)]
            prefix = max(1, low - edits)
            k = np.uint64(1) << np.uint64(len(self.groups) % 64)
            tables = []
            padded = np.concatenate([np.append(words[i], np.zeros(2 * longest + 2, np.uint64)) for i in own])
            starts = np.cumsum([0] + [len(words[i]) + 2 * longest + 2 for i in own])[:-1]
            for r in range(repetitions):
                keys = self.walk(padded, starts, r, steps[r])
                by = np.argsort(keys, kind="stable")
                tables.append((keys[by], np.array(own)[by]))
            for i in own:
                self.vocabulary[(words[i] & np.uint64((1 << VOCABULARY_BITS) - 1)).astype(np.int64)] |= k
            self.groups.append((k, prefix, prefix - edits, steps, tables))
        self.pieces = self.cut([i for i, w in enumerate(words) if len(w)])

    def cut(self, own: list[int]) -> list[tuple]:
        """By number of words: the pieces' sorted keys, a filter of their low bits, their items and
        where they stand in these."""
        by: dict[int, list[tuple[int, int]]] = {}
        for i in own:
            n, parts = len(self.words[i]), int(self.edits[i]) + 1
            by.setdefault(min(MOST_PIECE, n // parts), []).extend((i, k * n // parts) for k in range(parts))
        out = []
        for n, some in sorted(by.items()):
            item, offset = np.array(some, np.int64).T
            base = np.cumsum([0] + [len(w) for w in self.words])
            keys = runs_of(np.concatenate(self.words), base[item] + offset, n)
            by_key = np.argsort(keys, kind="stable")
            low = np.zeros(1 << VOCABULARY_BITS, bool)
            low[(keys & np.uint64((1 << VOCABULARY_BITS) - 1)).astype(np.int64)] = True
            out.append((n, keys[by_key], low, item[by_key], offset[by_key]))
        return out

    def meetings(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Start times number of items plus item, where a piece of the item is met: the start that
        the item has if no word before the piece was put in or taken out."""
        found = [np.zeros(0, np.int64)]
        for n, keys, low, item, offset in self.pieces:
            starts = np.arange(max(0, len(words) - n + 1))
            starts = starts[starts + n <= ends[starts]]
            mine = runs_of(words, starts, n)
            hit = np.flatnonzero(low[(mine & np.uint64((1 << VOCABULARY_BITS) - 1)).astype(np.int64)])
            first = np.searchsorted(keys, mine[hit])
            size = np.searchsorted(keys, mine[hit], "right") - first
            at = np.repeat(starts[hit], size)
            piece = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            found.append(np.maximum(begins[at], at - offset[piece]) * len(self.words) + item[piece])
        return np.concatenate(found)

    def walk(self, words: np.ndarray, starts: np.ndarray, repetition: int, steps: np.ndarray) -> np.ndarray:
        """The keys of the windows at these starts: the words at the sampled steps of their walks."""
        at, keys, one = starts.copy(), np.zeros(len(starts), np.uint64), np.uint64(1)
        sampled = set(steps.tolist())
        with np.errstate(over="ignore"):
            for j in range(int(steps[-1]) + 1):
                here = words[at]
                if j in sampled:
                    keys = (keys ^ here) * np.uint64(_BASE)
                    keys ^= keys >> np.uint64(29)
                at += ((here >> self.bits[repetition, j]) & one ^ self.flips[repetition, j]).astype(np.int64)
        return keys

    def candidates(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) pairs that share a piece, or whose keys agree in some repetition. `begins`
        and `ends`: where the text of each word begins and ends. For the keys, starts that can't begin a match are passed over: the first word, and all but
        as many of the next ones as edits are allowed, must be words of items."""
        n = len(words)
        padded = np.append(words, np.zeros(self.bits.shape[1] + 1, np.uint64))
        seen = self.vocabulary[(words & np.uint64((1 << VOCABULARY_BITS) - 1)).astype(np.int64)]
        found = [self.meetings(words, begins, ends)]
        for k, prefix, least, steps, tables in self.groups:
            if n < prefix:
                continue
            known = (seen & k) != 0
            count = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])
            starts = np.flatnonzero(known[: n - prefix + 1] & (count[prefix:] - count[: n - prefix + 1] >= least))
            starts = starts[starts + prefix <= ends[starts]]
            if not len(starts):
                continue
            for r in range(self.repetitions):
                keys, items = tables[r]
                mine = self.walk(padded, starts, r, steps[r])
                low = np.searchsorted(keys, mine)
                hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == mine)
                if len(hit):
                    high = np.searchsorted(keys, mine[hit], "right")
                    size = high - low[hit]
                    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    found.append(np.repeat(starts[hit], size) * len(self.words) + items[np.repeat(low[hit], size) + nth])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.words)), pairs % max(1, len(self.words))

    def verify(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, items: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(begin of the text, item) -> (least edits, word of the text near which it was found)."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item in np.unique(items):
            want, d = self.words[item], int(self.edits[item])
            own = np.sort(starts[items == item])
            bag = np.unique(want)
            # Of a match all but d of the item's words stand between low and high; windows that overlap are counted over once.
            low, high = np.maximum(begins[own], own - d), np.minimum(ends[own], own + len(want) + 2 * d)
            head = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
            size = high[np.append(head[1:], len(own)) - 1] - low[head]
            ahead = np.cumsum(size) - size
            there = words[np.repeat(low[head] - ahead, size) + np.arange(size.sum())]
            count = np.concatenate([[0], np.cumsum(bag[np.minimum(np.searchsorted(bag, there), len(bag) - 1)] == there)])
            shift = np.repeat(ahead - low[head], np.diff(np.append(head, len(own))))
            own = own[count[high + shift] - count[low + shift] >= len(want) - d]
            cuts = np.flatnonzero((np.diff(own) > len(want)) | (begins[own[1:]] != begins[own[:-1]])) + 1
            for part in np.split(own, cuts):
                if not len(part):
                    continue
                begin, end = begins[part[0]], ends[part[0]]
                first = max(begin, part[0] - d)
                edits, stop = best_match(want, words[first : min(end, part[-1] + len(want) + 2 * d)])
                if edits <= d:
                    key, at = (int(begin), int(item)), max(0, int(first - begin) + stop - len(want))
                    best[key] = min(best.get(key, (edits, at)), (edits, at))
        return best


def make_items(texts: list[str | None], *, similarity: float = SIMILARITY, repetitions: int = REPETITIONS, sampled: int = SAMPLED_STEPS, min_words: int = MIN_WORDS, seed: int = SEED) -> Items:
    return Items([text_words(t, True) for t in texts], similarity, repetitions, sampled, min_words, seed)


def _chunks(data: np.ndarray, offsets: np.ndarray):
    """Runs of texts of CHUNK_BYTES or so: (first text, bytes, offsets from 0)."""
    at = 0
    while at + 1 < len(offsets):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def match_texts(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text the (item, edits, word) matches, by item."""
    out: list[list] = []
    for _, some, offs in _chunks(data, offsets):
        words, begin = words_of(some, offs, True)
        sizes = np.diff(begin)
        begins, ends = np.repeat(begin[:-1], sizes), np.repeat(begin[1:], sizes)
        hits: dict[int, list] = {}
        if len(words) and items.pieces:
            for (b, item), (edits, at) in sorted(items.verify(words, begins, ends, *items.candidates(words, begins, ends)).items()):
                hits.setdefault(b, []).append((item, edits, at))
        out.extend(hits.get(int(b), []) if s else [] for b, s in zip(begin[:-1], sizes, strict=True))
    return out


_HIT = pa.struct([("item_id", pa.string()), ("n_words", pa.int32()), ("edits", pa.int32()), ("at_word", pa.int32())])
_HITS_DDL = "array<struct<item_id:string,n_words:int,edits:int,at_word:int>>"


def _matcher(spark: SparkSession, ids: list[str | None], items: Items):
    shared = spark.sparkContext.broadcast((ids, items))  # one block

    @F.arrow_udf(_HITS_DDL)
    def run(texts: pa.Array) -> pa.Array:
        ids, items = shared.value
        texts = texts.fill_null("")
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        found = match_texts(items, np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets) if len(texts) else []
        return pa.array([[{"item_id": ids[i], "n_words": len(items.words[i]), "edits": e, "at_word": a} for i, e, a in hits] for hits in found], pa.list_(_HIT))

    return run


def _blocks(benchmark: DataFrame, item_text: str, item_key: str, options: dict) -> Iterator:
    """One matcher after another, each for a block of the benchmark's items."""
    source = benchmark.select(F.col(item_key).cast("string").alias("id"), F.col(item_text).cast("string").alias("t")).filter(F.col("t").isNotNull())
    n, size = source.agg(F.count("*"), F.sum(F.length("t"))).first()
    blocks = max(1, -(-n // ITEMS_PER_BLOCK), -(-(size or 0) // CHARS_PER_BLOCK))
    for b in range(blocks):
        rows = sorted((r["id"] or "", r["id"], r["t"]) for r in source.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b).collect())  # one block
        if rows:
            yield _matcher(benchmark.sparkSession, [r[1] for r in rows], make_items([r[2] for r in rows], **options))


@shielded
def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", *, name: str = "matches", **options) -> DataFrame:
    """docs plus an array of (item_id, n_words, edits, at_word): the benchmark items of which some
    stretch of the whole text is within the allowed edits (in words, (1 - similarity) of the
    item's), the least number of edits, and the word near which that begins.

    Items too short for an edit (under five words at 0.8) match where their words stand in a row;
    items without a word, and null texts, match nothing. Items of equal texts all match; repeated
    rows stay. A column of docs with that name is replaced. The benchmark is taken in blocks of
    bounded size, one after another; between two the documents are written with what they hold so
    far. All pairs within the allowed edits are found, as one piece of the item is whole in each,
    and what is found is exact.
    """
    met, first = docs.withColumn("__hits", F.array().cast(_HITS_DDL)), True
    for matcher in _blocks(benchmark, item_text, item_key, options):
        met = met if first else write_shared(met, "matches")
        met, first = met.withColumn("__hits", F.concat("__hits", matcher(F.col(text).cast("string")))), False
    return replacing(met, **{name: F.col("__hits")}).drop("__hits")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", **options) -> DataFrame:
    """One row per document row and benchmark item found in it. item_id has the items' own type."""
    kind = benchmark.schema[item_key].dataType
    found = matches(docs.select(F.col(key), F.col(text)), benchmark, text, item_text, item_key, name="__matches", **options)
    return found.select(F.col(key), F.explode("__matches").alias("m")).select(key, F.col("m.item_id").cast(kind).alias("item_id"), "m.n_words", "m.edits", F.round(1 - F.col("m.edits") / F.col("m.n_words"), 4).alias("similarity"), "m.at_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", **options) -> DataFrame:
    """docs without the rows that hold a benchmark item: of each block of items, in turn, those go that
    hold one of it. Null and empty texts hold none and stay, as do null and empty items find none; repeated rows
    go or stay together, and all columns stay as they are. What a block leaves is written before the next."""
    kept, first = docs, True
    for matcher in _blocks(benchmark, item_text, item_key, options):
        kept = kept if first else write_shared(kept, "uncontaminated")
        kept, first = kept.filter(F.size(matcher(F.col(text).cast("string"))) == 0), False
    return kept


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's matches with benchmark items, within the allowed edits."""
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
