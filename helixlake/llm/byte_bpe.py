"""Byte-level BPE by recursive queries: each task runs DuckDB over the distinct words of its
texts. A word's bytes are rows (word, position, token); pairs of neighbours meet the merge table,
each word's leftmost pair of minimum rank is contracted, and so on until no pair merges. Decoding
joins tokens to the vocabulary and aggregates their bytes in order.

Short words have one number for word and position (64 places each). Words of LONG_BYTES or more contract in a round not one pair but all that
one-by-one contraction would take before any other: occurrences of the minimum rank from the left,
none overlapping, up to the first that makes a pair of the same or a lower rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import replacing, table, unused

LONG_BYTES, WORDS_AT_ONCE, BYTES_AT_ONCE, ROWS_KEPT = 64, 20_000, 200_000, 2_000_000
CHARS_AT_ONCE, TOKENS_AT_ONCE, MEMO_WORDS, MEMO_TOKENS = 1_000_000, 500_000, 150_000, 2_000_000
SLICE_BYTES, MEMORY_LIMIT = 2 << 20, "256MB"

_MERGE_ONE = """
WITH RECURSIVE s(g, tok, live, round) AS (
  SELECT word * 64 + pos, tok, true, 0 FROM start
  UNION ALL (
    WITH pairs AS (SELECT g, tok, round, lead(tok) OVER w AS nxt, lead(g) OVER w AS after, lag(g) OVER w AS before FROM s
                   WHERE live AND round < $rounds WINDOW w AS (ORDER BY g)),
    best AS (SELECT g >> 6 AS word, min(rank * 64 + (g & 63)) AS b FROM pairs p JOIN merges m ON m.a = p.tok AND m.b = p.nxt WHERE after >> 6 = g >> 6 GROUP BY ALL)
    SELECT g, CASE WHEN g & 63 = b & 63 THEN b >> 6 ELSE tok END, b IS NOT NULL, round + 1
    FROM pairs LEFT JOIN best ON word = g >> 6 WHERE before IS NULL OR b IS NULL OR before <> ((g >> 6) << 6) + (b & 63)))
SELECT g >> 6 AS word, g & 63 AS pos, tok, live FROM s WHERE NOT live OR round = $rounds ORDER BY g
"""

_MERGE_MANY = """
WITH RECURSIVE s(word, pos, tok, live, round) AS (
  SELECT word, pos, tok, true, 0 FROM start
  UNION ALL (
    WITH pairs AS (SELECT word, pos, tok, round, lead(tok) OVER w AS nxt, lead(tok, 2) OVER w AS nxt2, lag(tok) OVER w AS prv, row_number() OVER w AS i
                   FROM s WHERE live AND round < $rounds WINDOW w AS (PARTITION BY word ORDER BY pos)),
    ranked AS (SELECT p.*, m.rank, min(m.rank) OVER (PARTITION BY word) AS best FROM pairs p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt),
    runs AS (SELECT *, rank IS NOT NULL AND rank = best AND (i - coalesce(max(CASE WHEN rank = best THEN NULL ELSE i END) OVER w, 0)) % 2 = 1 AS chosen
             FROM ranked WINDOW w AS (PARTITION BY word ORDER BY pos)),
    sides AS (SELECT *, coalesce(lag(chosen, 2) OVER w, false) AS joined FROM runs WINDOW w AS (PARTITION BY word ORDER BY pos)),
    ends AS (SELECT word, min(pos) AS stop FROM sides x WHERE chosen AND (
               EXISTS (FROM merges m WHERE m.a = CASE WHEN joined THEN best ELSE prv END AND m.b = best AND m.rank <= best)
               OR EXISTS (FROM merges m WHERE m.a = best AND m.b = nxt2 AND m.rank <= best)) GROUP BY word),
    taken AS (SELECT x.*, chosen AND (stop IS NULL OR pos <= stop) AS done FROM sides x LEFT JOIN ends USING (word)),
    gone AS (SELECT *, coalesce(lag(done) OVER w, false) AS off FROM taken WINDOW w AS (PARTITION BY word ORDER BY pos))
    SELECT word, pos, CASE WHEN done THEN best ELSE tok END, best IS NOT NULL, round + 1 FROM gone WHERE NOT off))
SELECT word, pos, tok, live FROM s WHERE NOT live OR round = $rounds ORDER BY word, pos
"""

_DECODE = """
SELECT doc, CASE WHEN bool_and(bytes IS NOT NULL) THEN unhex(array_to_string(list(bytes ORDER BY pos), '')) END AS bytes
FROM tokens LEFT JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A file of ranks: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(a, b, rank): all pairs of tokens whose bytes together are a token, whose id is its rank."""
    rows = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    a, b, rank = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rank": pa.array(rank, pa.int32())})


class Memo:
    """Tokens of words that were met before."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.parts: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.begins: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.sizes: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.held = 0

    def add(self, words: list[str], tokens: np.ndarray, starts: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.parts.append(tokens)
        self.begins.append(self.held + starts[:-1])
        self.sizes.append(np.diff(starts))
        self.held += len(tokens)

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The known words' tokens, one word after another, and where each word's tokens start."""
        for kept in (self.parts, self.begins, self.sizes):
            kept[:] = [np.concatenate(kept)]
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        begin, size = self.begins[0][number], self.sizes[0][number]
        starts = np.concatenate([[0], np.cumsum(size)])
        return self.parts[0][np.repeat(begin - starts[:-1], size) + np.arange(starts[-1])], starts


class Tokenizer:
    """A vocabulary with its tables in a DuckDB of this process; a worker keeps it as long as the broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.ranks, self.pattern, self.db = ranks, pattern, None

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def _open(self):
        if self.db is None:
            import duckdb

            self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY_LIMIT, "temp_directory": ""})
            self._load("merges", merge_table(self.ranks))
            self._load("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array([t.hex() for t in self.ranks], pa.string())}))
            self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
            self.split = regex.compile(self.pattern)
            self._forget()
        return self.db

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.memo, self.older = Memo(), Memo()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' tokens, one word after another, and where each word's tokens start."""
        db, sizes = self._open(), np.array([len(w) for w in words], np.int64)
        many = bool(len(words)) and int(sizes.max()) >= min(LONG_BYTES, 64)
        starts = np.cumsum(sizes) - sizes
        word, pos = np.repeat(np.arange(len(words), dtype=np.int32), sizes), np.arange(sizes.sum()) - np.repeat(starts, sizes)
        rows = pa.table({"word": word, "pos": pos.astype(np.int32), "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)]})
        done = []
        while rows.num_rows:
            self._load("start", rows)
            # all rounds of a query stay in memory until it ends, so long words take several queries
            rounds = max(1, ROWS_KEPT // rows.num_rows)
            out = db.sql((_MERGE_MANY if many else _MERGE_ONE).replace("$rounds", str(rounds))).to_arrow_table()
            live = out["live"].to_numpy()
            done.append(out.filter(pa.array(~live)))
            rows = out.filter(pa.array(live)).select(["word", "pos", "tok"])
        met = pa.concat_tables(done) if done else None
        if met is None:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, tok = met["word"].to_numpy(), met["tok"].to_numpy()
        if len(done) > 1:
            order = np.lexsort((met["pos"].to_numpy(), word))
            word, tok = word[order], tok[order]
        return tok, np.searchsorted(word, np.arange(len(words) + 1))

    def _learn(self, words: list[str]) -> None:
        """Remember the tokens of new words: whole tokens as they are, the others merged, in groups
        of a bounded number of bytes, long ones apart."""
        spelled = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.array([self.ranks.get(b, -1) for b in spelled], np.int32)
        size = np.array([len(b) for b in spelled], np.int64)
        at = np.flatnonzero(whole >= 0)
        self.memo.add([words[i] for i in at], whole[at], np.arange(len(at) + 1))
        todo = np.flatnonzero(whole < 0)
        todo = todo[np.argsort(size[todo], kind="stable")]
        first_long = int(np.searchsorted(size[todo], min(LONG_BYTES, 64)))
        held = np.concatenate([[0], np.cumsum(size[todo])])
        begin = 0
        while begin < len(todo):
            end = min(begin + WORDS_AT_ONCE, max(begin + 1, int(np.searchsorted(held, held[begin] + BYTES_AT_ONCE, "right")) - 1))
            end = first_long if begin < first_long < end else end
            group = todo[begin:end]
            self.memo.add([words[i] for i in group], *self.merge([spelled[i] for i in group]))
            begin = end

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The text's matches of the pattern, in order, some at a time: the last match of a stretch may go
        on beyond it and is looked for again."""
        at, size = 0, CHARS_AT_ONCE
        while at < len(text):
            found = self.split.findall(text[at : at + size])
            if at + size < len(text):
                if len(found) < 2:
                    size *= 2
                    continue
                found.pop()
            yield found
            at, size = at + sum(map(len, found)) if at + size < len(text) else len(text), CHARS_AT_ONCE

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' tokens, one text after another, and where each text's tokens start."""
        self._open()
        parts: list[list[str]] = []
        owner: list[int] = []
        out, sizes, held = [], np.zeros(len(texts), np.int64), 0
        for i, text in enumerate(texts):
            for found in self.pieces(text or ""):
                parts.append(found)
                owner.append(i)
                held += len(found)
                if held >= CHARS_AT_ONCE // 2:
                    out.append(self._tokens(parts, owner, sizes))
                    parts, owner, held = [], [], 0
        out.append(self._tokens(parts, owner, sizes))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])

    def _tokens(self, parts: list[list[str]], owner: list[int], sizes: np.ndarray) -> np.ndarray:
        if not parts:
            return np.zeros(0, np.int32)
        if len(self.memo.number) > MEMO_WORDS or self.memo.held > MEMO_TOKENS:
            self.memo, self.older = Memo(), self.memo  # words in use move on, the others are forgotten
        new = set().union(*parts).difference(self.memo.number)
        again = [w for w in new if w in self.older.number] if self.older.number else []
        if again:
            self.memo.add(again, *self.older.tokens(again))
            new.difference_update(again)
        if new:
            self._learn(list(new))
        tokens, starts = self.memo.tokens(list(chain.from_iterable(parts)))
        np.add.at(sizes, owner, np.diff(starts[np.cumsum([0, *map(len, parts)])]))
        return tokens

    def decode(self, flat: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
        """The bytes of each run of tokens; None where one isn't in the vocabulary."""
        self._open()
        parts: list[list[bytes | None]] = [[] for _ in starts[1:]]
        for at in range(0, len(flat), TOKENS_AT_ONCE):
            ids = flat[at : at + TOKENS_AT_ONCE]
            doc = np.searchsorted(starts, np.arange(at, at + len(ids)), "right") - 1
            self._load("tokens", pa.table({"doc": doc.astype(np.int32), "pos": np.arange(len(ids), dtype=np.int32), "id": pa.array(ids, pa.int32())}))
            got = self.db.sql(_DECODE).to_arrow_table()
            for d, b in zip(got["doc"].to_pylist(), got["bytes"].to_pylist(), strict=True):
                parts[d].append(b)
        return [None if None in p else b"".join(p) for p in parts]


def tokenizer(path: str | None = None, pattern: str | None = None) -> Tokenizer:
    """The public byte-level vocabulary, or that of a rank file; only the driver reads it."""
    import public_tokenizers

    return Tokenizer(load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_BYTES of text, or one row."""
    held = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(held, held[begin] + SLICE_BYTES, "right")) - 1)
        yield begin, end
        begin = end


def encode(docs: DataFrame, text: str = "text", *, name: str = "token_ids", packed: bool = False, decoded: str | None = None, using: Tokenizer | None = None) -> DataFrame:
    """docs plus the ids of the whole text: array<int>, or with `packed` binary, 4 bytes an id, the lowest
    first. With `decoded` the ids are decoded again in the same task, into a column of that name.

    A text is cut by the vocabulary's pattern; a match that is a token is that token, else its bytes
    are merged by rank, the leftmost of equal ranks first. There are no special tokens: their
    spelling is text like any other. Null and empty texts have no ids; any length is taken, a
    part at a time. Rows, repeats and other columns stay; columns of these names are replaced. The
    vocabulary has a fixed size and is broadcast.
    """
    shared, inner = docs.sparkSession.sparkContext.broadcast(using or tokenizer()), unused(docs, "ids")
    rows = docs.withColumn(inner, F.col(text).cast("string"))
    kind, back = BinaryType() if packed else ArrayType(IntegerType(), False), unused(rows, "back")
    schema = StructType([*docs.schema.fields, StructField(inner, kind, False), *([StructField(back, BinaryType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = shared.value
        for batch in batches:
            for begin, end in _slices(batch[batch.num_columns - 1]):
                part = batch.slice(begin, end - begin)
                columns = part.columns[:-1]
                flat, starts = using.encode(part[part.num_columns - 1].to_pylist())
                if packed:
                    columns.append(pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((4 * starts).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))]))
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32())))
                if decoded:
                    columns.append(pa.array(using.decode(flat, starts), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = rows.mapInArrow(run, schema)
    return replacing(out, **{name: F.col(inner)}, **({decoded: F.col(back)} if decoded else {})).drop(*(c for c in (inner, back) if c not in (name, decoded)))


def decode(docs: DataFrame, ids: str = "token_ids", *, name: str = "decoded", using: Tokenizer | None = None) -> DataFrame:
    """docs plus the bytes (binary) that ids (array<int>) spell, which needn't be whole characters. No ids spell no
    bytes; null ids, or an id that the vocabulary lacks, spell null."""
    shared = docs.sparkSession.sparkContext.broadcast(using or tokenizer())

    @F.arrow_udf(BinaryType())
    def run(lists: pa.Array) -> pa.Array:
        starts, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        if flat.null_count or lists.null_count:
            sizes = np.array([0 if x is None else len(x) for x in lists.to_pylist()])
            starts, flat = np.concatenate([[0], np.cumsum(sizes)]), flat.fill_null(-1)
        out = shared.value.decode(flat.to_numpy(), starts)
        return pa.array([None if not ok else b for b, ok in zip(out, lists.is_valid().to_pylist(), strict=True)], pa.binary())

    return replacing(docs, **{name: run(F.col(ids).cast("array<int>"))})


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), packed=True, decoded="decoded").drop("text")
    return coded.select("doc_id", F.expr("octet_length(token_ids) div 4").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
