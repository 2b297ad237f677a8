"""Chat formatting: conversations become one marked-up text each, with the spans that a model
should learn from.

A task's turns come sorted by conversation and turn. From the offsets of Arrow's columns the lengths
of all segments, their cumulative offsets and scatter indexes are computed in numpy for a whole
batch; the bytes of headers, contents, escapes and ends then go from the column's buffer straight
to their places in one preallocated Arrow buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: What marks turns. A control string inside a text gets the escape after its first character; the escape itself is doubled.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>")
ESCAPE = "\\"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(" + re.escape(ESCAPE) + "?)")
_MARKED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + ESCAPE if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _MARKED.findall(formatted)]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its rows in them."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def escapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes after which an escape goes: escapes themselves, and the first of each control string
    that stands in one text. No two control strings overlap."""
    found = [np.flatnonzero(data == ord(ESCAPE))]
    for control in CONTROLS:
        want = np.frombuffer(control.encode(), np.uint8)
        at = np.flatnonzero(data == want[0])
        at = at[at + len(want) <= len(data)]
        for k in range(1, len(want)):
            at = at[data[at + k] == want[k]]
        found.append(at[offsets[np.searchsorted(offsets, at, "right")] >= at + len(want)])
    return np.sort(np.concatenate(found))


def _copy(target: np.ndarray, to: np.ndarray, source: np.ndarray, since: np.ndarray, sizes: np.ndarray) -> None:
    """sizes[i] bytes of source from since[i] on to target from to[i] on, CHUNK_BYTES at a time."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    for low in range(0, int(ends[-1]) if len(ends) else 0, CHUNK_BYTES):
        i = np.arange(low, min(low + CHUNK_BYTES, int(ends[-1])))
        row = np.searchsorted(ends, i, "right")
        i -= begins[row]
        target[to[row] + i] = source[since[row] + i]


def assemble(heads: tuple[np.ndarray, np.ndarray], kind: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with each turn's header (number kind[i] of heads, given as bytes and offsets), its
    content with escapes, and the end mark; and where turns, contents and end marks begin."""
    after = escapes(data, offsets)
    before = np.searchsorted(after, offsets)  # escapes before each text
    head_n, text_n = np.diff(heads[1])[kind], np.diff(offsets) + np.diff(before)
    end = np.frombuffer(END.encode(), np.uint8)
    stops = np.cumsum(head_n + text_n + len(end))
    turns = stops - head_n - text_n - len(end)
    texts, ends = turns + head_n, stops - len(end)
    target = np.empty(int(stops[-1]) if len(stops) else 0, np.uint8)
    _copy(target, turns, heads[0], heads[1][kind], head_n)
    # contents go in runs between escapes: each run of a text begins as many bytes later as escapes came before
    cuts = np.unique(np.concatenate([offsets[:-1], after + 1, offsets[-1:]]))
    runs = cuts[:-1]
    row = np.searchsorted(offsets, runs, "right") - 1
    to = texts[row] + runs - offsets[row] + np.searchsorted(after, runs) - before[row]
    _copy(target, to, data, runs, np.diff(cuts))
    row = np.searchsorted(offsets, after, "right") - 1
    target[texts[row] + after - offsets[row] + np.arange(len(after)) - before[row] + 1] = ord(ESCAPE)
    target[ends[:, None] + np.arange(len(end))] = end
    return target, turns, texts, ends


CHUNK_BYTES = 4 << 20
SCHEMA = "conv_id bigint, n_turns bigint, formatted string, loss_starts array<int>, loss_ends array<int>"
_FIELDS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.large_string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))])


def _format(turns: pa.Table, learn: frozenset) -> pa.RecordBatch:
    """Whole conversations, (conv, role, text) sorted: one output row each."""
    conv, role, text = (turns[c].combine_chunks() for c in ("conv", "role", "text"))
    new = _starts(conv)
    roles = role.fill_null("").dictionary_encode()
    names = roles.dictionary.to_pylist()
    marked = [(TURN + escape(r) + TEXT).encode() for r in names]
    heads = np.frombuffer(b"".join(marked), np.uint8), np.concatenate([[0], np.cumsum([len(h) for h in marked])]).astype(np.int64)
    target, begins, texts, ends = assemble(heads, roles.indices.to_numpy(), *_bytes_of(text.fill_null("")))
    first = np.flatnonzero(new)
    offsets = np.append(begins[first], len(target))
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(target))
    points = np.concatenate([[0], np.cumsum(target & 0xC0 != 0x80)])  # code points before each byte
    row = np.cumsum(new) - 1
    learned = np.isin(roles.indices.to_numpy(), [k for k, r in enumerate(names) if r in learn])
    base = points[offsets[row[learned]]]
    lists = np.concatenate([[0], np.cumsum(np.bincount(row[learned], minlength=len(first)))]).astype(np.int32)
    spans = [pa.ListArray.from_arrays(lists, (points[x[learned]] - base).astype(np.int32)) for x in (texts, ends)]
    return pa.record_batch([conv.take(pa.array(first)), pa.array(np.diff(np.append(first, len(conv)))), formatted, *spans], schema=_FIELDS)


def _starts(conv: pa.Array) -> np.ndarray:
    """Whether each row begins a run of equal values or of nulls."""
    values, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(conv), bool)
    new[1:] = (values[1:] != values[:-1]) | (null[1:] != null[:-1])
    return new


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, the formatted text and, in code points of it, the
    spans under the loss mask (`loss_starts`, `loss_ends`): the contents of turns whose role is
    in `learn`. `read_turns` gives the roles and texts back.

    Turns go by number (null first), those of equal number by role and text; repeated rows stay.
    Null roles and texts are empty. Rows of null conversation form one of their own. A
    conversation is one output row, so it has to fit in a task, but no other conversation of
    its partition does: rows stream by, sorted.
    """
    dealt = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    dealt = dealt.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    roles = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # of the last conversation so far
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(np.flatnonzero(_starts(batch["conv"]))[-1])
            if open_ and (last or open_[0]["conv"][0].as_py() != batch["conv"][0].as_py()):
                yield _format(pa.Table.from_batches([*open_, batch.slice(0, last)]), roles)
                open_ = [batch.slice(last)]
            elif last:
                yield _format(pa.Table.from_batches([batch.slice(0, last)]), roles)
                open_ = [batch.slice(last)]
            else:
                open_.append(batch)
        if open_:
            yield _format(pa.Table.from_batches(open_), roles)

    return dealt.mapInArrow(run, SCHEMA)


def digests(chats: DataFrame) -> DataFrame:
    """What the output of format_chats says when read back, as digests."""
    out = pa.struct([("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    @F.arrow_udf("struct<turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint>")
    def run(formatted: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = []
        for f, a, b in zip(formatted.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            whole = hashlib.sha256()
            for r, t in read_turns(f):
                whole.update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
            loss = "".join(unescape(f[x:y]) for x, y in zip(a, b, strict=True))
            rows.append({"turns_sha256": whole.hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), "formatted_chars": len(f)})
        return pa.array(rows, out)

    return chats.select("conv_id", "n_turns", run("formatted", "loss_starts", "loss_ends").alias("d")).select("conv_id", "n_turns", "d.*")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back: digests of turns and of the text to learn."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_chats(turns.unionByName(extra)))


def _escaped_length(column: str) -> str:
    """SQL for the length of a text once escaped: no two control strings overlap."""
    more = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in (ESCAPE, *CONTROLS))
    return f"(length({column}) + {more})"


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN) + len(TEXT) + len(END)} + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
