"""One category of structure files, read by splits: a file of any size is many tasks' work.

Spark's text source cuts files into splits of lines. What a split's first values belong to is
only known from what stands before it, so files of several splits are read up to three times:

1. lines that open or close a text field are counted, whose parity says whether a split begins
   inside of one;
2. each split is summed up as the names and counts since its last sure turning point, and these
   are followed from split to split, file by file;
3. each split is read from the state that it begins in. Rows that lie in one split leave it whole;
   the values of a row, and the pieces of a text, that a cut goes through are put together after.

Files of one split are read once. Only wanted values are kept, the others are counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.sources.structures import _MISSING, _NAMES, _ODD, _TOKEN, TABLES, _found, _items_of, _unquote

STATE_BYTES = 64 << 20


class _State:
    """What values belong to at a place of a file: a block, and in it a loop, an item or nothing."""

    def __init__(self, split: int, state: dict | None = None):
        self.split, self.turn = split, 0
        for name, value in (state or {"block": "", "block_key": "", "form": "", "names": [], "n": 0, "loop": ""}).items():
            setattr(self, name, value)
        self.names = list(self.names)

    def structure(self, token: str, turn: int) -> None:
        low = token[:5].lower()
        if token[0] == "_" and self.form == "loop" and not self.n:
            self.names.append(token[1:])
            return
        self.close()
        self.loop, self.n, self.names = f"{self.split}:{turn}", 0, []
        self.form = "loop" if low == "loop_" else "item" if token[0] == "_" else ""
        if token[0] == "_":
            self.names = [token[1:]]
        elif low == "data_":
            self.block, self.block_key = token[5:], self.loop

    def close(self) -> None:
        pass

    def saved(self) -> dict:
        return {c: getattr(self, c) for c in ("block", "block_key", "form", "names", "n", "loop")}


def _walk(text: str, inside: bool, to) -> bool:
    """Tell `to` about the tokens of whole lines: structure(token), values(list), and of text fields opened(first
    line), more(line), closed(). Returns whether a text field is open at the end. Lines of names, and what has no
    text field, comment or underscore, are taken as a whole; other lines one by one."""
    at, end, mark, comment, field = 0, len(text), -1, -1, -1
    while at < end:
        first = text[at]
        if not inside and first == "_" and (m := _NAMES.match(text, at)):
            for name in m[0].split():
                to.structure(name)
            at = m.end()
            continue
        if not inside and first not in "_#;":
            mark = mark if mark >= at else _found(text, "_", at)
            comment = comment if comment >= at else _found(text, "#", at)
            field = field if field >= at else _found(text, "\n;", at)
            stop = min(mark, comment, field)
            if stop < end:
                stop = text.rfind("\n", at, stop + 1) + 1
            if stop > at:
                parts = text[at:stop].split()
                if _unquote(parts):
                    to.values(parts)
                    at = stop
                    continue
        stop = _found(text, "\n", at)
        line, at = text[at:stop], stop + 1
        if inside:
            if line[:1] != ";":
                to.more(line)
                continue
            to.closed()
            inside, line = False, line[1:]
        elif line[:1] == ";":
            to.opened(line[1:])
            inside = True
            continue
        elif line[:1] == "#":
            continue
        elif line == "loop_":
            to.structure(line)
            continue
        parts = None if _ODD.search(line) else line.split()
        if parts is not None and _unquote(parts):
            to.values(parts)
            continue
        for m in _TOKEN.finditer(line):
            if not m.lastgroup:
                continue
            token = m[m.lastgroup]
            if m.lastgroup == "bare" and (token[0] == "_" or token[:5].lower() in ("data_", "save_") or token.lower() == "loop_"):
                to.structure(token)
            else:
                to.values([token])
    return inside


class _Outline:
    """A split's block and the names and counts since its last sure turning point."""

    def __init__(self, split: int):
        self.split, self.turn, self.steps, self.block = split, 0, [], None

    def structure(self, token: str) -> None:
        low = token[:5].lower()
        if token[0] != "_":
            self.steps = []
        elif self.steps and not self.steps[-1][1]:
            self.steps = [(0, "", 1)]  # a name after values opens something new, whatever was before
        if low == "data_":
            self.block = (token[5:], f"{self.split}:{self.turn}")
        self.steps.append((self.turn, token, 0))
        self.turn += 1

    def values(self, parts: list) -> None:
        if not parts:
            return
        if self.steps and not self.steps[-1][1]:
            self.steps[-1] = (0, "", self.steps[-1][2] + len(parts))
        else:
            self.steps.append((0, "", len(parts)))

    def opened(self, _line: str) -> None:
        self.values([None])

    def more(self, _line: str) -> None:
        pass

    def closed(self) -> None:
        pass


def follow(outlines: pd.DataFrame) -> pd.DataFrame:
    """The state in which each split of a file begins, from the outlines of all (in any order)."""
    rows, state = [], _State(0)
    ordered = outlines.sort_values("start")
    for fid, start, outline in zip(ordered["fid"], ordered["start"], ordered["outline"], strict=True):
        rows.append((fid, start, json.dumps(state.saved()), False))
        block, steps = json.loads(outline)
        state = _State(start, state.saved())
        for turn, token, n in steps:
            if token:
                state.structure(token, turn)
            state.n += n
        if block is not None:
            state.block, state.block_key = block
    rows[-1] = (*rows[-1][:3], True)
    return pd.DataFrame(rows, columns=["fid", "start", "state", "last"])


class _Rows(_State):
    """Collects the rows of one category from a split's state on."""

    def __init__(self, split: int, state: dict | None, category: str, items: tuple[str, ...], out: dict):
        super().__init__(split, state)
        self.category, self.items, self.out = category, items, out
        self.held, self.at, self.text = [], self.n, None

    def _wanted(self) -> bool:
        return bool(self.names) and self.names[0].split(".")[0] == self.category

    def _put(self, kind: str, count: int = 1, **columns) -> None:
        for name in ("block", "block_key", "loop"):
            self.out[name] += [getattr(self, name)] * count
        self.out["kind"] += [kind] * count
        for name in ("row_no", "col", "piece", "text", *self.items):
            self.out[name] += columns.get(name, [None] * count)

    def structure(self, token: str, turn: int | None = None) -> None:
        super().structure(token, self.turn)
        self.turn += 1

    def values(self, parts: list[str]) -> None:
        if self.form == "loop" and self._wanted():
            if not self.held:
                self.at = self.n
            self.held += parts
        elif self.form == "item" and not self.n and parts and self._wanted():
            self._put("item", col=[self.names[0].split(".", 1)[-1]], piece=[self.split], text=[parts[0]])
        self.n += len(parts)

    def _loose(self, index: int, values: list[str]) -> None:
        width = len(self.names)
        cols = [self.names[(index + k) % width].split(".", 1)[-1] for k in range(len(values))]
        self._put("loose", len(values), row_no=[(index + k) // width for k in range(len(values))], col=cols, piece=[self.split] * len(values), text=list(values))

    def flush(self, end: bool = False) -> None:
        """Rows that are complete leave; at the end of a split the rest does so value by value."""
        if self.held:
            width = len(self.names)
            head = -self.at % width
            if head and len(self.held) >= head:
                self._loose(self.at, self.held[:head])
                del self.held[:head]
                self.at += head
            if not self.at % width:
                n = len(self.held) // width
                values = {c: self.held[i : n * width : width] for i, c in enumerate(_items_of(tuple(self.names))) if c in self.items}
                self._put("row", n, row_no=list(range(self.at // width, self.at // width + n)), **values)
                del self.held[: n * width]
                self.at += n * width
            if end:
                self._loose(self.at, self.held)
                self.held = []

    def close(self) -> None:
        if self.form == "loop" and self._wanted():
            width = len(self.names)
            self.flush()
            if self.n % width:
                self._put("issue", col=[self.category], text=[f"{self.n} values in a loop of {width} columns"])
        self.held = []

    def opened(self, line: str) -> None:
        self.text = [line]

    def more(self, line: str) -> None:
        if self.text is None:  # it began in a split before
            self.text = [None]
        self.text.append(line)

    def _piece(self, index: int) -> None:
        lines = [x for x in self.text or [] if x is not None]
        if not lines:
            return
        text = "\n".join(lines).replace("\r", "")
        if self.form == "loop" and self._wanted():
            self._loose(index, [text])
        elif self.form == "item" and not index and self._wanted():
            self._put("item", col=[self.names[0].split(".", 1)[-1]], piece=[self.split], text=[text])

    def closed(self) -> None:
        if self.text is None or self.text[0] is None:
            self._piece(self.n - 1)
        else:
            self.values(["\n".join(self.text).replace("\r", "")])
        self.text = None

    def end(self, inside: bool, last: bool) -> None:
        """The split is over."""
        if inside and self.text is not None:
            if self.text[0] is None:
                self._piece(self.n - 1)
            elif last:
                self.values(["\n".join(self.text).replace("\r", "")])
            else:
                self.flush(end=True)
                self._piece(self.n)
                self.n += 1
        if last:
            self.close()
        else:
            self.flush(end=True)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], str]]:
    """Lines of a partition with their split (file, start), in order, each with its end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        fids, starts = (batch[k].to_numpy() for k in range(2))
        cuts = (np.flatnonzero((np.diff(fids) != 0) | (np.diff(starts) != 0)) + 1).tolist()
        for begin, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield (int(fids[begin]), int(starts[begin])), "\n".join(batch[2].slice(begin, stop - begin).to_pylist()) + "\n"


def _bounded(rows: DataFrame, what: str) -> list:
    """All rows, if they take STATE_BYTES at most."""
    size = rows.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size > STATE_BYTES:
        raise ValueError(f"{what} take {size} bytes; larger splits (spark.sql.files.maxPartitionBytes) make fewer of them")
    return rows.collect()


def scan(spark: SparkSession, path: str, category: str, glob: str = "*.cif") -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of one category of the files under path: (path, block, row_no and the category's items), and
    (path, block, category, issue) of loops with a short last row, none of whose rows are kept.

    Equal to structures.table_of(structures.read_items(path), category), for files in which a block has a
    category once. Missing values are null. States of splits are broadcast, at most STATE_BYTES."""
    items = TABLES[category]
    source = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    lines = source.select(F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.file_block_start").alias("start"), "value", F.col("_metadata.file_path").alias("path"))
    splits = lines.groupBy("path", "fid", "start").agg(F.count_if(F.startswith("value", F.lit(";"))).alias("marks"))
    by_file = Window.partitionBy("path")
    before = F.coalesce(F.sum("marks").over(by_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = splits.withColumn("n", F.count(F.lit(1)).over(by_file)).withColumn("inside", before % 2 == 1).filter("n > 1")
    big = _bounded(many.select("fid", "start", "inside"), "splits")
    inside_at, states = {(r["fid"], r["start"]) for r in big if r["inside"]}, {}
    large = {r["fid"] for r in big}

    if big:
        shared = spark.sparkContext.broadcast((inside_at, large))

        def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            odd, own = shared.value
            key, now, inside = None, None, False

            def done() -> pa.RecordBatch:
                return pa.record_batch({"fid": [key[0]], "start": [key[1]], "outline": [json.dumps([now.block, now.steps])]})

            for at, part in _runs(batches):
                if at[0] not in own:
                    continue
                if at != key:
                    if now is not None:
                        yield done()
                    key, now, inside = at, _Outline(at[1]), at in odd
                inside = _walk(part, inside, now)
            if now is not None:
                yield done()

        outlines = lines.select("fid", "start", "value").mapInArrow(outline, "fid bigint, start bigint, outline string")
        begun = outlines.groupBy("fid").applyInPandas(follow, "fid bigint, start bigint, state string, last boolean")
        states = {(r["fid"], r["start"]): (json.loads(r["state"]), r["last"]) for r in _bounded(begun, "states of splits")}
    told = spark.sparkContext.broadcast((inside_at, large, states))
    names = ("fid", "kind", "block", "block_key", "loop", "row_no", "col", "piece", "text", *items)
    kinds = {"fid": pa.int64(), "row_no": pa.int64(), "piece": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, own, begun = told.value
        out: dict[str, list] = {n: [] for n in names}
        key, now, inside, last = None, None, False, True

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(out[n], kinds.get(n, pa.string())) for n in names], names=list(names))
            for n in names:
                out[n] = []
            return made

        def stamp() -> None:
            out["fid"] += [key[0]] * (len(out["kind"]) - len(out["fid"]))

        for at, part in _runs(batches):
            if at != key:
                if now is not None:
                    now.end(inside, last)
                    stamp()
                if at[0] in own and at not in begun:
                    raise RuntimeError("splits changed between two readings; set spark.sql.files.minPartitionNum")
                state, last = begun.get(at, (None, True))
                key, now, inside = at, _Rows(at[1], state, category, items, out), at in odd
            inside = _walk(part, inside, now)
            now.flush()
            stamp()
            if len(out["kind"]) > 20_000:
                yield batch()
        if now is not None:
            now.end(inside, last)
            stamp()
        if out["kind"]:
            yield batch()

    schema = ", ".join(f"`{n}` {'bigint' if n in kinds else 'string'}" for n in names)
    found = lines.select("fid", "start", "value").mapInArrow(read, schema)
    paths = splits.groupBy("fid").agg(F.min("path").alias("path"), F.countDistinct("path").alias("n_paths"))
    paths = paths.select("fid", F.when(F.col("n_paths") > 1, F.raise_error(F.lit("two paths have one hash"))).otherwise(F.col("path")).alias("path"))
    return _assembled(found, paths, category, items)


def _assembled(found: DataFrame, paths: DataFrame, category: str, items: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    from helixlake.sources.shared import write_shared

    found = write_shared(found, "structure-rows")
    whole = found.filter("kind = 'row'").select("fid", "block", "loop", "row_no", *items)
    # values that a cut went through, or that stand alone: pieces to values, values to rows
    value = found.filter("kind IN ('loose', 'item')").groupBy("fid", "kind", "block", "block_key", "loop", "row_no", "col")
    value = value.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), "\n").alias("text"))
    cells = [F.max(F.when(F.col("col") == i, F.col("text"))).alias(i) for i in items]
    cut = value.filter("kind = 'loose'").groupBy("fid", "block", "loop", "row_no").agg(*cells)
    single = value.filter("kind = 'item'").groupBy("fid", "block", "block_key").agg(*cells).select("fid", "block", F.lit("").alias("loop"), F.lit(0).cast("long").alias("row_no"), *items)
    broken = found.filter("kind = 'issue'")
    kept = whole.unionByName(cut).join(broken.select("fid", "loop"), ["fid", "loop"], "left_anti").unionByName(single)
    clean = [F.when(F.col(i).isin(*_MISSING), None).otherwise(F.col(i)).alias(i) for i in items]
    rows = kept.join(paths, "fid").select("path", "block", "row_no", *clean)
    return rows, broken.join(paths, "fid").select("path", "block", F.lit(category).alias("category"), F.col("text").alias("issue"))
