"""Structure archives: mmCIF files to typed tables, file by file in parallel.

A file becomes a row for each of its data blocks, with an array of rows for each wanted category, so
that a table is an explode away and nothing is shuffled to put columns together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables and their items.
TABLES = {
    "entry": ("id",),
    "struct": ("title",),
    "exptl": ("method",),
    "entity": ("id", "pdbx_description"),
    "entity_poly": ("entity_id", "type", "pdbx_seq_one_letter_code", "pdbx_seq_one_letter_code_can", "pdbx_strand_id"),
    "entity_poly_seq": ("entity_id", "num", "mon_id"),
    "struct_asym": ("id", "entity_id"),
    "pdbx_audit_revision_history": ("ordinal", "data_content_type", "revision_date"),
    "atom_site": ("group_PDB", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "auth_asym_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "pdbx_PDB_model_num"),
}
_TOKEN = re.compile(r"""#[^\n]*|'(?P<single>(?:[^'\n]|'(?=\S))*)'(?=\s|$)|"(?P<double>(?:[^"\n]|"(?=\S))*)"(?=\s|$)|(?P<bare>\S+)""")
_ODD = re.compile(r"#|(?:^|\s)(?:_|data_|save_|loop_(?:\s|$))", re.I)
_NAMES = re.compile(r"(?:_\S*[ \t\r]*\n)+")
_MISSING = ("", ".", "?")
_NO_VALUE = pa.array(_MISSING)
_BLOCKS_AT_ONCE, _VALUES_AT_ONCE = 1_000, 200_000


def _unquote(parts: list[str]) -> bool:
    """Take the quotes off; whether each quoted value is one of the parts."""
    for i, part in enumerate(parts):
        if part[0] in "'\"":
            if len(part) < 2 or part[-1] != part[0]:
                return False
            parts[i] = part[1:-1]
    return True


@lru_cache(1_000)
def _items_of(names: tuple[str, ...]) -> list[str]:
    return [n.split(".", 1)[-1] for n in names]


def _found(text: str, mark: str, at: int) -> int:
    """Where a mark comes next, or the end."""
    place = text.find(mark, at)
    return len(text) if place < 0 else place


class _Reader:
    """One file: blocks of categories, each with its columns' values, and what is wrong."""

    def __init__(self, wanted: frozenset[str]):
        self.wanted, self.blocks = wanted, [("", {}, [])]
        self.loop: list[str] | None = None
        self.values: list[str] = []
        self.item: str | None = None

    def category(self, name: str) -> dict[str, list]:
        return self.blocks[-1][1].setdefault(name, {})

    def finish(self) -> None:
        """Close the open loop, if any."""
        if self.loop:
            name, width = self.loop[0].split(".")[0], len(self.loop)
            if len(self.values) % width:
                self.blocks[-1][2].append((name, f"{len(self.values)} values in a loop of {width} columns"))
            elif name in self.wanted:
                self.category(name).update({c: self.values[i::width] for i, c in enumerate(_items_of(tuple(self.loop)))})
        self.loop, self.values, self.item = None, [], None

    def token(self, token: str, quoted: bool) -> None:
        low = token[:5].lower()
        if quoted or not (low in ("data_", "save_") or token[0] == "_" or token.lower() == "loop_"):
            if self.loop is not None:
                self.values.append(token)
            elif self.item:
                name, _, column = self.item.partition(".")
                if name in self.wanted:
                    self.category(name)[column] = [token]
                self.item = None
        elif token[0] == "_" and self.loop is not None and not self.values:
            self.loop.append(token[1:])
        else:
            self.finish()
            if low == "data_":
                self.blocks.append((token[5:], {}, []))
            elif token[0] == "_":
                self.item = token[1:]
            elif low == "loop_":
                self.loop = []

    def names(self, names: list[str]) -> None:
        """Names that stand alone on their lines."""
        if self.loop is not None and not self.values:
            self.loop += [n[1:] for n in names]
        else:
            self.finish()
            self.item = names[-1][1:]

    def read(self, text: str) -> Iterator[tuple]:
        """The blocks of a text, each as soon as it is over. Lines of names, and what of a loop has no text field,
        comment or underscore, are taken as a whole; other lines one by one."""
        at, end, mark, comment, field = 0, len(text), -1, -1, -1
        while at < end:
            first = text[at]
            if len(self.blocks) > 1:
                yield from (b for b in self.blocks[:-1] if b[0] or b[1] or b[2])
                del self.blocks[:-1]
            if first == "_":
                if m := _NAMES.match(text, at):
                    self.names(m[0].split())
                    at = m.end()
                    continue
            elif first == "l" and text.startswith("loop_\n", at):
                self.finish()
                self.loop, at = [], at + 6
                continue
            elif self.loop and first not in ";#":
                # the next underscore, comment and text field, looked for once each
                mark = mark if mark >= at else _found(text, "_", at)
                comment = comment if comment >= at else _found(text, "#", at)
                field = field if field >= at else _found(text, "\n;", at)
                stop = min(mark, comment, field)
                if stop < end:
                    stop = text.rfind("\n", at, stop + 1) + 1
                if stop > at:
                    plain = text[at:stop].split()
                    if _unquote(plain):
                        self.values += plain
                        at = stop
                        continue
            stop = text.find("\n", at)
            stop = end if stop < 0 else stop
            line, at = text[at:stop], stop + 1
            if line[:1] == ";":  # text up to a line that starts with another
                close = text.find("\n;", stop)
                held = text[at - len(line) : end if close < 0 else close]
                self.token(held.replace("\r", ""), True)
                if close < 0:
                    break
                stop = text.find("\n", close + 2)
                stop = end if stop < 0 else stop
                line, at = text[close + 2 : stop], stop + 1
            plain = line.split() if self.loop and not _ODD.search(line) else None
            if plain is not None and _unquote(plain):
                self.values += plain
            elif line[:1] != "#":
                for m in _TOKEN.finditer(line):
                    if m.lastgroup:
                        self.token(m[m.lastgroup], m.lastgroup != "bare")
        self.finish()
        yield from (b for b in self.blocks if b[0] or b[1] or b[2])


def _struct(category: str) -> str:
    return f"`{category}` array<struct<{','.join(f'`{i}`:string' for i in TABLES[category])}>>"


def read_items(spark: SparkSession, path: str, glob: str = "*.cif", *categories: str) -> DataFrame:
    """The data blocks of the files under path; a file is one task's work and has to fit in it, its text a few
    times over (for larger files see structure_scan)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return items(files.select("path", F.decode("content", "UTF-8").alias("text")), *categories)


def items(files: DataFrame, *categories: str) -> DataFrame:
    """(path, block, issues, and an array for each of the categories, all of TABLES by default) of
    files(path, text). A loop with a short last row is an issue and its category stays empty."""
    names = categories or tuple(TABLES)
    wanted = frozenset(names)

    def arrays(blocks: list[tuple]) -> Iterator[pa.Array]:
        for name in names:
            columns = [b[1].get(name, {}) for b in blocks]
            sizes = [max(map(len, c.values()), default=0) for c in columns]
            offsets = pa.array([0, *accumulate(sizes)], pa.int32())
            there = [(c, n) for c, n in zip(columns, sizes, strict=True) if n]
            flat = [pa.array(list(chain.from_iterable(c[i] if i in c else [None] * n for c, n in there)), pa.string()) for i in TABLES[name]]
            fields = [pc.if_else(pc.is_in(x, _NO_VALUE), None, x) for x in flat]
            yield pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=list(TABLES[name])))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        blocks = [b for _, b in rows]
        issues = pa.array([[{"category": c, "issue": i} for c, i in b[2]] for b in blocks], pa.list_(pa.struct([("category", pa.string()), ("issue", pa.string())])))
        return pa.record_batch([pa.array([p for p, _ in rows], pa.string()), pa.array([b[0] for b in blocks], pa.string()), issues, *arrays(blocks)], names=["path", "block", "issues", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        n = 0
        for part in batches:
            for path, text in zip(part["path"].to_pylist(), part["text"], strict=True):
                for block in _Reader(wanted).read(text.as_py() or ""):
                    got.append((path, block))
                    n += sum(len(v) for c in block[1].values() for v in c.values())
                    if len(got) >= _BLOCKS_AT_ONCE or n >= _VALUES_AT_ONCE:
                        yield batch(got)
                        got, n = [], 0
        if got:
            yield batch(got)

    schema = "path string, block string, issues array<struct<category:string,issue:string>>, " + ", ".join(map(_struct, names))
    return files.select("path", "text").mapInArrow(run, schema)


def table_of(blocks: DataFrame, category: str) -> DataFrame:
    """One category as a table: path, block, row_no and its items; '', '.' and '?' are null."""
    return blocks.select("path", "block", F.posexplode(category).alias("row_no", "r")).select("path", "block", "row_no", "r.*")


def issues(blocks: DataFrame) -> DataFrame:
    return blocks.select("path", "block", F.explode("issues").alias("i")).select("path", "block", "i.*")
