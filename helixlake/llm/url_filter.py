"""URL filters: a trie over reversed host labels, then path segments, broadcast to the tasks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import replacing, shielded, table, write_shared

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
TRIE_RULES = 1_000_000
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_FOLD = {c: c + 32 for c in range(65, 91)}


#: How rules go before each other: letters of the host, of the path, whether it blocks, the rule, its verdict.
Rank = tuple[int, int, bool, str, str]


class Node:
    __slots__ = ("labels", "longest", "segments", "tails")

    def __init__(self):
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.tails: dict[str, Rank] = {}  # what the path's next segment starts with -> the rule
        self.longest = 0  # letters of the longest of these


def build_trie(rules) -> Node:
    """Of (verdict, host, path). The same host and path in both lists: block wins."""
    root = Node()
    for verdict, host, path in sorted(rules, key=lambda r: r[0] == "block"):
        node = root
        for label in reversed(host.translate(_FOLD).split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, tail = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        node.tails[tail] = (len(host), len(path), verdict == "block", host.translate(_FOLD) + path, verdict)
        node.longest = max(node.longest, len(tail))
    return root


def _longest_path(node: Node, parts: list[str]) -> Rank | None:
    best = None
    for i, part in enumerate(parts):
        if node.tails:
            for n in range(min(len(part), node.longest) + 1):
                best = node.tails.get(part[:n], best)
        node = node.segments.get(part) if i + 1 < len(parts) else None
        if node is None:
            break
    return best


def match(root: Node, host: str, path: str) -> Rank | None:
    """The rule that fits with the longest host and, among those, the longest path."""
    best, node, parts = None, root, path.split("/")
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        best = _longest_path(node, parts) or best
    return best


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url or "")
    return (found[1].translate(_FOLD), found[2]) if found else ("", "")


_RANK = pa.struct([("host_letters", pa.int32()), ("path_letters", pa.int32()), ("blocks", pa.bool_()), ("rule", pa.string()), ("verdict", pa.string())])
_OUT = pa.struct([("host", pa.string()), ("path", pa.string()), ("best", _RANK)])
_OUT_DDL = "struct<host:string,path:string,best:struct<host_letters:int,path_letters:int,blocks:boolean,rule:string,verdict:string>>"


def _judge(spark: SparkSession, rules: list):
    shared = spark.sparkContext.broadcast(build_trie(rules))

    @F.arrow_udf(_OUT_DDL)
    def run(urls: pa.Array) -> pa.Array:
        root, out = shared.value, []
        for host, path in map(split_url, urls.to_pylist()):
            best = match(root, host, path)
            out.append({"host": host, "path": path, "best": best and dict(zip((f.name for f in _RANK), best, strict=True))})
        return pa.array(out, _OUT)

    return run


@shielded
def filter_urls(pages: DataFrame, url: str = "url", *, rules=RULES, default: str = "allow", trie_rules: int = TRIE_RULES) -> DataFrame:
    """pages plus host, path, rule and verdict.

    A rule (verdict, host, path) fits its host and all subdomains where the url's path starts
    with the rule's; the longest host wins, then the longest path, and block over allow for
    the same host and path. Without a rule the verdict is `default`. A null url, or one without
    `://`, has empty host and path and so meets no rule. Input columns with these names are
    replaced. A trie of trie_rules rules at most is broadcast. Of more rules one trie after another
    meets the distinct urls, whose best rule so far is written and read again.
    """
    rules, column = list(rules), F.col(url).cast("string")
    if len(rules) <= trie_rules:
        met = pages.withColumn("__judged", _judge(pages.sparkSession, rules)(column))
    else:
        urls = pages.select(column.alias("__url")).distinct().withColumn("__judged", F.lit(None).cast(_OUT_DDL))
        for at in range(0, len(rules), trie_rules):
            now, last = F.col("__now"), F.col("__judged.best")
            judged = urls.withColumn("__now", _judge(pages.sparkSession, rules[at : at + trie_rules])(F.col("__url")))
            urls = write_shared(judged.select("__url", F.struct(now["host"].alias("host"), now["path"].alias("path"), F.greatest(last, now["best"]).alias("best")).alias("__judged")), "judged-urls")
        met = pages.join(urls, column.eqNullSafe(F.col("__url"))).drop("__url")
    made = {"host": F.col("__judged.host"), "path": F.col("__judged.path"), "rule": F.col("__judged.best.rule"), "verdict": F.coalesce("__judged.best.verdict", F.lit(default))}
    return replacing(met, **made).drop("__judged")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the longest rule that fits each page's url."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, rh || rp AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS rn
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND rn = 1
"""
