import gzip
import tempfile
from pathlib import Path

from helixlake.llm import warc

ROWS = [(5, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, "same"), (3, "http://c/", None), (4, "http://d/", ""), (6, "u", "WARC/1.1\r\n\r\nno record\r\n\r\n"), (7, "u", "é\r\n\r\n" * 50_000), (2, "http://b/2", "same"), (None, "u", "same"), (8, "u", "é\r\n\r\n" * 50_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, extra int").repartition(3)
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    resolved = warc.resolve(df)
    assert resolved.columns[:4] == df.columns
    warc.write_archives(resolved, "file://" + path, records_per_file=3, file_bytes=30_000)
    records = warc.read_archives(spark, "file://" + path)
    lengths = {(r.page_id, r.url): r for r in warc.with_lengths(records).collect()}
    assert len(lengths) == len(ROWS)
    first = {}
    for k, _, h in ROWS:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    back = {(r.page_id, r.url): r.payload for r in warc.original_payloads(records).collect()}
    for k, u, h in ROWS:
        at = (k, (u or "").replace("\r", " ").replace("\n", " "))
        body = (h or "").encode()
        revisit = k is not None and k != first[h or ""]
        r = lengths[at]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), warc.payload_digest(body), "revisit" if revisit else "response", first[h or ""] if revisit else None)
        assert back[at] == body
    archives = [gzip.decompress(p.read_bytes()) for p in Path(path).glob("*/part-*")]
    assert len({p.parent.name for p in Path(path).glob("*/part-*")}) > 1  # pages of several sizes
    assert all(len(a) < 40_000 or len(list(warc.parse(a))) == 1 for a in archives)
    assert sum(len(list(warc.parse(a))) for a in archives) == len(ROWS)


def test_small_payloads_and_empty_table(spark):
    df = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    assert {r.record_type for r in warc.resolve(df, min_bytes=5).collect()} == {"response"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_text_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([("d2", "u", "same", "x"), ("d1", "v", "same", "y"), ("d3", None, None, "z")], "page_id string, url string, html string, refers_to string")
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/w"
    warc.write_archives(warc.resolve(df), path)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.with_lengths(warc.read_archives(spark, path, "string")).collect()}
    assert got == {"d1": ("response", None, 4), "d2": ("revisit", "d1", 4), "d3": ("response", None, 0)}


def test_payloads_are_not_shuffled_by_digest(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    plan = warc.resolve(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and plan.count("Join") == 1
