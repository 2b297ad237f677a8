"""WARC archives: write pages as records, resolve revisits by payload digest, read archives back.

Only headers (key, url, digest, length) are shuffled by digest; what comes back is the list of
revisits, which the pages are joined to by key, where they lie if the list is small enough to be
broadcast. Each archive file is what Spark's text writer makes of records that are separated by the
blank lines the format asks for, so the files are plain WARC and live wherever Spark writes. Pages
of about one size go to files of as many records as make a bounded number of bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shared_folder, shielded, table, write_shared

RECORDS_PER_FILE, FILE_BYTES = 1_000, 64 << 20
_END = "\r\n\r\n"
#: The block of a response is these HTTP headers and the payload; that of a revisit only the headers.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_column(payload):
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes: forty bits at a time are eight digits to
    the base of 32, whose signs are then exchanged."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def with_headers(pages: DataFrame, payload: str) -> DataFrame:
    """pages, null payloads empty, plus payload_bytes and payload_digest."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    return pages.withColumns({payload: body}).withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": digest_column(F.col(payload))})


def revisits(headers: DataFrame, key: str, url: str, min_bytes: int) -> DataFrame:
    """(key, digest, first, first url) of the rows that revisit another: those of a digest and at least
    min_bytes whose key isn't the smallest. Headers are counted before they are shuffled, so a
    digest that many pages share is one row for each task; the pages are found again by a join
    from which adaptive execution splits a digest that stands out."""
    known = headers.filter((F.col("payload_bytes") >= min_bytes) & F.col(key).isNotNull())
    first = known.groupBy("payload_digest").agg(F.min(F.struct(F.col(key).alias("k"), F.col(url).cast("string").alias("u"))).alias("m"), F.count("*").alias("n")).filter("n > 1")
    met = known.join(first.select("payload_digest", "m"), "payload_digest").filter(F.col(key) != F.col("m.k"))
    return met.select(F.col(key).alias("__key"), F.col("payload_digest").alias("__digest"), F.col("m.k").alias("refers_to"), F.col("m.u").alias("refers_to_url")).distinct()


@shielded
def resolve(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", *, min_bytes: int = 0) -> DataFrame:
    """pages (key, url, payload) plus payload_bytes, payload_digest, record_type, refers_to and
    refers_to_url.

    Of records with equal payloads of at least min_bytes the smallest key is the response and the
    others revisit it; below that all are responses. A null payload is empty. Rows that repeat
    the smallest key are all responses, and so are rows of null key. Columns of pages with these
    names are replaced. Payloads are scanned twice; they are shuffled only if there are more
    revisits than can be broadcast, and then by key, never by digest.
    """
    made = ("payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_url")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in made])
    heads = with_headers(pages.select(F.col(key), F.col(url), F.col(payload)), payload).drop(payload)
    again = bounded(write_shared(revisits(write_shared(heads, "warc-headers"), key, url, min_bytes), "warc-revisits"))
    met = with_headers(pages, payload).join(again, (F.col(key) == F.col("__key")) & (F.col("payload_digest") == F.col("__digest")), "left")
    return met.withColumn("record_type", F.when(F.col("__key").isNotNull(), "revisit").otherwise("response")).drop("__key", "__digest")


def record_id(key):
    """A name-based id: the same page always has the same."""
    h = F.sha1(F.concat(F.lit("helixlake-page-"), key.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _clean(column):
    """A header value: no line ends in it."""
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), "[\r\n]", " ")


def record_text(key: str, url: str, payload: str, date: str):
    """Fresh headers and, for responses, the payload. `X-Page-Id` carries the key, as it would stand in a form
    (percent-encoded, so that any text comes back); a null key has none."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    k, spelled = F.coalesce(F.col(key).cast("string"), F.lit("")), lambda c: F.url_encode(c.cast("string"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(k)), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _clean(F.col(url))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"))), line("WARC-Refers-To-Target-URI", _clean(F.col("refers_to_url"))), line("X-Refers-To-Page-Id", spelled(F.col("refers_to"))))).otherwise(""),
        F.coalesce(line("X-Page-Id", spelled(F.col(key))), F.lit("")), line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", (F.when(revisit, 0).otherwise(F.col("payload_bytes")) + len(HTTP)).cast("string")), F.lit("\r\n" + HTTP),
    )
    return F.concat(head, F.when(revisit, "").otherwise(F.col(payload)))


def write_archives(resolved: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", *, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES, largest: int | None = None, compression: str = "gzip") -> None:
    """Archives below path, one folder for each class of payload sizes. A file has records_per_file
    records at most, and at most file_bytes of payload unless it is one record. `largest`: a bound of
    the payloads' bytes, measured if it isn't given; classes beyond it are skipped."""
    if largest is None:
        largest = resolved.agg(F.max("payload_bytes")).first()[0] or 0
    record, low, high = record_text(key, url, payload, date).alias("value"), -1, file_bytes // records_per_file
    while low < largest or low < 0:
        held = resolved.filter((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))
        n = max(1, min(records_per_file, file_bytes // max(1, high)))
        held.select(record).write.option("lineSep", _END).option("maxRecordsPerFile", n).option("compression", compression).text(f"{path}/{max(0, low)}")
        low, high = high, (max(1, 8 * high) if n > 1 else 2**62)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {n.lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(headers["content-length"])
        yield headers, archive[end + 4 : stop]
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end with two line ends")
        at = stop + 4


_RECORDS = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
RECORDS = "page_id string, url string, payload binary, payload_digest string, record_type string, refers_to string"
BATCH_RECORDS, BATCH_BYTES = 500, 32 << 20


def read_archives(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """One row per record, keys of the given type; a response's digest is computed from its payload and
    has to agree with its header. The payload of a revisit is null until `original_payloads` joins
    it. A file is one task's work."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for content in part["content"]:
                rows, size = [], 0
                whole = content.as_py()
                for head, body in parse(gzip.decompress(whole) if whole[:2] == b"\x1f\x8b" else whole):
                    body = body[body.index(b"\r\n\r\n") + 4 :]
                    revisit, digest = head["warc-type"] == "revisit", head["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and payload_digest(body) != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} isn't what its header says")
                    rows.append((None if "x-page-id" not in head else unquote_plus(head["x-page-id"]), head["warc-target-uri"], None if revisit else body, digest, "revisit" if revisit else "response", unquote_plus(head["x-refers-to-page-id"]) if revisit else None))
                    size += len(body)
                    if len(rows) == BATCH_RECORDS or size > BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    read = files.select("content").mapInArrow(run, RECORDS)
    return read.withColumns({c: F.col(c).cast(key_type) for c in ("page_id", "refers_to")})


def with_lengths(records: DataFrame) -> DataFrame:
    """records (without the payload) plus payload_bytes; that of a revisit is its original's."""
    heads = records.withColumn("own", F.octet_length("payload").cast("long")).drop("payload")
    originals = heads.filter("record_type = 'response'").groupBy(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest")).agg(F.max("own").alias("__length"))
    met = heads.join(originals, (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    return met.withColumn("payload_bytes", F.coalesce("own", "__length")).drop("own", "__id", "__digest", "__length")


def original_payloads(records: DataFrame) -> DataFrame:
    """records with every revisit's payload joined from the response it refers to."""
    originals = records.filter("record_type = 'response'").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("payload").alias("__payload")).dropDuplicates(["__id", "__digest"])
    met = records.join(originals, (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    return met.withColumn("payload", F.coalesce("payload", "__payload")).drop("__id", "__digest", "__payload")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages with revisits resolved, written and read back: a row for each record."""
    path, pages = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}", table(spark, sf_dir, "pages").select("page_id", "url", "html")
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    write_archives(resolve(pages), path, largest=largest)
    return with_lengths(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL_LETTERS = " || ".join(f"substr('{_BASE32}', 1 + ((('0x' || substr(sha1(body), {5 * i + 1}, 5))::INT >> {s}) & 31), 1)" for i in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, strlen(p.body)::BIGINT AS payload_bytes, {_SQL_LETTERS.replace("sha1(body)", "sha1(p.body)")} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON f.body = p.body
"""
