"""WARC archives: writing, and reading back by transaction assembly.

Writing: each page becomes three records, request, response (or revisit) and metadata, which point
at each other by WARC-Concurrent-To. Of pages with equal payloads of at least `least` bytes the one
with the smallest id is written in full; the others are revisit records without payload, which name
it (WARC-Refers-To). The records are strings whose end mark is the two line breaks that WARC puts
after a record, so that Spark's own text writer makes valid archives in any store that Spark writes.

Reading: archives are read as whole binary files of bounded size, cut into records by their
Content-Length, and put together again: request, response and metadata records are joined through
their concurrent-to identifiers, and revisits to the payload that they refer to, into one nested row
per capture.

Defined cases: null html counts as empty; an empty payload is a payload like any other; equal
payloads under `least` bytes stay in full; a page row that repeats (same id, or none) is captured once for
each row, its record identifiers told apart by a number; of equal payloads under one id the smallest number
stays in full; a null id reads back as null and is never referred to; payloads of any length that a string
can hold (under 2 GB) are written whole, large ones in archives of their own; an empty table gives no captures;
other columns don't matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import free_name, stable

#: Captures of an archive, by the largest payload that they may hold: about 128 MB before compression. Archives are
#: parsed as streams.
PER_FILE = ((64 << 10, 2_000), (1 << 20, 120), (16 << 20, 8), (1 << 62, 1))
#: Shared payloads are broadcast up to so many, of some 60 bytes each; else joined with so many salts.
BROADCAST_PAYLOADS = 100_000
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2024-01-01T00:00:00Z"
_FIELDS = "type string, record_id string, concurrent_to string, refers_to string, uri string, stated_digest string, page_id long, payload_bytes long, payload_digest string, payload binary"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: its 160 bits are written out once, then taken by fives."""
    parts = lambda h: [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)]
    letter = lambda b, i: F.substring(F.lit(_BASE32), F.conv(F.substring(b, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    bits = F.transform(F.array(sha1_hex), lambda h: F.concat(*parts(h)))
    return F.element_at(F.transform(bits, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: letter(b, i)), "")), 1)


def decided(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """-> (id, url, html, bytes, digest, turn, first): first is the id of the page to refer to, else null; digest is SHA-1 in hex.

    turn numbers the rows if ids repeat, in a checkpointed copy of the table, so that no task orders the rows of an
    id; else it is 0. Groups of equal payloads are cut down by a partial aggregate; only
    payloads that occur more than once come back, broadcast if they were counted to be few, else by
    a join on digest and salt, so that a payload of a third of all pages is spread over tasks.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    idents = pages.select(F.col(id_col).cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    turn = F.lit(0).cast("long")
    if not idents.filter("n > 1").isEmpty():
        mark = free_name(pages.columns, "_turn")
        pages, turn = stable(pages.withColumn(mark, F.monotonically_increasing_id())), F.col(mark)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), turn.alias("turn"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("digest"),
    )
    groups = rows.filter((F.col("bytes") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.min(F.struct("id", "turn")).alias("f"), F.count("*").alias("n"))
    shared = stable(groups.filter("n > 1").select(F.col("digest").alias("d"), F.col("f.id").alias("first"), F.col("f.turn").alias("first_turn")))
    if shared.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS:
        joined = rows.join(F.broadcast(shared), F.col("digest") == F.col("d"), "left")
    else:
        spread = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = rows.withColumn("own", F.pmod(F.xxhash64("id", "turn"), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, (F.col("digest") == F.col("d")) & (F.col("own") == F.col("salt")), "left")
    again = F.col("id").isNotNull() & (F.col("bytes") >= least) & F.col("first").isNotNull() & ~((F.col("id") == F.col("first")) & (F.col("turn") == F.col("first_turn")))
    return joined.select("id", "url", "html", "bytes", "digest", "turn", F.when(again, F.col("first")).alias("first"), F.when(again, F.col("first_turn")).alias("first_turn"))


def record_id(ident: Column, turn: Column, kind: str) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(ident.cast("string"), F.lit("-")), turn.cast("string"), F.lit(kind)).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, ident: Column, fields: list[tuple[str, Column]], body_type: str, body: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {_DATE}")]
    lines += [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in fields]
    lines += [F.lit(f"Content-Type: {body_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF + _CRLF), body)


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes gzipped archives of bounded size to the folder path. Pages are told apart by size only where large ones occur."""
    payload = F.octet_length(F.col(html_col).cast("string"))
    limits = [(low, high, n) for (low, _), (high, n) in zip([(-1, 0), *PER_FILE], PER_FILE)]
    within = lambda c, low, high: (F.coalesce(c, F.lit(0)) > low) & (F.coalesce(c, F.lit(0)) <= high)
    have = pages.agg(*[F.count_if(within(payload, low, high)).alias(f"s{i}") for i, (low, high, _) in enumerate(limits)]).first()
    rows = decided(pages, least, id_col, url_col, html_col)
    ident, turn = F.col("id"), F.col("turn")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    response, refers = record_id(ident, turn, "response"), F.when(F.col("first").isNotNull(), record_id(F.col("first"), F.col("first_turn"), "response"))
    revisit = F.col("first").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF + _CRLF))
    target = ("WARC-Target-URI", url)
    records = F.array(
        _record("request", record_id(ident, turn, "request"), [target, ("WARC-Concurrent-To", response)], "application/http; msgtype=request", F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{_CRLF}{_CRLF}"))),
        _record(
            F.when(revisit, "revisit").otherwise("response"), response,
            [target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))), ("WARC-Refers-To", refers), ("WARC-Profile", F.when(revisit, PROFILE))],
            "application/http; msgtype=response", F.concat(head, F.when(revisit, "").otherwise(F.col("html"))),
        ),
        _record("metadata", record_id(ident, turn, "metadata"), [target, ("WARC-Concurrent-To", response)], "application/warc-fields", F.concat(F.lit("pageId: "), F.coalesce(ident.cast("string"), F.lit("")), F.lit(_CRLF))),
    )
    wanted = [x for i, x in enumerate(limits) if have[f"s{i}"]] or limits[:1]
    rows = stable(rows) if len(wanted) > 1 else rows
    for low, high, n in wanted:
        part = rows.filter(within(F.col("bytes"), low, high)) if len(wanted) > 1 else rows
        part.select(F.explode(records).alias("value")).write.mode("append").option("lineSep", _CRLF + _CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * n).text(path)


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and body of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should start: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        body = stream.read(size)
        if len(body) < size:
            raise ValueError("record cut short")
        yield headers, body


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives (gzipped or not) in the folder path, one row each.

    payload_bytes and payload_digest are computed from the payload that was read; payload itself is
    null if payloads is False.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_py())
                gzipped = raw.getbuffer()[:2] == b"\x1f\x8b"
                rows, held = [], 0
                for headers, body in _records(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if gzipped else raw):
                    kind = headers.get("warc-type", "")
                    payload, page = None, None
                    if kind in ("response", "revisit", "resource"):
                        payload = body.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else body
                    elif kind == "metadata" and (m := re.search(rb"(?m)^pageId: *(-?\d+)\r?$", body)):
                        page = int(m[1])
                    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else None
                    rows.append((kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-payload-digest"), page, None if payload is None else len(payload), sha, payload if payloads else None))
                    held += len(body) if payloads else 200
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def captures(records: DataFrame) -> DataFrame:
    """-> (capture_id, request, response, metadata): one nested row for each transaction.

    The records that share an anchor (the record that the others are concurrent to) meet in one
    shuffle; resolved() joins revisits to what they refer to.
    """
    whole = F.struct(*records.columns)
    of = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), whole), ignorenulls=True)
    anchored = records.withColumn("anchor", F.when(F.col("type").isin("response", "revisit", "resource"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    joined = anchored.groupBy(F.col("anchor").alias("capture_id")).agg(of("request").alias("request"), of("response", "revisit", "resource").alias("response"), of("metadata").alias("metadata"))
    return joined


def resolved(made: DataFrame) -> DataFrame:
    """Adds original: for a revisit the capture (page_id, bytes, digest) that it refers to."""
    made = stable(made)
    wanted = made.filter(F.col("response.refers_to").isNotNull()).groupBy(F.col("response.refers_to").alias("target")).agg(F.count("*").alias("times"))
    held = made.select("capture_id", F.struct(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")).alias("original"))
    referred = held.join(wanted, F.col("capture_id") == F.col("target"), "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("capture_id", "target")
    salted = made.withColumn("salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int"))
    return salted.join(referred, (F.col("response.refers_to") == F.col("target")) & (salted["salt"] == referred["salt"]), "left").drop("salt", "target")
