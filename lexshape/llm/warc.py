"""WARC archives: written and read by Spark, transactions assembled by concurrent-to identifiers.

Writing: each page becomes a request, a response (or a revisit of an earlier response with the
same payload) and a metadata record, tied by ``WARC-Concurrent-To``. Records are rows of
text closed by an empty line, so Spark's own writer makes the archives, in any store it
reaches, compressed and split into files of a bounded number of records.

Reading: every archive file is one row of ``binaryFile``; records are cut by their length
header, so payloads may hold anything, record marks included. Assembly joins requests and
metadata to responses in either direction of the identifier, and revisits to the
response they refer to; joins are over written tables, so a payload that a third of all
pages share is split. Record ids of responses follow from the payload.

Defined cases: a null payload is empty; null URLs are written as ``about:blank`` and come back null;
headers hold URLs without control characters and with blanks as %20, the metadata as they were.
Null ids sort last when the response is chosen. A page given twice is a response and a revisit of it.
A capture with several requests or metadata records shows the one with the smallest record id.
What follows a damaged record is searched for the next record mark. Empty tables give no archive rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lexshape.session import settle

RECORDS_PER_FILE = 12_000
LEAST_BYTES = 0             # payloads from this size on are written once
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"

RECORD = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("concurrent_to", T.ArrayType(T.StringType())),
    T.StructField("refers_to", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("content_type", T.StringType()), T.StructField("stated_digest", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("header", T.StringType()), T.StructField("payload", T.BinaryType())])


def base32_sha1(body: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits in eights of 20 bits, four letters each."""
    letters, digits = [], F.sha1(body)
    for g in range(8):
        bits = F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column | str, record_id: Column, content_type: str, block: Column, date: Column, uri: Column, *more: tuple[str, Column]) -> Column:
    """A record without its closing empty line; a header whose value is null is left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind),
             F.concat(F.lit("WARC-Record-ID: "), record_id), F.concat(F.lit("WARC-Date: "), date), F.concat(F.lit("WARC-Target-URI: "), uri),
             *(F.concat(F.lit(f"{name}: "), value) for name, value in more),
             F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def with_roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, response): which pages are the response of their payload.

    Of equal payloads of at least ``least_bytes``, the page with the smallest id; smaller payloads always."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    light = settle(rows.where(F.octet_length("html") >= least_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n")))
    first = settle(light.groupBy("digest").agg(F.min("page_id").alias("first_id")))
    again = light.where("n > 1").select(F.col("digest").alias("__d"), F.col("page_id").alias("__p"))
    rows = rows.withColumn("copy", F.lit(1))
    if not again.isEmpty():
        same = (F.col("digest") == F.col("__d")) & F.col("page_id").eqNullSafe(F.col("__p"))
        nth = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").withColumn("copy", nth))
    response = F.col("first_digest").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1))
    return rows.join(first.withColumnRenamed("digest", "first_digest"), F.col("digest") == F.col("first_digest"), "left").withColumn("response", response)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE, date: str | None = None) -> None:
    """Write the pages as compressed archives under ``path``."""
    when = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    controls = "".join(map(chr, (*range(32), 127)))
    safe = F.replace(F.translate(F.coalesce("url", F.lit("about:blank")), controls, ""), F.lit(" "), F.lit("%20"))
    rows = with_roles(pages, least_bytes).withColumn("uri", safe).withColumn("when", when).withColumn("own", F.expr("uuid()"))
    small = F.octet_length("html") < least_bytes
    shared = urn(F.lit("response"), F.col("digest"))
    rows = rows.withColumn("main_id", F.when(F.col("response") & ~small, shared).otherwise(urn(F.lit("main"), F.col("own"))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    asked = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract("uri", r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")),
                     F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("uri", r"^[a-z]+://([^/?#]*)", 1), F.lit(END))
    tie, main = ("WARC-Concurrent-To", F.col("main_id")), (F.col("when"), F.col("uri"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    about = F.to_json(F.struct("page_id", "url"))
    records = F.array(
        _record("request", urn(F.lit("request"), F.col("own")), "application/http;msgtype=request", asked, *main, tie),
        F.when(F.col("response"), _record("response", F.col("main_id"), "application/http;msgtype=response", F.concat(http, F.col("html")), *main, digest))
        .otherwise(_record("revisit", F.col("main_id"), "application/http;msgtype=response", http, *main, digest,
                           ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", shared))),
        _record("metadata", urn(F.lit("metadata"), F.col("own")), "application/json", about, *main, tie))
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(stream: io.BufferedIOBase):
    """Records of one archive as dictionaries of ``RECORD``. A record without a sound head or cut off at the end is passed over."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, list[str]] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, colon, value = line.partition(b":")
            if colon:
                head.setdefault(name.decode("latin-1").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
        one = lambda name: head.get(name, [None])[0]
        length = one("content-length")
        if length is None or not length.isdigit() or one("warc-record-id") is None:
            continue
        block = stream.read(int(length))
        if len(block) < int(length):
            return
        kind, header = (one("warc-type") or "").lower(), b""
        if (one("content-type") or "").startswith("application/http"):
            header, _, block = block.partition(b"\r\n\r\n")
        stated = one("warc-payload-digest")
        full = kind != "revisit"
        yield {"type": kind, "record_id": one("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
               "target_uri": one("warc-target-uri"), "date": one("warc-date"), "content_type": one("content-type"),
               "stated_digest": stated.removeprefix("sha1:") if stated else None,
               "payload_digest": base64.b32encode(hashlib.sha1(block).digest()).decode() if full else None,
               "payload_bytes": len(block) if full else None, "header": header.decode("utf-8", "replace"), "payload": block if full else None}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, compressed (one member or one a record) or not."""
    arrow = to_arrow_schema(RECORD)

    def run(batches):
        for batch in batches:
            for value in batch.column("content"):
                body = value.as_py()
                stream = io.BytesIO(body)
                rows, held = [], 0
                for record in parse(io.BufferedReader(gzip.GzipFile(fileobj=stream)) if body[:2] == b"\x1f\x8b" else stream):
                    rows.append(record)
                    held += len(record["payload"] or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: main fields, ``request`` and ``metadata`` structs, and the ``original`` response of a revisit."""
    mains = records.where(F.col("type").isin("response", "revisit"))
    others = records.where(F.col("type").isin("request", "metadata"))
    forward = others.select(F.explode("concurrent_to").alias("main_id"), F.col("record_id").alias("other_id"))
    backward = mains.select(F.col("record_id").alias("main_id"), F.explode("concurrent_to").alias("other_id"))
    ties = forward.unionByName(backward).distinct()
    part = others.select(F.col("record_id").alias("other_id"), "type", F.struct("record_id", "header", "content_type", "payload").alias("part"))
    sides = settle(part.join(ties, "other_id").groupBy("main_id").agg(
        F.min(F.when(F.col("type") == "request", F.col("part"))).alias("request"), F.min(F.when(F.col("type") == "metadata", F.col("part"))).alias("metadata")))
    captures = mains.join(sides, mains["record_id"] == sides["main_id"], "left").drop("main_id")
    about = F.from_json(F.col("metadata.payload").cast("string"), "page_id long, url string")
    return captures.withColumn("page_id", about["page_id"]).withColumn("url", about["url"])


def with_originals(captures: DataFrame) -> DataFrame:
    """Revisits with the page, size and digest of the response they refer to."""
    originals = settle(captures.where("type = 'response'").select(
        F.col("record_id").alias("original_id"), F.col("page_id").alias("original_page"), F.col("payload_bytes").alias("original_bytes"), F.col("payload_digest").alias("original_digest")))
    return captures.join(originals, captures["refers_to"] == originals["original_id"], "left")
