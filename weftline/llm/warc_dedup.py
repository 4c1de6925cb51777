"""WARC archives with revisit resolution.

Record headers are shuffled by payload digest; each digest's original response is
the one with the smallest page id, and later records become revisits of it, written
without payload and with fresh headers. Archives are written and read by Spark, so
they may lie wherever Spark's file systems reach: a record is one string, and the
two line ends that close a WARC record are the writer's separator, which gives
plain `warc.gz`-compatible streams (gzip, one member a file).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._shared import shared_folder, stored

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 5 hexadecimal digits at a time give 4 of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of pages; a null html is empty."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload.cast("binary")).alias("payload_digest"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast(pages.schema[id_col].dataType).alias("refers_to"),
    )


def resolved(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`records` with record_type and refers_to set anew.

    Of responses with equal payloads of at least `min_bytes` bytes that with the
    smallest page_id stays a response. The others, and revisits that came without
    payload, refer to it. A revisit whose original isn't here stays as it was. Rows
    without page_id stay responses, and so do rows that repeat the id and payload of
    an original. Equal payloads are those with equal digest and length.
    """
    first = records.where("record_type = 'response' and page_id is not null").where(F.col("payload_bytes") >= min_bytes)
    first = first.groupBy(F.col("payload_digest").alias("o_digest"), F.col("payload_bytes").alias("o_bytes")).agg(
        F.min("page_id").alias("original"), F.max("page_id").alias("last")
    )
    if records.where("record_type = 'revisit'").isEmpty():
        first = first.where("original < last")  # a payload that came once has no revisit
    first = stored(first.drop("last"), "warc-originals")
    joined = records.join(
        first,
        (F.col("payload_digest") == F.col("o_digest"))
        & F.coalesce(F.col("payload_bytes") == F.col("o_bytes"), F.col("record_type") == "revisit"),
        "left",
    )
    later = F.coalesce(F.col("page_id") > F.col("original"), F.lit(False)) | (
        (F.col("record_type") == "revisit") & F.col("original").isNotNull()
    )
    return (
        joined.withColumn("refers_to", F.when(later, F.col("original")).otherwise(F.col("refers_to")))
        .withColumn("record_type", F.when(later, "revisit").otherwise(F.col("record_type")))
        .withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
        .select(records.columns)
    )


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write records as gzipped WARC files below `path`, one per partition, with fresh headers."""
    response = F.col("record_type") == "response"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), "payload_bytes", F.lit(CRLF + CRLF)
    )
    block = F.when(response, F.concat(http, "payload")).otherwise("")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(response, "").otherwise(
            F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _id(F.col("refers_to"))))
        ),
        F.when(response, line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(""),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    records.select(F.concat(head, block).alias("record")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open WARC stream; one record is held at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """Records of the WARC files below `path`; length and digest of a response are taken from its payload."""
    text = pa.string()
    kinds = [text, text, text, pa.int64(), text, text, text]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def record(headers: dict[str, str], block: bytes) -> tuple:
        page = lambda x: x[len("<urn:x-page:") : -1] or None
        body, size = None, None
        digest = headers["WARC-Payload-Digest"].partition(":")[2]
        if headers["WARC-Type"] == "response":
            body = block[block.index(b"\r\n\r\n") + 4 :]
            size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        refers = page(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None
        shown = body.decode() if payloads and body is not None else None
        return page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), shown, size, digest, headers["WARC-Type"], refers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for headers, block in parse_archive(gzip.open(io.BytesIO(content.as_buffer()))):
                    rows.append(record(headers, block))
                    size += len(block) if payloads else 0
                    if len(rows) == 2000 or size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(
        run, "page_id string, url string, payload string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    )
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def deduplicated(spark: SparkSession, source: str, target: str, id_type: str = "bigint", min_bytes: int = 0) -> DataFrame:
    """Read the archives below `source`, resolve revisits, write them below `target`; its headers."""
    write_archives(resolved(stored(read_archives(spark, source, id_type, payloads=True), "warc-records"), min_bytes), target)
    return with_lengths(read_archives(spark, target, id_type))


def with_lengths(records: DataFrame) -> DataFrame:
    """Records without payloads; a revisit has the payload length of the response that it refers to."""
    heads = stored(records.drop("payload"), "warc-headers")
    originals = heads.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("o_id"), F.col("payload_digest").alias("o_digest"), F.col("payload_bytes").alias("o_bytes")
    )
    originals = stored(originals.join(heads.where("record_type = 'revisit'").select(F.col("refers_to").alias("o_id")), "o_id", "left_semi").distinct(), "warc-targets")
    found = heads.join(
        originals, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("o_id")) & (F.col("payload_digest") == F.col("o_digest")), "left"
    )
    return found.withColumn("payload_bytes", F.coalesce("payload_bytes", "o_bytes")).select(heads.columns)


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write `pages` as deduplicated archives, read these back, and return (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null htmls are empty payloads; an empty table gives no archive and no row. See
    `resolved` for null and repeated ids. Other columns are not read.
    """
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_archives(resolved_pages(pages, min_bytes), path)
    found = with_lengths(read_archives(spark, path, pages.schema["page_id"].dataType.simpleString()))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def resolved_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    return resolved(page_records(pages), min_bytes)
