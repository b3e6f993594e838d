"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as a request, a response (or revisit) and a metadata record; request and metadata name the
response by WARC-Concurrent-To. Archives are written by Spark's text writer, whose line separator is the blank lines that
end a record, and read as binary files, in which records are found by their Content-Length, so a
payload may hold anything. Of captures with equal payloads (at least ``least`` bytes) the one with the smallest page_id
is the response; the others refer to it. ``assemble`` joins the records of a capture into one nested row and
finds the payload size of revisits through the response they refer to; no payload is shuffled there.

Large groups: equal payloads meet as digests with partial aggregation; the joins back are equi-joins on digests and record
ids, which adaptive execution can split. An archive holds what one write task holds; ``records_per_file`` bounds it.

Defined results: a null payload is empty; null urls become a header with no value and are read back as null; repeated
rows and ids are captures of their own, told apart by their number; of equal smallest ids one is the
response; a null page_id comes last; an empty table gives an empty table; other columns are not archived."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from traceframe.llm.columns import text_of

LINE, BLANK = "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 20_000
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes bigint, page_id bigint, digest_ok boolean, payload binary")


def base32_sha1(text: Column) -> Column:
    """Bare base32 of the SHA-1: five hexadecimal digits are four letters."""
    hexes = F.sha1(text.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def repeated_payloads(plain: DataFrame, path: str) -> DataFrame:
    """_sha, first_page: payloads of several captures. Written, so that Spark knows its size when it plans the join back."""
    own = plain.select("page_id", F.sha2("payload", 256).alias("_sha"))
    found = own.groupBy("_sha").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found.select("_sha", "first_page", F.lit(True).alias("_several")).write.parquet(path)
    return plain.sparkSession.read.parquet(path)


def uuid_of(page: Column, number: Column) -> Column:
    return F.concat_ws("-", F.col("_sha"), F.coalesce(page.cast("string"), F.lit("none")), number.cast("string"))


def with_targets(plain: DataFrame, path: str, least: int) -> DataFrame:
    """Adds uuid, digest and target (the uuid of the response that a revisit refers to). Only rows with repeated payloads are
    numbered; the first row of the smallest page_id is the response."""
    joined = plain.withColumn("_sha", F.sha2("payload", 256)).join(repeated_payloads(plain, path), "_sha", "left")
    same = Window.partitionBy("_sha", "page_id").orderBy("url")
    single = joined.filter("_several IS NULL").withColumn("_no", F.lit(1))
    several = joined.filter("_several").withColumn("_no", F.row_number().over(same))
    first = (F.col("_no") == 1) & F.col("page_id").eqNullSafe(F.col("first_page"))
    again = F.col("_several") & ~first & (F.octet_length("payload") >= least)
    return single.unionByName(several).select(
        "page_id", "url", "payload", base32_sha1(F.col("payload")).alias("digest"), uuid_of(F.col("page_id"), F.col("_no")).alias("uuid"),
        F.when(again, uuid_of(F.col("first_page"), F.lit(1))).alias("target"))


def record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, body: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # concat_ws leaves null lines out
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(LINE, *lines), F.lit(BLANK), body)


def urn(uuid: Column, part: str) -> Column:
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(f"-{part}>"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """One transaction of three records for each row of ``pages``, as archives under ``path``."""
    plain = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.regexp_replace(F.col(url), r"[\r\n]", " ").alias("url"), text_of(html).alias("payload"))
    found = with_targets(plain, f"{path}-repeated", least)
    revisit = F.col("target").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{BLANK}"), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    uri = ("WARC-Target-URI", F.col("url"))
    main = urn(F.col("uuid"), "response")
    records = F.array(
        record("request", urn(F.col("uuid"), "request"), [("WARC-Concurrent-To", main), uri], "application/http;msgtype=request",
               F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{BLANK}"))),
        record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), main,
               [uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.when(revisit, urn(F.col("target"), "response"))),
                ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))],
               "application/http;msgtype=response", http),
        record("metadata", urn(F.col("uuid"), "metadata"), [("WARC-Concurrent-To", main), uri], "application/warc-fields",
               F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(LINE))))
    (found.select(F.explode(records).alias("value")).write.option("lineSep", BLANK).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


HEADER = re.compile(rb"^([A-Za-z_-]+): ?(.*)$", re.M)


def parse(content: bytes):
    """Records of one archive: header fields and block."""
    at = 0
    while (at := content.find(b"WARC/1.1\r\n", at)) >= 0:
        end = content.index(b"\r\n\r\n", at)
        head = {k.decode(): v.rstrip(b"\r").decode() for k, v in HEADER.findall(content[at:end])}
        start, length = end + 4, int(head["Content-Length"])
        yield head, content[start:start + length]
        at = start + length


def read_batches(payloads: bool):
    import zlib

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                if content[:2] == b"\x1f\x8b":
                    parts = []
                    while content:  # archives may consist of many members
                        unzip = zlib.decompressobj(31)
                        parts.append(unzip.decompress(content))
                        content = unzip.unused_data
                    content = b"".join(parts)
                rows = []
                for head, block in parse(content):
                    kind = head["WARC-Type"]
                    digest = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    row = [head["WARC-Record-ID"], kind, head.get("WARC-Concurrent-To"), head.get("WARC-Refers-To"), head.get("WARC-Target-URI"), digest, None, None, None, None]
                    if kind == "response":
                        body = block[block.index(b"\r\n\r\n") + 4:]
                        real = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        row[5:7], row[8], row[9] = [real, len(body)], real == digest, body if payloads else None
                    elif kind == "metadata":
                        value = dict(HEADER.findall(block)).get(b"page_id", b"").strip()
                        row[7] = int(value) if value else None
                    rows.append(row)
                    if len(rows) == 2000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)
    return run


def batch_of(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All records of the archives under ``path``. Digests of responses are computed anew."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read_batches(payloads), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, request, response, metadata; payload_bytes also for revisits."""
    fields = [c for c in records.columns if c != "record_type"]
    whole = F.struct("record_type", *fields)
    part = lambda *kinds: F.first(F.when(F.col("record_type").isin(*kinds), whole), ignorenulls=True)
    captures = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("transaction")).agg(
        part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata"))
    targets = captures.filter("response.record_type = 'response'").select(
        F.col("transaction").alias("_to"), F.struct(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("bytes")).alias("target"))
    # Responses ask for themselves, so that they spread over the tasks like revisits.
    refers = F.col("response.refers_to")
    joined = captures.withColumn("_ask", F.coalesce(refers, "transaction")).join(targets, F.col("_ask") == F.col("_to"), "left")
    return joined.withColumn("target", F.when(refers.isNotNull(), F.col("target"))).drop("_to", "_ask")


def captures_of(assembled: DataFrame) -> DataFrame:
    """One flat row per capture."""
    return assembled.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("response.payload_bytes", "target.bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.col("target.page_id").alias("refers_to"))
