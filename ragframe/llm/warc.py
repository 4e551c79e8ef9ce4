"""WARC archives: writing captures as transactions and assembling them again.

A capture is a request record, a response record (or a revisit of an earlier response with the same
payload) and a metadata record; the request and the metadata name the response's record in
WARC-Concurrent-To.  `write` makes gzipped files of such records, `read` parses any WARC file into one
row per record, `assemble` joins the records of a transaction into one nested row per capture.

Files are written by Spark's text sink, whose row separator is the blank lines that end a record, and
read by Spark's binaryFile source; so both work on any store that Spark reads.  A file holds the records of
about BYTES_PER_FILE, or one capture that is larger, and is one gzip member.  A reading task holds the
compressed file and takes its records from a stream, so its memory depends on neither the number of records
nor, beyond one record, their size.

Defined results.  Null html is an empty payload.  Of equal payloads the smallest page_id is the
response (a null page_id only where all are null; of repeated page_ids the one with the smallest record id); the others
revisit it.  Every row has its own record ids, so repeated rows give several captures.  An empty table
gives no files and no rows.  Records that no response or revisit names are left out by `assemble`; a
second request or metadata record for one capture is kept out, the smallest record id stays.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, saved, shared_dir

BYTES_PER_FILE = 1 << 25
#: The format's end of a record. Fixed by the standard.
RECORD_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, payload_digest string, payload_bytes long, block string, payload binary"


def base32_sha1(binary):
    """The bare base32 SHA-1 of a binary column, with built-in functions: eight groups of 20 bits give four letters each."""
    hexed = F.sha1(binary)
    groups = [F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    letters = F.lit(_BASE32)
    return F.concat(*[F.substring(letters, F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])


def transactions(pages: DataFrame) -> DataFrame:
    """uid, page_id, url, payload, digest, first_page and first_uid: what a page's records are made of."""
    rows = pages.select(F.expr("uuid()").alias("uid"), "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = saved(rows.withColumn("digest", base32_sha1(F.col("payload"))), "captures")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid"))
    groups = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    # payloads stay where they are: only the ids of repeated payloads are dealt, and joined back by row
    again = saved(rows.select("uid", "digest").join(groups, "digest").filter("uid <> first.uid").select("uid", F.col("first.uid").alias("first_uid"), F.col("first.page_id").alias("first_page")), "revisits")
    return rows.join(again, "uid", "left")


def _header(kind: str, record_id, fields: list) -> list:
    line = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:"), record_id, F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n")]
    for name, value in fields:
        line += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    return line


def _record(kind, record_id, fields, block) -> list:
    size = F.octet_length(block)
    return [*_header(kind, record_id, [*fields, ("Content-Length", size.cast("string"))]), F.lit("\r\n"), block]


def _named(uid, kind: str):
    """A record's id from its capture's: the same hex digits for the response, others for the rest."""
    hexed = F.md5(F.concat(uid, F.lit(kind)).cast("binary"))
    return F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def write(pages: DataFrame, path: str, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Three records for each row of pages (page_id, url, html) into gzipped WARC files under path."""
    rows = transactions(pages)
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]+", " ")
    uid, end = F.col("uid"), F.lit(RECORD_END)
    angle = lambda x: F.concat(F.lit("<urn:uuid:"), x, F.lit(">"))
    again = F.col("first_uid").isNotNull()
    own = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Target-URI", url), ("WARC-Payload-Digest", own)]
    # cast(binary as string) keeps the bytes as they are; the sink writes them unchanged
    full = F.concat(*_record("response", uid, [*common, ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("payload").cast("string"))))
    revisit = F.concat(*_record("revisit", uid, [*common, ("WARC-Refers-To", angle(F.col("first_uid"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))], http))
    asked = F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n"))
    request = F.concat(*_record("request", _named(uid, "request"), [("WARC-Target-URI", url), ("WARC-Concurrent-To", angle(uid)), ("Content-Type", F.lit("application/http; msgtype=request"))], asked))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = F.concat(*_record("metadata", _named(uid, "metadata"), [("WARC-Target-URI", url), ("WARC-Concurrent-To", angle(uid)), ("Content-Type", F.lit("application/warc-fields"))], fields))
    lines = rows.select(F.concat(request, end, F.when(again, revisit).otherwise(full), end, metadata).cast("binary").alias("value"))
    # a row for each file, since the sink counts rows only
    whole = lines.mapInArrow(_files(bytes_per_file), "value binary").select(F.col("value").cast("string").alias("value"))
    whole.write.option("compression", "gzip").option("lineSep", RECORD_END).option("maxRecordsPerFile", 1).text(path)


def _files(limit: int):
    """Joins rows to rows of about `limit` bytes, with the end of a record between them."""
    schema, end = pa.schema([("value", pa.binary())]), RECORD_END.encode()

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for value, n in zip(batch.column("value"), pc.binary_length(batch.column("value")).to_pylist(), strict=True):
                if held and size + n > limit:
                    yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], schema=schema)
                    held, size = [], 0
                held.append(value.as_py())
                size += n
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], schema=schema)

    return run


def _stream(content: bytes) -> io.BufferedIOBase:
    """The content without compression, as a stream: gzip with one or more members, or plain."""
    if content[:2] != b"\x1f\x8b":
        return io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16)


def records(content: bytes):
    """The records of a WARC file: (headers with lower-case names, block)."""
    stream = _stream(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head.get("content-length") or 0))


def _parse(keep_payload: bool):
    schema = arrow_schema(RECORD)

    def row(head: dict[str, str], block: bytes) -> dict:
        bare = lambda name: head[name].strip("<>").removeprefix("urn:uuid:") if name in head else None
        kind, payload = head.get("warc-type"), None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if payload is not None:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return {
            "record_id": bare("warc-record-id"), "record_type": kind, "concurrent_to": bare("warc-concurrent-to"), "refers_to": bare("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "warc_date": head.get("warc-date"),
            "payload_digest": digest, "payload_bytes": None if payload is None else len(payload), "block": block.decode("utf-8", "replace") if kind not in ("response", "revisit") else None, "payload": payload if keep_payload else None,
        }

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for head, block in records(content.as_py()):
                    held.append(row(head, block))
                    size += len(block) if keep_payload else 0
                    if len(held) >= 2000 or size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the WARC files under path; the digest of a response is taken from its bytes.

    Arrow batches are bounded by bytes (spark.sql.execution.arrow.maxBytesPerBatch), so files come a few at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_parse(keep_payload), RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: record_id, record_type, response, request and metadata as structs.

    A partial aggregate on the capture's id brings the records of a transaction together; an id has
    as many rows as its transaction has records, so no group is large.
    """
    part = F.struct("record_id", "target_uri", "warc_date", "refers_to", "payload_digest", "payload_bytes", "block", "payload")
    kind = F.col("record_type")
    main = kind.isin("response", "revisit", "resource")
    rows = found.select(F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture"), kind.alias("kind"), part.alias("part")).filter("capture is not null")
    one = lambda cond: F.min_by(F.when(cond, F.col("part")), F.when(cond, F.col("part.record_id")))
    is_main = F.col("kind").isin("response", "revisit", "resource")
    return rows.groupBy("capture").agg(
        F.min(F.when(is_main, F.col("kind"))).alias("record_type"), one(is_main).alias("response"), one(F.col("kind") == "request").alias("request"), one(F.col("kind") == "metadata").alias("metadata")
    ).filter("record_type is not null")


def round_trip(pages: DataFrame) -> DataFrame:
    """pages into archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    captures = assemble(read(spark, path, keep_payload=False))
    kind = pages.schema["page_id"].dataType.simpleString()
    page = F.expr(f"try_cast(nullif(regexp_extract(metadata.block, 'page-id: ([^\\r\\n]*)', 1), '') as {kind})")
    flat = saved(captures.select("capture", page.alias("page_id"), "record_type", F.col("response.refers_to").alias("target"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")), "flat")
    first = flat.filter("record_type = 'response'").select(F.col("capture").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"))
    joined = flat.filter("record_type = 'revisit'").drop("payload_bytes").join(first, "target").select("page_id", F.col("first_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return flat.filter("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to")).unionByName(joined)
