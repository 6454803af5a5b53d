"""WARC archives: writing, reading back, and revisit records for payloads already stored."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import scratch, staged

#: Payloads below this many bytes are stored again: a revisit record would not be smaller.
LEAST_BYTES = 100
#: Payload bytes that an archive file should hold; one larger record makes a larger file.
FILE_BYTES = 24 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, record_type string, refers_to_id string, page_id long, url string, payload_digest string, payload binary"


def headers(pages: DataFrame) -> DataFrame:
    """``pages`` with a row number and the payload's size and digest, staged; a null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return staged(rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest")), "headers", "zstd")


def resolved(head: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``(row, target)`` of the rows that revisit another: the row of the smallest page_id with an equal payload.

    Only headers are shuffled, by digest. Minima combine before the shuffle, and a digest that a third of all records
    share is split by the join. Null ids come after all others; among rows with one id the first is the original.
    """
    large = head.where(F.col("payload_bytes") >= least).select("row", "page_id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0)), F.col("row"))).alias("first"), F.count("*").alias("n"))
    first = staged(first.where("n > 1").select("payload_digest", F.col("first.row").alias("target")), "originals")
    return staged(large.join(first, "payload_digest").where(F.col("row") != F.col("target")).select("row", "target"), "revisits")


def _record_id(row: Column, seed: str) -> Column:
    h = F.md5(F.concat(F.lit(f"{seed}/"), row.cast("string")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _field(name: str, value: Column) -> Column:
    """A header line; white space and control characters can't break it."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x20\x7f]", "%20"), F.lit("\r\n")))


def write_archives(head: DataFrame, revisits: DataFrame, path: str, date: str, seed: str) -> None:
    """Archives with fresh headers: a response with its payload for originals, a bare revisit for the others. Both hold
    an HTTP header block, as records of web pages do. Payloads are shuffled once, at every size.

    Spark's text writer ends each record with the two line breaks that WARC asks for, on any file system and with its
    commit protocol, so a lost executor leaves no torn file.
    """
    files = max(1, -(-int(head.agg(F.sum("payload_bytes")).first()[0] or 0) // FILE_BYTES))
    rows = head.repartition(files, "row").join(revisits.hint("shuffle_hash"), "row", "left")
    again = F.col("target").isNotNull()
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"), F.when(again, F.lit("")).otherwise(F.col("payload")))
    lines = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(again, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.lit("WARC-Record-ID: <urn:uuid:"), _record_id(F.col("row"), seed), F.lit(f">\r\nWARC-Date: {date}\r\n"),
        _field("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit("\r\n"),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), _record_id(F.col("target"), seed), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        _field("X-Page-ID", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )
    rows.select(lines.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and content of each record, by its Content-Length."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        content = stream.read(size)
        if len(content) != size:
            raise ValueError("a record ends before its Content-Length")
        yield fields, content


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives below ``path``; a file is a task, its records stream in small batches."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_buffer()
                stream = pa.BufferReader(raw) if raw is not None else io.BytesIO()
                held, size = [], 0
                with io.BufferedReader(gzip.GzipFile(fileobj=stream)) as records:
                    for fields, content in parse(records):
                        if fields.get("content-type", "").startswith("application/http"):
                            content = content[content.find(b"\r\n\r\n") + 4 :]
                        page, refers = fields.get("x-page-id"), fields.get("warc-refers-to", "")
                        held.append((fields["warc-record-id"][10:-1], fields["warc-type"], refers[10:-1] or None, int(page) if page else None, fields.get("warc-target-uri"), fields["warc-payload-digest"].partition(":")[2], content))
                        size += len(content)
                        if size > 4 << 20 or len(held) >= 2000:
                            yield _batch(held, kinds, names)
                            held, size = [], 0
                if held:
                    yield _batch(held, kinds, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def _batch(held: list, kinds: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def revisited(records: DataFrame) -> DataFrame:
    """Each record with the size and the digest of its full payload, a revisit's taken from the response it refers to.

    A revisit whose response isn't in the archives keeps its digest and has a null size. The digest of a response is
    computed from its content, not read from its header.
    """
    plain = staged(records.select("record_id", "record_type", "refers_to_id", "page_id", "url", "payload_digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest")), "records")
    targets = staged(plain.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("full_bytes"), F.col("digest").alias("full_digest")), "targets")
    again = plain.where("record_type = 'revisit'").join(targets, "refers_to_id", "left").select("page_id", "url", F.col("full_bytes").alias("payload_bytes"), F.coalesce("full_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
    first = plain.where("record_type <> 'revisit'").select("page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again)


def deduplicate(pages: DataFrame, path: str | None = None, date: str = "2000-01-01T00:00:00Z", least: int = LEAST_BYTES) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` below ``path`` without storing a payload twice, and read the archives back.

    Returns ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` for every row. Repeated rows are
    records of their own; a null url has no URI field; other columns are left out. ``date`` goes to every record, so
    that reruns write the same archives. An empty table writes no record.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "archives")
    head = headers(pages)
    write_archives(head, resolved(head, least), path, date, "tidemark")
    return revisited(read_archives(spark, path))
