"""WARC archives: written in bounded files with an index first, read back by coalesced byte ranges.

Writing. Each task writes its rows as WARC/1.1 records, one gzip member a record, into archive
files of its own in the shared folder and returns the index rows: archive, offset, length, URL
and digest of every record. Only the index, a table that Spark commits, says which archives
count, so files that a lost or repeated task leaves behind are never read. Of records with
equal payloads of at least LEAST_BYTES bytes, that with the smallest page_id is a response and
the others revisit it.

Reading. The selected index rows are sorted by archive and offset over range partitions;
neighbouring ranges are read together as long as the gap is small and the span bounded.

Skew: equal payloads meet only as (digest, smallest page_id) pairs, combined before the
shuffle; payloads are not shuffled unless the table of revisits is beyond Spark's broadcast
size, and then by page_id.

Cases: null html is an empty payload; null url an empty target. Rows that repeat both page_id
and payload tie: if theirs is the smallest page_id, all of them are responses. A null page_id
never is the smallest one; a copy without page_id revisits the smallest that has one, and if
none has, each of them is a response. Payloads of any length are one record. An empty table
gives archives without records; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, scratch, slices, stored, table

LEAST_BYTES = 100
#: An archive is closed when it has grown to so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Ranges at most GAP bytes apart are read together, up to SPAN bytes at a time.
GAP, SPAN = 64 << 10, 4 << 20
INDEX = "archive string, offset long, length long, url string, digest string, page_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def opened(uri: str):
    """The file system of a URI, as tasks reach it, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(kind: str, page: int | None, url: str, payload: bytes, size: int, digest: str, refers: int | None) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:page:{'' if page is None else page}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + " ".join(url.split()).encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % size, b"Content-Type: text/html"]
    if kind == "revisit":
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers]
        payload = b""
    body = b"\r\n".join([*lines, b"Content-Length: %d" % len(payload), b"", payload]) + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(body) + pack.flush()


def info() -> bytes:
    """The record that an archive begins with; it is not in the index."""
    text = b"software: corvox\r\nformat: WARC File Format 1.1\r\n"
    lines = [b"WARC/1.1", b"WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z", b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(text)]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join([*lines, b"", text]) + b"\r\n\r\n") + pack.flush()


def number(text: bytes) -> int | None:
    part = text.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(part) if part else None


def parsed(member: bytes) -> tuple:
    """The fields of RECORD from one gzip member."""
    body = zlib.decompress(member, 31)
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) if b": " in x else (x.rstrip(b": "), b"") for x in head.split(b"\r\n")[1:])
    payload = rest[: int(fields[b"Content-Length"])]
    kind = fields[b"WARC-Type"].decode()
    page, url = number(fields[b"WARC-Record-ID"]), fields.get(b"WARC-Target-URI", b"").decode()
    if kind == "revisit":
        return page, url, int(fields[b"X-Payload-Length"]), fields[b"WARC-Payload-Digest"].decode().partition(":")[2], kind, number(fields[b"WARC-Refers-To"]), None
    digest = hashlib.sha256(payload).hexdigest()
    if fields[b"WARC-Payload-Digest"] != b"sha256:" + digest.encode():
        raise ValueError(f"payload of page {page} does not have the recorded digest")
    return page, url, len(payload), digest, kind, None, payload


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat another's payload."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size")).where(f"size >= {LEAST_BYTES}").select("page_id", "digest")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return stored(rows.join(first, "digest").where("not (page_id <=> refers_to)").distinct(), "revisits")


def write_warc(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of pages(page_id, url, html) into archives below folder and returns the stored index."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    folder = folder or scratch(pages.sparkSession, "warc")
    seen = revisits(pages)
    rows = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    same = rows["page_id"].eqNullSafe(seen["page_id"]) & (rows["digest"] == seen["digest"])
    rows = rows.join(seen, same, "left").select(*(rows[c] for c in ("page_id", "url", "html", "digest")), "refers_to")
    schema = arrow_schema(INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for part in slices(batches, "html"):
                index = []
                for page, url, html, digest, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, head = f"{uuid.uuid4().hex}.warc.gz", info()
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                        out.write(head)
                        at = len(head)
                    payload = html.encode()
                    member = record("response" if refers is None else "revisit", page, url or "", payload, len(payload), digest, refers)
                    out.write(member)
                    index.append((name, at, len(member), url, digest, page))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*index, strict=True), schema, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    return stored(rows.mapInArrow(write, INDEX), "warc-index").withColumn("folder", F.lit(folder))


def read_warc(index: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records of the given index rows (any selection of a write_warc index), columns RECORD."""
    n = index.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = index.select("folder", "archive", "offset", "length").repartitionByRange(int(n), "folder", "archive", "offset").sortWithinPartitions("folder", "archive", "offset")
    schema = arrow_schema(RECORD)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Neighbouring ranges of one archive that are read together."""
        name, held = None, []
        for b in batches:
            for folder, archive, offset, length in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                where = f"{folder}/{archive}"
                if held and (where != name or offset - sum(held[-1]) > gap or offset + length - held[0][0] > span):
                    yield name, held
                    held = []
                name = where
                held.append((offset, length))
        if held:
            yield name, held

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name, files = None, None, None
        for where, held in ranges(batches):
            if where != name:
                files, path = opened(where)
                source, name = files.open_input_file(path), where
            first = held[0][0]
            block = source.read_at(sum(held[-1]) - first, first)
            rows = [parsed(block[o - first : o - first + n]) for o, n in held]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return order.mapInArrow(read, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
