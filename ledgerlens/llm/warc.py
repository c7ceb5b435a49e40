"""WARC archives: a writer, and a sequential reader of one gzip member per record.

``write_archives`` writes a ``response`` record per page, or a ``revisit`` when an
equal payload of at least ``min_bytes`` belongs to a page with a smaller id.
Every task writes files of its own, with names that no other attempt uses; the
manifest lists the files of the attempts that succeeded. ``read_archives`` reads
each file from front to back: zlib decompression of one member at a time,
framing by Content-Length, digests verified. Memory is bounded by the longest
record.

Files are opened through ``pyarrow.fs``, so the folder may be any shared place
that it knows (``file:``, ``hdfs:``, ``s3:``, ``gs:``).

Defined cases: a null or empty html is an empty payload, always a response; of
equal payloads all rows with the smallest id are responses; rows without an id
refer to the smallest id there is; a null url leaves the header out, control
characters and spaces in a url are escaped; an empty table writes no file and
reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path

from .common import written

MIN_BYTES = 100
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 18
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL_SAFE = "".join(chr(c) for c in range(33, 127))


class WarcError(ValueError):
    """A file that breaks the format, or a digest that doesn't fit its record."""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def gzip_record(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                revisit: bool, date: str = DATE) -> bytes:
    head = http_head(len(payload))
    block = head if revisit else head + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
               ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response"),
               ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=_URL_SAFE)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page-Id", str(refers_to)))
    return gzip_record(headers, block)


def read_members(stream: BinaryIO, size: int = READ_BYTES) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, one after another."""
    data = stream.read(size)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpack.decompress(data))
            if unpack.eof:
                data = unpack.unused_data or stream.read(size)
                break
            data = stream.read(size)
            if not data:
                raise WarcError("the file ends within a member")
        yield b"".join(parts)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record that fills its member exactly."""
    at = member.find(b"\r\n\r\n")
    if at < 0 or not member.startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    headers = {}
    for line in member[:at].decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    length = int(headers["content-length"])
    block = member[at + 4:at + 4 + length]
    if len(block) != length or member[at + 4 + length:] != b"\r\n\r\n":
        raise WarcError("content length and member do not fit")
    own = headers.get("warc-block-digest")
    if own and own != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError(f"block digest of {headers.get('warc-record-id')} does not fit")
    return headers, block


def parse_page(member: bytes) -> dict:
    """A page record's columns; the payload's digest is verified where the record holds it."""
    headers, block = parse_record(member)
    kind = headers["warc-type"]
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError(f"payload digest of {headers.get('warc-record-id')} does not fit")
    own, other = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    return {"page_id": None if own is None else int(own), "url": headers.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": size, "payload_digest": digest, "refers_to": None if other is None else int(other),
            "payload": payload if kind == "response" else None}


def _open(uri: str):
    from pyarrow import fs
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, html, digest, revisit, refers_to``: only groups of equal payloads join back,
    on their digest; a payload that many pages share is a splittable join, never one group."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "digest", F.sha2("html", 256))
    groups = (own.where(F.octet_length("html") >= min_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
              .select(F.struct("digest", "first").alias("group")))
    revisit = F.col("group").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("group.first"))
    return own.join(groups, own["digest"] == groups["group"]["digest"], "left").select(
        "page_id", "url", "html", "digest", revisit.alias("revisit"),
        F.when(revisit, F.col("group.first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages to ``folder``; returns the manifest (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        done, out, records, size = [], None, 0, 0
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")]):
                if out is None:
                    done.append([f"{folder}/{name}-{len(done):05d}.warc.gz", 0, 0])
                    out, records, size = store.open_output_stream(f"{base}/{name}-{len(done) - 1:05d}.warc.gz",
                                                                  compression=None), 0, 0
                data = page_record(row[0], row[1], row[2].encode(), *row[3:])
                out.write(data)
                records, size = records + 1, size + len(data)
                done[-1][1:] = [records, size]
                if size >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64()),
                                          pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    rows = with_revisits(pages, min_bytes)
    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the files: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, and the payload itself if asked for."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, inner = _open(path)
                rows, held = [], 0
                with store.open_input_stream(inner, compression=None) as stream:
                    for member in read_members(stream):
                        row = parse_page(member)
                        if not payloads:
                            row.pop("payload")
                        rows.append(row)
                        held += len(member) if payloads else 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    spark_type = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    files = manifest.select("path").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, spark_type + ", payload binary" * payloads)


def round_trip(spark: SparkSession, pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write ``pages`` under the shared folder and read the archives back."""
    return read_archives(write_archives(pages, scratch_path(spark, "warc")), payloads)
