"""Zstandard WARC archives: one frame for each record, the dictionary in a skippable frame at the front.

Writing. Each task streams its rows into archives of about ARCHIVE_BYTES and
reports them in a manifest, which Spark commits like any other output. Files
carry a name of their own for each attempt, so a retried or lost task leaves at
most a file that no manifest names. Reading. Tasks take archives from the
manifest and stream them frame by frame, through a file system that pyarrow
opens by URI (local, HDFS, S3 also as s3a, GCS); a task never holds more than one record
and one read buffer. Every header block and length is validated, and a response's
digest is checked against its payload.

Scale. Which page is the response is settled on (page_id, digest) rows, by a
partial aggregate; only payloads that occur more than once take part in the
join. Pages are shuffled once at most. The dictionary is trained on a bounded
sample, SAMPLE_PAGES pages of SAMPLE_BYTES; it changes sizes, never contents.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, open_uri, shared_dir

ARCHIVE_BYTES = 64 << 20
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 32 << 10
READ_BYTES = 1 << 20

#: The magic numbers of the Zstandard format, and the version and profile lines of WARC 1.1.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class ArchiveError(ValueError):
    """An archive that isn't what it says."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """A response with its HTTP block, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = [
        VERSION.decode(), f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if is_revisit:
        lines += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ArchiveError(f"not a header line: {line[:80]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def _page(urn: str) -> int | None:
    match = re.fullmatch(r"<urn:page:(-?\d*)>", urn)
    if not match:
        raise ArchiveError(f"not a record id: {urn[:80]}")
    return int(match[1]) if match[1] else None


def parse_record(record: bytes) -> dict:
    """The fields of one validated record."""
    version, _, rest = record.partition(b"\r\n")
    head, blank, body = rest.partition(b"\r\n\r\n")
    if version != VERSION or not blank:
        raise ArchiveError("not a WARC record")
    headers = _headers(head)
    if missing := [k for k in REQUIRED if k not in headers]:
        raise ArchiveError(f"headers missing: {missing}")
    length = int(headers["content-length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ArchiveError(f"block of {len(body)} bytes, Content-Length {length}")
    http, blank, payload = body[:length].partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP header in the block")
    size = int(_headers(http.partition(b"\r\n")[2])["content-length"])
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ArchiveError("the payload isn't the one described")
    if kind == "revisit" and (payload or headers.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in headers):
        raise ArchiveError("not a revisit of an identical payload")
    return {"page_id": _page(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads, or nothing where there are too few."""
    text = F.coalesce(F.col("html"), F.lit(""))
    sample = bounded_sample(pages, SAMPLE_PAGES, "page_id").filter(F.length(text) > 0).select(F.substring(text, 1, SAMPLE_BYTES).alias("t")).limit(2 * SAMPLE_PAGES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.t.encode() for r in sample]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _write_task(folder: str, dictionary: bytes, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    store, base = open_uri(folder)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)
    out, name, size, n = None, "", 0, 0
    for frame in frames:
        done = []
        for page_id, html, known, first in zip(frame["page_id"], frame["html"], frame["known"], frame["first"], strict=True):
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                out, size, n = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                if dictionary:
                    size += out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
            own = None if pd.isna(page_id) else int(page_id)
            first = None if pd.isna(first) else int(first)
            size += out.write(compressor.compress(record_bytes(own, (html or "").encode(), first, bool(known) and own != first)))
            n += 1
            if size >= ARCHIVE_BYTES:
                out.close()
                done.append((name, n, size))
                out = None
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])
    if out is not None:
        out.close()
        yield pd.DataFrame([(name, n, size)], columns=["archive", "records", "bytes"])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of `pages` (page_id, html) as a record; returns the committed manifest (archive, records, bytes).

    Of equal payloads, empty ones too, the one with the smallest page_id is the
    response, and the others revisit it. A null html is empty. A null page_id
    sorts last; rows that share the smallest page_id are all responses. Other
    columns are ignored.
    """
    store, base = open_uri(folder)
    store.create_dir(base, recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    copies = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first", F.lit(True).alias("known"))
    roles = rows.join(copies, "digest", "left").select("page_id", "html", "known", "first")
    dictionary = train_dictionary(pages)
    return cut(roles.mapInPandas(lambda frames: _write_task(folder, dictionary, frames), "archive string, records long, bytes long"), "warc-manifest")


class _Buffer:
    """Bytes of a stream, a piece at a time."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.stream.read(READ_BYTES)):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        if len(got := self.peek(n)) < n:
            raise ArchiveError("the archive ends inside a frame")
        self.held = self.held[n:]
        return got


def read_records(stream) -> Iterator[dict]:
    """The records of one archive, frame by frame."""
    buffer = _Buffer(stream)
    dictionary = None
    if buffer.peek(4) == struct.pack("<I", DICTIONARY_FRAME):
        _, size = struct.unpack("<II", buffer.take(8))
        raw = buffer.take(size)
        if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while head := buffer.peek(4):
        if len(head) < 4:
            raise ArchiveError("the archive ends inside a frame")
        if 0x184D2A50 <= struct.unpack("<I", head)[0] <= 0x184D2A5F:
            buffer.take(struct.unpack("<II", buffer.take(8))[1])
            continue
        frame, record = decompressor.decompressobj(), []
        while not frame.eof:
            if not buffer.peek(1):
                raise ArchiveError("the archive ends inside a frame")
            record.append(frame.decompress(buffer.held))
            buffer.held = frame.unused_data
        yield parse_record(b"".join(record))


def read_archives(manifest: DataFrame, folder: str, *, payloads: bool = False) -> DataFrame:
    """Every record of the archives in `manifest`: (page_id, payload_bytes, payload_digest, record_type, refers_to), and payload if asked for."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_uri(folder)

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(columns, types, strict=True)], columns)

        for batch in batches:
            for name, expected in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                rows, n, held = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for record in read_records(stream):
                        n += 1
                        held += len(record["payload"] or b"") * payloads
                        rows.append(record if payloads else {**record, "payload": None})
                        if len(rows) >= 5000 or held > READ_BYTES * 16:
                            yield batch_of(rows)
                            rows, held = [], 0
                if n != expected:
                    raise ArchiveError(f"{name} has {n} records, its manifest says {expected}")
                yield batch_of(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    tasks = max(1, min(10_000, manifest.count()))
    return manifest.select("archive", "records").repartition(tasks).mapInArrow(task, schema)


def archive_report(pages: DataFrame) -> DataFrame:
    """Archive all pages, and what reading the archives back says of each."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), folder)
