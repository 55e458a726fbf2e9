"""Archives: members of zip and tar files, streamed.

Two ways in. `expand_archives` opens archives that come as a column of bytes.
`read_archives` reads files by ranges: tasks read the directory at each zip's tail
and plan parts of it, and other tasks read a part each, so one zip of very many
members is read by many tasks and no task ever holds an archive. A tar has no
directory, so it is one part, read as a stream.

The kind is told by the first bytes, not by the name: zip, and tar, plain or
compressed by gzip, bzip2, xz or Zstandard. A member is streamed into its size and digest; its
content is kept up to a bound, beyond which it is flagged `large`. One
that gives more than `most` bytes is flagged `bomb` and left there. Whatever is
damaged gives a row with an error and ends no job; streams are read to their end, where
their checksums are. `whole_archives` leaves out archives with any error.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut
from .trees import list_tree, open_uri

#: What damaged or unsupported archives raise. Failures of the store itself are StoreError, and end the task, to be tried again.
DAMAGE = (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError, NotImplementedError, RuntimeError, ValueError, struct.error, OverflowError, KeyError, IndexError)
PIECE = 1 << 20
#: Bytes of content kept of a member, bytes that one may have at most, and bytes of rows held before they are sent on.
KEEP, MOST, HELD = 64 << 20, 64 << 30, 32 << 20
#: Compressed bytes and members of a part of a zip.
PART_BYTES, PART_MEMBERS = 64 << 20, 256

COLUMNS = "path string, size long, sha256 string, content binary, flag string, error string"


class StoreError(Exception):
    """The file couldn't be read, whatever is in it."""


class _Stored(io.RawIOBase):
    """A file of a store, by ranges; its failures are StoreError."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def _do(self, call, *args):
        try:
            return call(*args)
        except OSError as error:
            raise StoreError(str(error)) from error

    def seek(self, offset: int, whence: int = 0) -> int:
        if (whence == 0 and offset < 0) or (whence == 2 and offset + self.file.size() < 0):
            raise ValueError("a place before the file")
        self._do(self.file.seek, offset, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self._do(self.file.read, len(buffer))
        buffer[: len(data)] = data
        return len(data)


def kind(head: bytes) -> str:
    """zip, gzip, bzip2, xz, zstd, or tar for anything else: a plain tar says so at byte 257, or not at all."""
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        return "zip"
    marks = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
    return next((name for mark, name in marks.items() if head.startswith(mark)), "tar")


def _unpacked(name: str, source: io.IOBase) -> io.IOBase:
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
    opener = {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}.get(name)
    return opener(source) if opener else source


def _member(path: str, stream: io.IOBase, keep: int, most: int) -> dict:
    """Size, digest and content of a member, from its bytes."""
    size, digest, held = 0, hashlib.sha256(), []
    while data := stream.read(PIECE):
        size += len(data)
        digest.update(data)
        if size <= keep:
            held.append(data)
        else:
            held = []
        if size > most:
            return {"path": path, "size": size, "flag": "bomb"}
    large = size > keep
    return {"path": path, "size": size, "sha256": digest.hexdigest(), "content": None if large else b"".join(held), "flag": "large" if large else None}


def _named(name: str) -> str:
    return name.encode("utf-8", "replace").decode()


def zip_members(source: io.IOBase, first: int = 0, last: int | None = None, keep: int = KEEP, most: int = MOST) -> Iterator[dict]:
    """A zip's files, or those of some places in its directory; each damaged one has an error of its own."""
    with zipfile.ZipFile(source) as archive:
        for item in archive.infolist()[first:last]:
            if item.is_dir():
                continue
            try:
                with archive.open(item) as stream:
                    yield _member(_named(item.filename), stream, keep, most)
            except DAMAGE as error:
                yield {"path": _named(item.filename), "error": type(error).__name__}


def tar_members(name: str, source: io.IOBase, keep: int = KEEP, most: int = MOST) -> Iterator[dict]:
    """A tar's files in order, through whatever it is compressed with; then the rest of the stream, for its checksum."""
    with _unpacked(name, source) as stream:
        with tarfile.open(fileobj=stream, mode="r|") as archive:
            for item in archive:
                if item.isfile():
                    yield _member(_named(item.name), archive.extractfile(item), keep, most)
        while stream.read(PIECE):
            pass


def members(source: io.IOBase, keep: int = KEEP, most: int = MOST) -> Iterator[dict]:
    """The files of an archive; if it is damaged, at last a row without a path, with the error."""
    try:
        name = kind(source.read(8))
        source.seek(0)
        yield from zip_members(source, keep=keep, most=most) if name == "zip" else tar_members(name, source, keep, most)
    except DAMAGE as error:
        yield {"error": type(error).__name__}


def _sent(rows: Iterator[tuple[dict, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, each of two parts, in batches of about HELD bytes."""
    out, held = [], 0
    for key, row in rows:
        out.append(key | row)
        held += len(row.get("content") or b"") + 200
        if held > HELD:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


_SCHEMA = [("path", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("content", pa.binary()), ("flag", pa.string()), ("error", pa.string())]


def expand_archives(archives: DataFrame, *, keep: int = KEEP, most: int = MOST) -> DataFrame:
    """archives (package_id, path, content) -> (package_id, archive, path, size, sha256, content, flag, error), a row for each inner file.

    An archive without content has an error. A task holds one archive, and of
    what comes out of it HELD bytes and one member's content.
    """
    schema = pa.schema([("package_id", pa.string()), ("archive", pa.string()), *_SCHEMA])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package, name, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                key = {"package_id": package.as_py(), "archive": name.as_py()}
                found = members(io.BytesIO(data.as_py()), keep, most) if data.is_valid else iter([{"error": "NoContent"}])
                yield from _sent(((key, row) for row in found), schema)

    return archives.select("package_id", "path", F.col("content").cast("binary").alias("content")).mapInArrow(task, f"package_id string, archive string, {COLUMNS}")


def _plan_task(part_bytes: int, part_members: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(archive, kind, first, last): parts of each archive. Reads the first bytes, and of a zip the directory."""
    for batch in batches:
        rows = []
        for uri in batch.column(0).to_pylist():
            store, path = open_uri(uri)
            with store.open_input_file(path) as file:
                source = io.BufferedReader(_Stored(file), 1 << 16)
                name = kind(source.read(8))
                if name != "zip":
                    rows.append((uri, name, 0, None))
                    continue
                try:
                    with zipfile.ZipFile(source) as archive:
                        sizes = [item.compress_size for item in archive.infolist()]
                except DAMAGE:
                    rows.append((uri, name, 0, None))  # the task that reads it says so
                    continue
            first = held = 0
            for k, size in enumerate(sizes):
                if k > first and (held + size > part_bytes or k - first >= part_members):
                    rows.append((uri, name, first, k))
                    first, held = k, 0
                held += size
            rows.append((uri, name, first, len(sizes)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())], ["archive", "kind", "first", "last"])


def _read_task(keep: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), *_SCHEMA])

    def found(uri: str, name: str, first: int, last: int | None) -> Iterator[tuple[dict, dict]]:
        store, path = open_uri(uri)
        with store.open_input_file(path) as file:
            source = io.BufferedReader(_Stored(file), PIECE)
            try:
                for row in zip_members(source, first, last, keep, most) if name == "zip" else tar_members(name, source, keep, most):
                    yield {"archive": uri}, row
            except DAMAGE as error:
                yield {"archive": uri}, {"error": type(error).__name__}

    for batch in batches:
        for part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield from _sent(found(*part), schema)


def plan_archives(spark: SparkSession, root: str, *, part_bytes: int = PART_BYTES, part_members: int = PART_MEMBERS) -> DataFrame:
    """(archive, kind, first, last) of the parts of all archives below a folder; of zips only the tails are read."""
    listed = list_tree(spark, root, "^$").filter("kind = 'file'").select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"))
    return listed.mapInArrow(partial(_plan_task, part_bytes, part_members), "archive string, kind string, first long, last long")


def read_archives(spark: SparkSession, root: str, *, part_bytes: int = PART_BYTES, part_members: int = PART_MEMBERS, keep: int = KEEP, most: int = MOST, tasks: int | None = None) -> DataFrame:
    """(archive, path, size, sha256, content, flag, error) of each member of the archives below a folder.

    Parts are dealt to `tasks` tasks, by default one for each sixteen parts, and as many as run
    at once at least. A folder without archives has no rows. Works with stores that pyarrow opens.
    """
    parts = plan_archives(spark, root, part_bytes=part_bytes, part_members=part_members)
    many = tasks or max(spark.sparkContext.defaultParallelism, -(-parts.count() // 16))
    return parts.repartition(many).mapInArrow(partial(_read_task, keep, most), f"archive string, {COLUMNS}")


def whole_archives(found: DataFrame) -> DataFrame:
    """The members of archives without any error, by `archive`, and `package_id` if there is one.

    What was found is written once and read twice, so that no archive is opened twice; drop the content before, if it isn't needed.
    """
    found = cut(found, "archive-members")
    key = [c for c in ("package_id", "archive") if c in found.columns]
    bad = found.filter(F.col("error").isNotNull()).select(*(F.col(c).alias(f"bad_{c}") for c in key)).distinct()
    same = [found[c].eqNullSafe(bad[f"bad_{c}"]) for c in key]
    return found.join(bad, same, "left_anti")
