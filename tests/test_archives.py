"""Archives that are damaged, cut, bombed, huge or oddly named, as bytes and as files."""

import bz2
import gzip
import hashlib
import io
import lzma
import tarfile
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from cratewarden.sources import archives as A

SCHEMA = "package_id string, path string, content binary"


def zipped(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as archive:
        for path, data in files:
            archive.writestr(path, data)
    return out.getvalue()


def tarred(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for path, data in files:
            item = tarfile.TarInfo(path)
            item.size = len(data)
            archive.addfile(item, io.BytesIO(data))
    return out.getvalue()


def expanded(spark, archives, **options):
    """{archive: [(path, size, digest, flag, error)]}"""
    rows = spark.createDataFrame([("p", name, data) for name, data in archives.items()], SCHEMA)
    out = {}
    for r in A.expand_archives(rows, **options).collect():
        out.setdefault(r.archive, []).append((r.path, r.size, r.sha256, r.flag, r.error))
        assert r.content is None or (len(r.content) == r.size and hashlib.sha256(r.content).hexdigest() == r.sha256)
    return out


NOISE = b"".join(hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(4000))
FILES = [("a/one", b"1"), ("a/noise", NOISE), ("empty", b""), ("dir/é 2", b"two")]
WHOLE = sorted((p, len(d), hashlib.sha256(d).hexdigest(), None, None) for p, d in FILES)


@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_kind_is_in_the_bytes(spark, pack):
    data = pack(tarred(FILES))
    assert {k: sorted(v) for k, v in expanded(spark, {"x.zip": data, "X": data, "y.TAR.GZ": data}).items()} == {"x.zip": WHOLE, "X": WHOLE, "y.TAR.GZ": WHOLE}


def test_zip_by_any_name(spark):
    assert {k: sorted(v) for k, v in expanded(spark, {"x.tar": zipped(FILES), "Y.ZIP": zipped(FILES, zipfile.ZIP_LZMA), None: zipped([])}).items()} == {"x.tar": WHOLE, "Y.ZIP": WHOLE}


def test_damage_ends_no_job(spark):
    good, stored = zipped(FILES), zipped(FILES, zipfile.ZIP_STORED)
    deflated = bytearray(good)
    at = good.index(b"a/noise") + 50
    deflated[at : at + 300] = b"\xff" * 300
    checked = bytearray(stored)
    checked[stored.index(NOISE[:32]) + 7] ^= 1
    stream = bytearray(gzip.compress(tarred(FILES), 0))
    at = stream.index(NOISE[1000:1032])
    stream[at : at + 200] = b"\x00" * 200
    archives = {
        "deflated": bytes(deflated), "checked": bytes(checked), "no directory": good[:-30], "cut tar.gz": gzip.compress(tarred(FILES))[:-9], "overwritten tar.gz": bytes(stream), "nothing": b"", "text": b"hello" * 500, "no content": None,
        "cut zstd": zstandard.compress(tarred(FILES))[:20000], "tail": good + b"junk",
    }
    got = expanded(spark, archives)
    others = [m for m in WHOLE if m[0] != "a/noise"]
    for name in ("deflated", "checked"):
        assert sorted(m for m in got[name] if m[4] is None) == others and [m[0] for m in got[name] if m[4]] == ["a/noise"]
    for name in ("no directory", "nothing", "text", "no content"):
        assert [m[:4] for m in got[name]] == [(None, None, None, None)] and got[name][0][4]
    for name in ("cut tar.gz", "overwritten tar.gz", "cut zstd"):
        assert [bool(m[4]) for m in got[name]][-1] and sum(bool(m[4]) for m in got[name]) == 1
    assert sorted(got["tail"]) == WHOLE
    rows = spark.createDataFrame([("p", name, data) for name, data in archives.items()], SCHEMA)
    assert {r.archive for r in A.whole_archives(A.expand_archives(rows)).select("archive").distinct().collect()} == {"tail"}


def test_sizes(spark):
    """A member over the bound has a size and digest, one beyond all measure a flag."""
    zeros = bytes(40 << 20)
    got = expanded(spark, {"z": zipped([("zeros", zeros), ("small", b"s")]), "t": gzip.compress(tarred([("zeros", zeros), ("small", b"s")]))}, keep=1 << 20)
    small = ("small", 1, hashlib.sha256(b"s").hexdigest(), None, None)
    large = ("zeros", len(zeros), hashlib.sha256(zeros).hexdigest(), "large", None)
    assert sorted(got["z"]) == sorted(got["t"]) == [small, large]
    bombed = expanded(spark, {"z": zipped([("zeros", zeros), ("small", b"s")])}, keep=1 << 20, most=8 << 20)["z"]
    assert [(m[0], m[2], m[3]) for m in sorted(bombed)] == [("small", small[2], None), ("zeros", None, "bomb")] and 8 << 20 < sorted(bombed)[1][1] <= 9 << 20


def test_files_are_read_in_parts(spark, tmp_path):
    many = [(f"m/{k}", str(k).encode() * 50) for k in range(1000)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "many files.dat").write_bytes(zipped(many))
    (tmp_path / "t.tar.xz").write_bytes(lzma.compress(tarred(FILES)))
    (tmp_path / "broken.zip").write_bytes(zipped(FILES)[:-25])
    (tmp_path / "none").write_bytes(b"")
    parts = A.plan_archives(spark, str(tmp_path), part_members=64).collect()
    assert sorted((p.first, p.last) for p in parts if p.archive.endswith(".dat")) == [(k, min(k + 64, 1000)) for k in range(0, 1000, 64)]
    found = A.read_archives(spark, str(tmp_path), part_members=64, tasks=8).withColumn("task", F.spark_partition_id()).cache()
    rows = found.filter("archive like '%.dat'").collect()
    assert {(r.path, r.size, r.sha256, r.content) for r in rows} == {(p, len(d), hashlib.sha256(d).hexdigest(), d) for p, d in many}
    assert len(rows) == 1000 and len({r.task for r in rows}) > 3
    assert sorted((r.path, r.size, r.sha256, r.flag, r.error) for r in found.filter("archive like '%.xz'").collect()) == WHOLE
    assert {r.archive.rsplit("/", 1)[-1] for r in found.filter("error is not null").collect()} == {"broken.zip", "none"}
    by_bytes = A.plan_archives(spark, str(tmp_path / "sub"), part_bytes=1000, part_members=10**6).count()
    assert by_bytes > 5
    (tmp_path / "void").mkdir()
    assert A.read_archives(spark, str(tmp_path / "void")).count() == 0


def test_a_failing_store_is_no_damage():
    class Broken:
        def size(self):
            return 100

        def read(self, n):
            raise OSError("connection reset")

        seek = tell = read

    with pytest.raises(A.StoreError):
        A._Stored(Broken()).readinto(bytearray(5))
    assert A.StoreError not in A.DAMAGE and not issubclass(A.StoreError, A.DAMAGE)
