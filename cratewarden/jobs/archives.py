"""Archives made of documents, and opened again: as bytes in a column, and as files."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import archives as A
from ..sources.shared import new_path
from ..sources.trees import open_uri
from . import inputs
from .registry import Registry

jobs = Registry()

inputs.INPUTS["packed"] = "SELECT concat('pkg', CAST(doc_id AS STRING)) AS package_id, doc_id AS k, coalesce(text, '') AS text FROM {documents}"

#: By k % 7: what it is packed with, the name of the archive (which needn't say so), and what is done to it.
FORMS = {0: ("none", "broken.zip"), 1: ("zip", "a.ZIP"), 2: ("gzip", "a.tar.gz"), 3: ("zstd", "a.tar.zst"), 4: ("tar", "a.bin"), 5: ("xz", "a.tgz"), 6: ("bzip2", "cut.tar.bz2")}


def packed(k: int, text: str) -> tuple[str, bytes]:
    """A text as an archive of two files and a directory; one in seven is no archive, and one lacks its end."""
    form, name = FORMS[k % 7]
    body, out = text.encode(), io.BytesIO()
    if form == "none":
        return name, b"nothing " + body
    parts = [("top/text.txt", body), ("top/é (1).txt", b"x")]
    if form == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("top/", "")
            for path, data in parts:
                archive.writestr(path, data)
        return name, out.getvalue()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for path, data in parts:
            item = tarfile.TarInfo(path)
            item.size = len(data)
            archive.addfile(item, io.BytesIO(data))
    pack = {"gzip": gzip.compress, "zstd": zstandard.compress, "xz": lzma.compress, "bzip2": bz2.compress}.get(form, bytes)
    data = pack(out.getvalue())
    return name, data[:-6] if form == "bzip2" else data


def pack(rows: DataFrame) -> DataFrame:
    """rows (package_id, k, text) -> (package_id, path, content)."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [packed(k, t) for k, t in zip(frame["k"], frame["text"], strict=True)]
            yield pd.DataFrame({"package_id": frame["package_id"], "path": [m[0] for m in made], "content": [m[1] for m in made]})

    return rows.mapInPandas(task, "package_id string, path string, content binary")


PACKED = " UNION ALL ".join(f"SELECT package_id, k, text, {k} AS form, '{name}' AS archive FROM packed WHERE k % 7 = {k}" for k, (_, name) in FORMS.items())
#: Of what lacks its end all comes out, and then an error.
FILES = f"""SELECT package_id, archive, 'top/text.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, false AS failed, form FROM ({PACKED}) p WHERE form > 0 UNION ALL SELECT package_id, archive, 'top/é (1).txt', 1, sha256('x'), false, form FROM ({PACKED}) p WHERE form > 0"""
MEMBERS = f"""SELECT * EXCLUDE form FROM ({FILES}) f UNION ALL SELECT package_id, archive, NULL, NULL, NULL, true FROM ({PACKED}) p WHERE form IN (0, 6)"""
_fields = lambda df, *key: df.select(*key, "path", "size", "sha256", F.col("error").isNotNull().alias("failed"))
jobs.add("expand_archives", lambda p: _fields(A.expand_archives(pack(p)), "package_id", "archive"), "packed", sql=MEMBERS)
jobs.add("whole_archives", lambda p: _fields(A.whole_archives(A.expand_archives(pack(p)).drop("content")), "package_id", "archive"), "packed", sql=f"SELECT * EXCLUDE form FROM ({FILES}) f WHERE form < 6")

inputs.INPUTS["bundled"] = "SELECT CAST(FLOOR(doc_id / 100) AS BIGINT) AS bundle, doc_id AS k, coalesce(text, '') AS text FROM {documents}"


def bundle(spark: SparkSession, rows: DataFrame, root: str) -> None:
    """Write rows (bundle, k, text) as zip files <root>/<bundle>.zip, a member a row, from tasks."""

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        store, path = open_uri(f"{root}/{frame['bundle'].iloc[0]}.zip")
        store.create_dir(path.rsplit("/", 1)[0])
        with store.open_output_stream(path, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for k, text in sorted(zip(frame["k"], frame["text"], strict=True)):
                archive.writestr(f"doc/{k}.txt", text.encode())
        return frame[["bundle"]].head(1)

    rows.groupBy("bundle").applyInPandas(task, "bundle long").count()


def read_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in zip files of a hundred, read in parts of thirty."""
    root = new_path(spark, "bundles")
    bundle(spark, inputs.frame(spark, sf_dir, "bundled"), root)
    found = A.read_archives(spark, root, part_members=30)
    return found.select(F.substring_index("archive", "/", -1).alias("archive"), "path", "size", "sha256", F.col("error").isNotNull().alias("failed"))


jobs.queries["read_archives"] = read_bundles
jobs.sql["read_archives"] = f"{inputs.duck('bundled')} SELECT bundle || '.zip' AS archive, 'doc/' || k || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, false AS failed FROM bundled"
