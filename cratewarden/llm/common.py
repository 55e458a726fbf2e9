"""What several corpus operators share: the shared scratch folder and its files, words, and the input tables."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a new one in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def arrow_uri(uri: str) -> str:
    """A URI of Spark's as pyarrow names it: Hadoop's s3a and s3n are s3; a bare path is a local file."""
    scheme, colon, rest = uri.partition("://")
    if not colon:
        return uri if re.match("[A-Za-z][A-Za-z0-9+.-]*:", uri) else f"file://{uri}"
    return f"{'s3' if scheme.lower() in ('s3a', 's3n') else scheme}://{rest}"


def open_uri(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(arrow_uri(uri))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    The table outlives any executor, so what is built on it never recomputes
    what lies before it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """About n rows, chosen by a hash of `key`; all rows of a smaller table.

    The share comes from a count, so no rows meet in one task to be chosen.
    Rows with one key stay together, and a key of very many rows may exceed n.
    """
    total = df.count()
    if total <= n:
        return df
    return df.filter(F.xxhash64(*key) < F.lit(int(2**64 * (n / total)) - 2**63))


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def scratch_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
