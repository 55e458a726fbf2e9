"""Files by their URIs, and what lies below a folder, listed by tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.files import EXCLUDED
from .shared import new_path


def open_uri(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and the path in it of a URI as Spark writes it, in plain characters: a bare path and file:/x are local, s3a is s3."""
    scheme, colon, rest = uri.partition(":")
    if not colon or not scheme.isalnum():
        return pyarrow.fs.LocalFileSystem(), uri
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, path = rest.removeprefix("//").partition("/")
    store, base = pyarrow.fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}/")
    return store, f"{base.rstrip('/')}/{path}"


def list_tree(spark: SparkSession, root: str, excluded: str = EXCLUDED) -> DataFrame:
    """(path, kind, size): files and folders below a root, by their paths from there; folders that match `excluded` are named but not entered.

    The folders of one depth are listed in a round; symbolic links are left out.
    """
    schema, place = "path string, kind string, size long", new_path(spark, "tree-listing")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_uri(root)
        top = top.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                inside = store.get_file_info(pyarrow.fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True))
                inside = [i for i in inside if not (store.type_name == "local" and os.path.islink(i.path))]
                kinds = ["dir" if i.type == pyarrow.fs.FileType.Directory else "file" for i in inside]
                yield pa.RecordBatch.from_arrays([pa.array([i.path[len(top) :].lstrip("/") for i in inside], pa.string()), pa.array(kinds, pa.string()), pa.array([i.size or 0 for i in inside], pa.int64())], ["path", "kind", "size"])

    folders, depth = spark.createDataFrame([("",)], "path string"), 0
    while True:
        folders.repartition("path").mapInArrow(listed, schema).write.parquet(f"{place}/depth={depth}")
        folders = spark.read.schema(schema).parquet(f"{place}/depth={depth}").filter((F.col("kind") == "dir") & ~F.concat("path", F.lit("/")).rlike(excluded)).select("path")
        if folders.isEmpty():
            return spark.read.schema(schema).parquet(*(f"{place}/depth={d}" for d in range(depth + 1)))
        depth += 1
