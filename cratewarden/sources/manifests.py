"""Lockfiles and manifests as (name, version) rows.

Each parser takes a table with a `content` column and keeps its other columns.
Documents are read with fixed schemas; text that doesn't parse gives no rows.
Line formats keep state with windows over one file, which are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename

_PACKAGES = "array<struct<name:string,version:string>>"


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "content"]


def _emit(df: DataFrame, pairs: Column) -> DataFrame:
    """pairs: an array of (name, version) structs."""
    return df.select(*_others(df), F.explode(pairs).alias("p")).select(*_others(df), "p.name", F.coalesce("p.version", F.lit("unknown")).alias("version")).filter("name is not null")


def _entries(mapping: Column, version) -> Column:
    return F.transform(F.map_entries(mapping), lambda e: F.struct(e["key"].alias("name"), version(e["value"]).alias("version")))


def parse_composer_lock(df: DataFrame) -> DataFrame:
    doc = F.from_json("content", f"struct<packages:{_PACKAGES},`packages-dev`:{_PACKAGES}>")
    return _emit(df, F.concat(F.coalesce(doc["packages"], F.array().cast(_PACKAGES)), F.coalesce(doc["packages-dev"], F.array().cast(_PACKAGES))))


def _right_wins(left: Column, right: Column, kind: str) -> Column:
    """Two maps joined; a key in both keeps the right value."""
    left, right = (F.coalesce(m, F.create_map().cast(kind)) for m in (left, right))
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def parse_package_json(df: DataFrame) -> DataFrame:
    doc = F.from_json("content", "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    return _emit(df, _entries(_right_wins(doc["dependencies"], doc["devDependencies"], "map<string,string>"), lambda v: v))


def parse_package_lock(df: DataFrame) -> DataFrame:
    entry = "map<string,struct<version:string>>"
    doc = F.from_json("content", f"struct<lockfileVersion:int,packages:{entry},dependencies:{entry}>")
    new = F.map_filter(F.coalesce(doc["packages"], F.create_map().cast(entry)), lambda k, _: k.startswith("node_modules/"))
    named = F.transform(F.map_entries(new), lambda e: F.struct(F.regexp_replace(e["key"], "^node_modules/", "").alias("name"), e["value"]["version"].alias("version")))
    old = _entries(F.coalesce(doc["dependencies"], F.create_map().cast(entry)), lambda v: v["version"])
    return _emit(df, F.when(F.coalesce(doc["lockfileVersion"], F.lit(1)) >= 3, named).otherwise(old))


def _numbered_lines(df: DataFrame) -> tuple[DataFrame, Window]:
    rows = df.withColumn("_file", F.monotonically_increasing_id()).select(*_others(df), "_file", F.posexplode(F.split("content", "\r?\n")).alias("_n", "_line"))
    return rows, Window.partitionBy("_file").orderBy("_n")


def parse_yarn_lock(df: DataFrame) -> DataFrame:
    """A header's first entry names the package, and the next version line gives its version."""
    rows, order = _numbered_lines(df)
    head = F.regexp_replace(F.split_part("_line", F.lit(","), F.lit(1)), '"', "")
    name = F.regexp_extract(head, "^(@?[^@]+)", 1)
    is_head, is_version = F.col("_line").rlike('^"?[a-zA-Z@]'), F.col("_line").startswith("  version ")
    rows = rows.withColumn("_head", F.when(is_head, name)).withColumn("_block", F.sum(is_head.cast("int")).over(order))
    first = Window.partitionBy("_file", "_block").orderBy("_n")
    rows = rows.withColumn("name", F.last("_head", ignorenulls=True).over(order)).filter(is_version & F.col("name").isNotNull()).withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    version = F.regexp_replace(F.regexp_extract("_line", r"^  version (\S+)", 1), '"', "")
    return rows.select(*_others(df), "name", version.alias("version")).distinct()


def parse_requirements(df: DataFrame) -> DataFrame:
    rows, _ = _numbered_lines(df)
    bare = F.regexp_replace("_line", r"\[[^\]]*\]", "")
    rows = rows.filter(F.col("_line").rlike("^[A-Za-z]")).withColumn("_bare", bare)
    return rows.select(*_others(df), F.trim(F.regexp_extract("_bare", "^([^><=!~]+)[><=!~]+", 1)).alias("name"), F.regexp_extract("_bare", r"^[^><=!~]+[><=!~]+([^ \t;#]*)", 1).alias("version")).filter("name <> '' and version <> ''")


def parse_pipfile_lock(df: DataFrame) -> DataFrame:
    entry = "map<string,struct<version:string>>"
    doc = F.from_json("content", f"struct<default:{entry},develop:{entry}>")
    return _emit(df, _entries(_right_wins(doc["default"], doc["develop"], entry), lambda v: F.regexp_replace(v["version"], "^==", "")))


def parse_go_mod(df: DataFrame) -> DataFrame:
    """Lines of require blocks, and requires of one line."""
    rows, order = _numbered_lines(df)
    opens, closes = F.col("_line").startswith("require ("), F.col("_line").startswith(")")
    state = F.when(opens, 1).when(closes, 0)
    rows = rows.withColumn("_in", F.coalesce(F.last(state, ignorenulls=True).over(order), F.lit(0)))
    inside = (F.col("_in") == 1) & F.col("_line").rlike("^\t[a-zA-Z]")
    alone = F.col("_line").rlike("^require [a-zA-Z]")
    words = F.split(F.when(inside, F.substring("_line", 2, 1 << 20)).when(alone, F.substring("_line", 9, 1 << 20)), " +")
    return rows.filter(inside | alone).select(*_others(df), F.get(words, 0).alias("name"), F.get(words, 1).alias("version")).filter("name <> '' and coalesce(version, '') <> ''")


PARSERS = {
    "composer.lock": parse_composer_lock, "package.json": parse_package_json, "package-lock.json": parse_package_lock, "yarn.lock": parse_yarn_lock, "requirements.txt": parse_requirements, "Pipfile.lock": parse_pipfile_lock, "go.mod": parse_go_mod,
}


def read_manifests(df: DataFrame) -> DataFrame:
    """df (package_id, path, content) -> (package_id, path, name, version), by the file's name. Other names give nothing."""
    out = None
    for name, parse in PARSERS.items():
        part = parse(df.filter(basename(F.col("path")) == name).select("package_id", "path", "content"))
        out = part if out is None else out.unionByName(part)
    return out
