"""Digests, identity of packages, and checks against published hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, clean_name


def file_digests(files: DataFrame) -> DataFrame:
    content = F.col("content").cast("binary")
    return files.select("package_id", "path", *(F.sha2(content, n).alias(f"sha{n}") for n in (256, 384, 512)))


def tree_digest(files: DataFrame) -> DataFrame:
    """(package_id, digest): the SHA-256 of a package's `hash  path` lines, sorted by path, then hash. Paths without content are left out.

    Only hashes and paths are shuffled. Each task sorts its packages' lines,
    to disk where they are many, and feeds them to one running digest, so
    memory doesn't grow with a package; its digest is by nature one sequence.
    """
    lines = files.select("package_id", F.coalesce("path", F.lit("")).alias("path"), F.sha2(F.col("content").cast("binary"), 256).alias("h")).filter("h is not null")
    ordered = lines.repartition("package_id").sortWithinPartitions("package_id", "path", "h")
    return ordered.mapInArrow(_digest_task, "package_id string, digest string")


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = lambda package, digest: pa.RecordBatch.from_pylist([{"package_id": package, "digest": digest.hexdigest()}], pa.schema([("package_id", pa.string()), ("digest", pa.string())]))
    current = digest = None
    for batch in batches:
        for package, path, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is None or package != current:
                if digest is not None:
                    yield row(current, digest)
                current, digest = package, hashlib.sha256()
            digest.update(f"{h}  {path}\n".encode())
    if digest is not None:
        yield row(current, digest)


def _json(path: str) -> Column:
    return F.get_json_object("content", path)


def _line(field: str) -> Column:
    found = F.regexp_extract("content", rf"(?mi)^[\s*#]*{field}:[ \t]*(.*?)[ \t\r]*$", 1)
    return F.when(found != "", found)


def detect_identity(files: DataFrame) -> DataFrame:
    """What each package says it is: (package_id, source, ecosystem, vendor, name, version); the first rule that applies counts.

    composer.json, package.json, dist-info/METADATA, a plugin readme (with its
    title and one of the platform's fields), a plugin header, the core's version
    file, and at last the package's own name.
    """
    name, path = basename(F.col("path")), F.col("path")
    text = lambda v: F.lit(v)
    none = F.lit(None).cast("string")
    title = F.regexp_extract("content", r"(?m)^===\s*(.*?)\s*===", 1)
    row = lambda rank, source, ecosystem, vendor, called, version: F.struct(text(rank).alias("rank"), path.alias("path"), text(source).alias("source"), text(ecosystem).alias("ecosystem"), vendor.alias("vendor"), called.alias("name"), version.alias("version"))
    composer = _json("$.name")
    rule = (
        F.when((name == "composer.json") & composer.isNotNull(), row(1, "composer.json", "composer", F.substring_index(composer, "/", 1), F.substring_index(composer, "/", -1), _json("$.version")))
        .when((name == "package.json") & _json("$.name").isNotNull(), row(2, "package.json", "npm", none, _json("$.name"), _json("$.version")))
        .when(path.rlike(r"(^|/)[^/]+\.dist-info/METADATA$"), row(3, "METADATA", "pypi", none, _line("Name"), _line("Version")))
        .when((F.lower(name) == "readme.txt") & (title != "") & F.col("content").rlike(r"(?mi)^(Contributors|Stable tag|Requires at least|Tested up to):"), row(4, "readme.txt", "wordpress", none, title, _line("Stable tag")))
        .when(name.endswith(".php") & _line("Plugin Name").isNotNull(), row(5, "plugin header", "wordpress", none, _line("Plugin Name"), _line("Version")))
        .when(path.endswith("wp-includes/version.php"), row(6, "core version", "wordpress_core", none, F.lit("wordpress"), F.nullif(F.regexp_extract("content", r"\$wp_version\s*=\s*'([^']*)'", 1), F.lit(""))))
    )
    best = files.withColumn("r", rule).groupBy("package_id").agg(F.min("r").alias("r"))
    from_name = F.regexp_extract(clean_name(F.col("package_id")), r"^(.*?)[-_.]v?([0-9][0-9A-Za-z.]*)$", 1)
    from_version = F.regexp_extract(clean_name(F.col("package_id")), r"^(.*?)[-_.]v?([0-9][0-9A-Za-z.]*)$", 2)
    return best.select(
        "package_id", F.coalesce("r.source", F.lit("file name")).alias("source"), F.coalesce("r.ecosystem", F.lit("unknown")).alias("ecosystem"), F.col("r.vendor").alias("vendor"),
        F.coalesce("r.name", F.when(from_name != "", from_name), clean_name(F.col("package_id"))).alias("name"), F.coalesce("r.version", F.when(F.col("r").isNull() & (from_version != ""), from_version)).alias("version"),
    )


def normalise_reference_hash(df: DataFrame) -> DataFrame:
    """df (package_id, ecosystem, kind, value) -> one (package_id, algorithm, hash) each.

    npm integrity is base64 behind its algorithm; a Packagist hash is SHA-1 at
    40 characters, SHA-256 at 64, and else rejected; of PyPI files the sdist
    comes first.
    """
    value = F.col("value")
    npm = F.regexp_extract(value, "^(sha(?:1|256|384|512))-(.+)$", 1)
    algorithm = (
        F.when(F.col("ecosystem") == "npm", F.nullif(npm, F.lit("")))
        .when(F.col("ecosystem") == "composer", F.when(F.length(value) == 40, "sha1").when(F.length(value) == 64, "sha256"))
        .when(F.col("ecosystem") == "pypi", "sha256")
    )
    decoded = F.lower(F.hex(F.try_to_binary(F.regexp_extract(value, "^sha[0-9]+-(.+)$", 1), F.lit("base64"))))
    rows = df.withColumns({"algorithm": algorithm, "hash": F.when(F.col("ecosystem") == "npm", decoded).otherwise(F.lower(value)), "place": F.when(F.col("kind") == "sdist", 0).otherwise(1)})
    return rows.filter("algorithm is not null").groupBy("package_id").agg(F.min(F.struct("place", "algorithm", "hash")).alias("b")).select("package_id", "b.algorithm", "b.hash")


def verify_checksums(calculated: DataFrame, reference: DataFrame) -> DataFrame:
    """calculated, reference (package_id, version, sha256, sha384, sha512) -> status, checked, risk.

    Every algorithm that the reference has is checked, without regard to case.
    """
    names = ("sha256", "sha384", "sha512")
    ref = reference.select("package_id", "version", *(F.col(n).alias(f"ref_{n}") for n in names), F.lit(True).alias("known"))
    rows = calculated.join(ref, ["package_id", "version"], "left")
    same = [F.lower(n) == F.lower(f"ref_{n}") for n in names]
    checked = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in same), F.lit(0))
    failed = sum((F.when(~s, 1).otherwise(0) for s in same), F.lit(0))
    status = F.when(F.col("known").isNull(), "no_reference_available").when(checked == 0, "skipped").when(failed > 0, "failed").otherwise("verified")
    return rows.select("package_id", "version", status.alias("status"), checked.alias("checked")).withColumn("risk", F.when(F.col("status") == "failed", 500).when(F.col("status") == "no_reference_available", 50).otherwise(0))


def verify_file_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (package_id, path, sha256) against files (package_id, path, sha256): pass, fail and skip counts, severity."""
    rows = manifest.select("package_id", "path", F.lower("sha256").alias("wanted")).join(files.select("package_id", "path", F.lower("sha256").alias("found")), ["package_id", "path"], "left")
    skip = F.col("wanted").isNull() | F.col("found").isNull()
    counts = rows.groupBy("package_id").agg(F.count_if(~skip & (F.col("wanted") == F.col("found"))).alias("passed"), F.count_if(~skip & (F.col("wanted") != F.col("found"))).alias("failed"), F.count_if(skip).alias("skipped"))
    return counts.withColumn("severity", F.when(F.col("failed") > 0, "CRITICAL"))
