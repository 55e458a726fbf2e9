"""Linter reports: totals, issues, and which language versions a package works with.

phpcs (package_id, php_version, file, line, col, type, message, source, severity, fixable).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packages import with_clean
from ..refdata import PHP_VERSIONS, small


def phpcs_totals(phpcs: DataFrame, packages: DataFrame | None = None, *, kind: str | None = None, min_severity: int = 0) -> DataFrame:
    """Per package: errors, warnings, fixable messages and files, of one type and from a severity on if asked for; 0 for the clean ones of `packages`.

    What a message leaves out counts as in `phpcs_issues`. The totals that a
    report states itself are in `sources.readers.read_phpcs_totals`.
    """
    rows = phpcs_issues(phpcs).filter(F.col("severity") >= min_severity)
    if kind:
        rows = rows.filter(F.col("type") == kind)
    rows = with_clean(rows.select("package_id", "type", "fixable", "file"), packages)
    return rows.groupBy("package_id").agg(F.count_if(F.col("type") == "ERROR").alias("errors"), F.count_if(F.col("type") == "WARNING").alias("warnings"), F.count_if("fixable").alias("fixable"), F.countDistinct("file").alias("files"))


def phpcs_issues(phpcs: DataFrame) -> DataFrame:
    """The flat list, with defaults for what a report leaves out: an ERROR of severity 0 at 0:0, not fixable."""
    default = {"line": 0, "col": 0, "type": "ERROR", "message": "", "source": "", "severity": 0, "fixable": False}
    return phpcs.select("package_id", "file", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in default.items()))


def php_version_matrix(phpcs: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(package_id, php_version, errors, warnings, status) for every package and version: passed, warning or failed.

    Packages are the given ones, as a package without any message passes
    everywhere, or else those that have a message.
    """
    versions = small(phpcs.sparkSession, [(v,) for v in PHP_VERSIONS], "php_version")
    listed = (phpcs if packages is None else packages).select("package_id").distinct()
    wanted = listed.crossJoin(F.broadcast(versions))  # fifteen rows for each package
    rows = phpcs.select("package_id", "php_version", F.coalesce("type", F.lit("ERROR")).alias("type")).unionByName(wanted, allowMissingColumns=True)
    counts = rows.groupBy("package_id", "php_version").agg(F.count_if(F.col("type") == "ERROR").alias("errors"), F.count_if(F.col("type") == "WARNING").alias("warnings"), F.max(F.col("type").isNull()).alias("wanted"))
    return counts.filter("wanted").drop("wanted").withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed"))


def _major_minor(version):
    return F.struct(F.split_part(version, F.lit("."), F.lit(1)).cast("int").alias("major"), F.split_part(version, F.lit("."), F.lit(2)).cast("int").alias("minor"))


def php_affected_versions(phpcs: DataFrame) -> DataFrame:
    """(package_id, file, line, source, message, versions): each distinct issue, and the versions that it affects in numeric order.

    One aggregate; a group holds at most one entry for each version.
    """
    key = F.struct(_major_minor(F.col("php_version")).alias("k"), F.col("php_version").alias("v"))
    first = F.min(F.struct(_major_minor(F.col("php_version")).alias("k"), F.col("message").alias("m")))
    rows = phpcs.withColumn("source", F.coalesce("source", F.lit(""))).groupBy("package_id", "file", "line", "source").agg(first.alias("first"), F.array_sort(F.collect_set(key)).alias("met"))
    return rows.select("package_id", "file", "line", "source", F.col("first.m").alias("message"), F.transform("met", lambda x: x["v"]).alias("versions"))


def php_range(matrix: DataFrame) -> DataFrame:
    """(package_id, min_version, max_version, version_range, composer): of the versions that don't fail, in numeric order."""
    key = F.struct(_major_minor(F.col("php_version")).alias("k"), F.col("php_version").alias("v"))
    ok = F.when(F.col("status") != "failed", key)
    rows = matrix.groupBy("package_id").agg(F.min(ok).alias("lo"), F.max(ok).alias("hi"))
    low, high = F.col("lo.v"), F.col("hi.v")
    text = F.when(low == high, F.concat(F.lit("="), low)).otherwise(F.concat(F.lit(">="), low, F.lit(" <="), high))
    majors = F.sequence(F.col("lo.k.major"), F.col("hi.k.major"))
    spans = F.array_join(F.transform(majors, lambda m, i: F.when(i == 0, F.concat(F.lit("^"), low)).otherwise(F.concat(F.lit("^"), m.cast("string"), F.lit(".0")))), " || ")
    composer = F.when(low.isNull(), F.lit(None)).when(low == high, F.concat(F.lit("~"), low, F.lit(".0"))).when(F.col("lo.k.major") == F.col("hi.k.major"), F.concat(F.lit(">="), low)).otherwise(spans)
    return rows.select("package_id", low.alias("min_version"), high.alias("max_version"), text.alias("version_range"), composer.alias("composer"))


def php_errors_by_file(phpcs: DataFrame) -> DataFrame:
    """(package_id, file, errors): the distinct errors of each file, in order of line."""
    rows = phpcs.filter(F.coalesce("type", F.lit("ERROR")) == "ERROR").select("package_id", "file", "line", F.coalesce("source", F.lit("")).alias("source")).distinct()
    return rows.groupBy("package_id", "file").agg(F.array_sort(F.collect_list(F.struct("line", "source"))).alias("errors"))
