"""The content scan by digest: each distinct content is read once, and what it holds is kept for all files, packages and later runs.

What a finding needs of content alone (pattern types, active markup, a markup
namespace, program text) is a verdict, kept under the content's digest and the
version of the rules. All else comes from a file's path, size and type. So a scan
reads content only of digests without a verdict, one file of each; a
library that a thousand packages ship is read once, and a second run over the
same tree reads none. The findings are those of `content.all_content_findings`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..refdata import CODELESS_EXTENSIONS, PATTERN_TYPES, PATTERN_WORDS, PATTERNS, PROGRAM_TEXT, SCAN_LIMIT, SCRIPTABLE_EXTENSIONS
from ..sources.shared import stored
from . import content as C

#: Changes whenever a rule on content does; verdicts of other rules are left aside.
RULES = hashlib.sha256("\n".join([*PATTERNS, *PATTERN_WORDS, *map(str, PATTERN_TYPES), C.SCRIPT, C.NAMESPACE, PROGRAM_TEXT]).encode()).hexdigest()[:16]
SCHEMA = "digest string, types array<string>, active boolean, namespaced boolean, program boolean, rules string"


def with_digest(files: DataFrame) -> DataFrame:
    """Adds digest, the SHA-256 of the content. A listing that has digests already needs no content for files that are known."""
    return files.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))


def judge(files: DataFrame) -> DataFrame:
    """files (digest, content) -> a verdict for each. Content beyond the bounds of the scan is judged as well, and is not asked for."""
    content = F.col("content")
    lines = F.when(C._matched(content), F.filter(F.split(content, "\n"), C._matched))
    hit = lambda pattern: F.exists("lines", lambda line: line.rlike(pattern))
    types = F.array_compact(F.array(*(F.when(hit(C._any(PATTERNS[first - 1 : last])), F.lit(name)) for name, _, first, last in PATTERN_TYPES)))
    rows = files.select("digest", "content", lines.alias("lines"))
    none = lambda test: F.coalesce(test, F.lit(False))
    return rows.select("digest", types.alias("types"), none(content.rlike(C.SCRIPT)).alias("active"), none(content.rlike(C.NAMESPACE)).alias("namespaced"), none(content.rlike(PROGRAM_TEXT)).alias("program"), F.lit(RULES).alias("rules"))


def known_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The verdicts of a store under the rules as they are now; none if there is no store yet."""
    found = stored(spark, path, SCHEMA)
    return (spark.createDataFrame([], SCHEMA) if found is None else found).filter(F.col("rules") == RULES).dropDuplicates(["digest"])


def unjudged(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """files (package_id, path, digest, size) without a verdict that need one: one place of each digest."""
    wanted = files.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("package_id", "path")).alias("at"))
    return wanted.join(verdicts.select("digest"), "digest", "left_anti").select("digest", "at.package_id", "at.path")


def judge_new(files: DataFrame, path: str) -> int:
    """Judge the contents that the store at `path` doesn't know, add their verdicts, and say how many there were.

    files (package_id, path, content, digest); content is read only if there are any, and sent nowhere but for those.
    """
    spark = files.sparkSession
    new = unjudged(files, known_verdicts(spark, path))
    if new.isEmpty():
        return 0
    places = new.select(F.col("package_id").alias("p"), F.col("path").alias("q"), F.col("digest").alias("d"))
    rows = files.join(places, F.col("package_id").eqNullSafe(F.col("p")) & F.col("path").eqNullSafe(F.col("q")) & (F.col("digest") == F.col("d")), "left_semi")
    before = known_verdicts(spark, path).count()
    judge(rows.dropDuplicates(["digest"])).write.mode("append").partitionBy("rules").parquet(path)
    return known_verdicts(spark, path).count() - before


def findings(files: DataFrame, verdicts: DataFrame, limit: int = SCAN_LIMIT) -> DataFrame:
    """files (package_id, path, size, mime, digest), verdicts -> (package_id, path, kind, type, severity). No content is read.

    A very common content (an empty file, a license) is one verdict with very many
    files; the join is an equi-join that adaptive execution can split.
    """
    path, mime = F.col("path"), F.col("mime")
    rows = files.select("package_id", "path", "mime", "size", "digest", extension(path).alias("ext")).withColumn("expected", C._expected(F.col("ext")))
    rows = rows.join(verdicts.select("digest", "types", "active", "namespaced", "program"), "digest", "left")
    ext, scanned = F.col("ext"), C._scannable(F.col("size"), path, limit)
    finding = lambda test, kind, name, severity: F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("type"), severity.alias("severity")))
    parts = [finding(scanned & F.array_contains("types", name), "pattern", name, F.lit(level)) for name, level, *_ in PATTERN_TYPES]
    high = (ext.isin(SCRIPTABLE_EXTENSIONS) & F.col("active")) | ((ext == "xml") & F.col("namespaced") & F.col("active"))
    embedded = F.when((F.col("size") > 0) & (F.col("size") < limit), F.when(ext.isin(CODELESS_EXTENSIONS) & F.col("program"), "CRITICAL").when(high, "HIGH"))
    mismatch = C._mismatch(ext, F.col("expected"), mime)[0]
    parts += [
        finding(mismatch.isNotNull(), "mime_mismatch", "mime_mismatch", mismatch), finding(C._deceptive(path)[0], "deceptive_extension", "deceptive", F.lit("CRITICAL")),
        finding(embedded.isNotNull(), "embedded_code", "embedded_code", embedded),
    ]
    found = rows.select("package_id", "path", F.explode(F.array_compact(F.array(*parts))).alias("f")).select("package_id", "path", "f.*")
    return found.unionByName(C.image_hygiene(files).select("package_id", F.lit("(scan root)").alias("path"), F.lit("file_hygiene").alias("kind"), F.lit("file_hygiene").alias("type"), "severity"))
