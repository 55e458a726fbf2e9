"""Content scan: malicious patterns, types that disagree with extensions, embedded code, image hygiene, risk.

Files without any of the words that patterns need are dropped by plain search,
and then those whose whole text the combined expression of all patterns doesn't meet, before
any line is made; lines are sorted out in the same way. From there on everything is in
proportion to the hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, extension
from ..refdata import (
    ACTIVE_MARKUP,
    BINARY_TYPE,
    CODELESS_EXTENSIONS,
    CONTENT_WEIGHTS,
    DATA_LIKE_EXTENSIONS,
    EXECUTABLE_EXTENSIONS,
    EXECUTABLE_TYPE,
    IMAGE_EXTENSIONS,
    MARKUP_NAMESPACE,
    PATTERN_TYPES,
    PATTERN_WORDS,
    PATTERNS,
    PROGRAM_TEXT,
    SAFE_PAIRS,
    SCAN_LIMIT,
    SCRIPTABLE_EXTENSIONS,
    SIGNATURES,
    SKIPPED_EXTENSIONS,
    STRICT_TYPES,
    TEXT_EXTENSIONS,
    UNFORGIVEN_EXTENSIONS,
    small,
)

#: Java's mode in which only \n ends a line.
FLAGS = "(?id)"


def _any(patterns: list[str]) -> str:
    return FLAGS + "(" + "|".join(f"(?:{p})" for p in patterns) + ")"


COMBINED = _any(PATTERNS)
SCRIPT, NAMESPACE = FLAGS + ACTIVE_MARKUP, FLAGS + MARKUP_NAMESPACE


def _scannable(size: Column, path: Column, limit: int) -> Column:
    return (size > 0) & (size <= limit) & ~F.coalesce(extension(path).isin(SKIPPED_EXTENSIONS), F.lit(False))


def scannable_files(files: DataFrame, limit: int = SCAN_LIMIT) -> DataFrame:
    """Files that the pattern scan reads: not empty, not over the limit, not of a binary extension."""
    return files.filter(_scannable(F.col("size"), F.col("path"), limit))


def scan_coverage(files: DataFrame, limit: int = SCAN_LIMIT) -> DataFrame:
    """Per package: files, files scanned, and files skipped for their size."""
    return files.groupBy("package_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(_scannable(F.col("size"), F.col("path"), limit)).alias("scanned"), F.count_if(F.col("size") > limit).alias("size_skipped"))


def _worded(text: Column) -> Column:
    """Whether text holds a word that patterns need; its lower case is made once."""
    return F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, (low.contains(w) for w in PATTERN_WORDS)))


def _matched(text: Column) -> Column:
    """Whether a line, or any line of a text, may meet a pattern: no pattern is anchored, and none but through white space reaches over a line."""
    return _worded(text) & text.rlike(COMBINED)


def pattern_hits(files: DataFrame) -> DataFrame:
    """(package_id, path, line, pattern_id, type, severity, text) for every line and pattern that meet.

    The patterns are literals of one expression, each compiled once for a task.
    An inner explode would make the optimizer test the arrays first, and so make them twice.
    """
    lines = F.filter(F.transform(F.split("content", "\n"), lambda text, at: F.struct((at + 1).alias("line"), text.alias("text"))), lambda x: _matched(x["text"]))
    rows = files.filter(_matched(F.col("content"))).select("package_id", "path", F.inline_outer(lines)).filter("line is not null")
    ids = F.array(*(F.when(F.col("text").rlike(FLAGS + p), F.lit(n)) for n, p in enumerate(PATTERNS, 1)))
    hits = rows.select("package_id", "path", "line", "text", F.explode_outer(F.filter(ids, lambda i: i.isNotNull())).alias("pattern_id"))
    kind = severity = None
    for name, level, first, last in PATTERN_TYPES:
        inside = F.col("pattern_id").between(first, last)
        kind = F.when(inside, name) if kind is None else kind.when(inside, name)
        severity = F.when(inside, level) if severity is None else severity.when(inside, level)
    return hits.select("package_id", "path", "line", "pattern_id", kind.alias("type"), severity.alias("severity"), "text")


def first_hit_per_type(hits: DataFrame) -> DataFrame:
    """One finding for each file and type: its lowest pattern, and that one's first line, cut to 120 characters."""
    best = F.min(F.struct("pattern_id", "line", "severity", "text")).alias("b")
    found = hits.groupBy("package_id", "path", "type").agg(best).select("package_id", "path", "type", "b.*")
    return found.withColumn("text", F.when(F.length("text") > 120, F.concat(F.substring("text", 1, 120), F.lit("..."))).otherwise(F.col("text")))


def sniff_mime(files: DataFrame) -> DataFrame:
    """Adds mime from the leading bytes; text where none fits, and `inode/x-empty` without any. content is string or binary."""
    head = F.hex(F.substring(F.col("content").cast("binary"), 1, 16))
    found = F.when(F.length(head) == 0, "inode/x-empty")
    for prefix, mime in SIGNATURES:
        found = found.when(head.startswith(prefix), mime)
    return files.withColumn("mime", found.when(F.col("content").cast("binary").isNull(), F.lit(None)).otherwise("text/plain"))


def _expected(ext: Column) -> Column:
    """The type that an extension must have, or null."""
    table = [(e, p) for exts, p in STRICT_TYPES.items() for e in exts.split()]
    return F.element_at(F.map_from_arrays(F.lit([e for e, _ in table]), F.lit([p for _, p in table])), F.coalesce(ext, F.lit("")))


def _mismatch(ext: Column, expected: Column, mime: Column) -> tuple[Column, Column]:
    """(severity, or null where type and extension agree; detail)."""
    wrong = ~F.regexp_like(mime, F.concat(F.lit("^("), expected, F.lit(")$")))
    forgiven = (mime == "application/octet-stream") & ~ext.isin(UNFORGIVEN_EXTENSIONS)
    flagged = F.when(expected.isNotNull(), wrong & ~forgiven).otherwise(ext.isin(TEXT_EXTENSIONS) & mime.rlike(BINARY_TYPE))
    images = F.coalesce(expected.startswith("image/"), F.lit(False)) & mime.startswith("image/")
    severity = F.when(mime.rlike(EXECUTABLE_TYPE), "CRITICAL").when(images, "LOW").otherwise("HIGH")
    detail = F.when(expected.isNotNull(), F.concat(F.lit("expected "), F.replace(expected, F.lit("\\"), F.lit("")), F.lit(", got "), mime)).otherwise(F.concat(F.lit("text extension has binary MIME: "), mime))
    return F.when(flagged & ext.isNotNull() & mime.isNotNull(), severity), detail


def mime_mismatch(files: DataFrame) -> DataFrame:
    """files (package_id, path, mime) whose type disagrees with the extension: adds ext, severity, detail."""
    rows = files.withColumn("ext", extension(F.col("path"))).withColumn("expected", _expected(F.col("ext")))
    severity, detail = _mismatch(F.col("ext"), F.col("expected"), F.col("mime"))
    return rows.select("package_id", "path", "ext", "mime", severity.alias("severity"), detail.alias("detail")).filter("severity is not null")


def _deceptive(path: Column) -> tuple[Column, Column, Column]:
    """(whether a name deceives, its last extension but one, its last extension)."""
    name = F.lower(basename(path))
    last, before = F.regexp_extract(name, r"\.([^.]*)$", 1), F.regexp_extract(name, r"([^.]*)\.[^.]*$", 1)
    safe = name.rlike(r"\.(" + "|".join(p.replace(".", r"\.") for p in SAFE_PAIRS) + ")$")
    return name.rlike(r"\..*\.") & ~safe & last.isin(EXECUTABLE_EXTENSIONS) & before.isin(DATA_LIKE_EXTENSIONS), before, last


def deceptive_extension(files: DataFrame) -> DataFrame:
    """Names whose last extension is executable and whose last but one looks like data."""
    found, shown, ext = _deceptive(F.col("path"))
    return files.filter(found).select("package_id", "path", shown.alias("shown"), ext.alias("ext"), F.lit("CRITICAL").alias("severity"))


def _embedded(ext: Column, content: Column, size: Column, limit: int) -> Column:
    """The severity of embedded code, or null."""
    active = content.rlike(SCRIPT)
    high = (ext.isin(SCRIPTABLE_EXTENSIONS) & active) | ((ext == "xml") & content.rlike(NAMESPACE) & active)
    critical = ext.isin(CODELESS_EXTENSIONS) & content.rlike(PROGRAM_TEXT)
    return F.when((size > 0) & (size < limit), F.when(critical, "CRITICAL").when(high, "HIGH"))


def embedded_code(files: DataFrame, limit: int = SCAN_LIMIT) -> DataFrame:
    """Scripts in scriptable markup, or in XML of such a vocabulary; program text in images and PDF."""
    ext = extension(F.col("path"))
    return files.select("package_id", "path", ext.alias("ext"), _embedded(ext, F.col("content"), F.col("size"), limit).alias("severity")).filter("severity is not null")


def image_hygiene(files: DataFrame) -> DataFrame:
    """Packages whose images are mislabelled as a habit: files (package_id, path, mime) -> one row for each such package."""
    images = files.withColumn("ext", extension(F.col("path"))).filter(F.col("ext").isin(IMAGE_EXTENSIONS)).groupBy("package_id").agg(F.count(F.lit(1)).alias("images"))
    low = mime_mismatch(files).filter("severity = 'LOW'").groupBy("package_id", F.concat("ext", F.lit("→"), "mime").alias("pair")).agg(F.count(F.lit(1)).alias("n"))
    per = low.groupBy("package_id").agg(F.sum("n").alias("mislabels"), F.count(F.lit(1)).alias("kinds"), F.max("n").alias("top"))
    rows = per.join(images, "package_id").withColumn("percent", F.floor(F.col("mislabels") * 100 / F.col("images")))
    severity = F.when((F.col("kinds") > 1) & (F.col("percent") >= 10), "HIGH").when((F.col("mislabels") >= 20) | (F.col("percent") >= 5), "MEDIUM")
    habit = F.when(F.floor(F.col("top") * 100 / F.col("mislabels")) >= 80, "systematic").otherwise("mixed")
    return rows.select("package_id", "images", "mislabels", "percent", severity.alias("severity"), habit.alias("habit")).filter("severity is not null")


def all_content_findings(files: DataFrame, limit: int = SCAN_LIMIT) -> DataFrame:
    """Every finding of the scan: (package_id, path, kind, type, severity). files need content, size and mime, and each path once.

    Content is read in one pass, which gives all findings of a file at once;
    image hygiene counts names and types alone in a second, narrow one.
    """
    path, ext, mime, content = F.col("path"), F.col("ext"), F.col("mime"), F.col("content")
    scanned = _scannable(F.col("size"), path, limit)
    lines = F.when(scanned & _matched(content), F.filter(F.split(content, "\n"), _matched))
    rows = files.select("package_id", "path", "mime", "content", "size", extension(path).alias("ext"), lines.alias("lines")).withColumn("expected", _expected(ext))
    finding = lambda test, kind, name, severity: F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("type"), severity.alias("severity")))
    hit = lambda pattern: F.exists("lines", lambda line: line.rlike(pattern))
    parts = [finding(hit(_any(PATTERNS[first - 1 : last])), "pattern", name, F.lit(level)) for name, level, first, last in PATTERN_TYPES]
    mismatch, embedded = _mismatch(ext, F.col("expected"), mime)[0], _embedded(ext, content, F.col("size"), limit)
    parts += [
        finding(mismatch.isNotNull(), "mime_mismatch", "mime_mismatch", mismatch), finding(_deceptive(path)[0], "deceptive_extension", "deceptive", F.lit("CRITICAL")),
        finding(embedded.isNotNull(), "embedded_code", "embedded_code", embedded),
    ]
    found = rows.select("package_id", "path", F.explode_outer(F.array_compact(F.array(*parts))).alias("f")).filter("f is not null").select("package_id", "path", "f.*")
    return found.unionByName(image_hygiene(files).select("package_id", F.lit("(scan root)").alias("path"), F.lit("file_hygiene").alias("kind"), F.lit("file_hygiene").alias("type"), "severity"))


def content_summary(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """For each of the `packages` (package_id, once or more) findings by severity and in all, 0 for a clean one. Low mislabels count as issues."""
    rows = findings.select("package_id", "severity").unionByName(packages.select("package_id"), allowMissingColumns=True)
    return rows.groupBy("package_id").agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")), F.count("severity").alias("total_issues"))


def content_risk(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """For each of the `packages` (package_id, once or more) the weighted score, and whether it fails (any critical or high finding)."""
    kind = F.col("kind")
    name = (
        F.when(kind == "mime_mismatch", F.concat(F.lit("mismatch_"), F.lower("severity")))
        .when(kind == "embedded_code", F.concat(F.lit("embedded_"), F.lower("severity")))
        .when(kind == "file_hygiene", F.concat(F.lit("hygiene_"), F.lower("severity")))
        .otherwise(F.col("type"))
    )
    weights = small(findings.sparkSession, list(CONTENT_WEIGHTS.items()), "name, weight")
    rows = findings.withColumn("name", name).join(F.broadcast(weights), "name", "left").select("package_id", "severity", "weight").unionByName(packages.select("package_id"), allowMissingColumns=True)
    scored = rows.groupBy("package_id").agg(F.sum(F.coalesce("weight", F.lit(0))).cast("long").alias("risk_score"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("serious"))
    return scored.select("package_id", "risk_score", F.when(F.col("serious") > 0, "fail").otherwise("pass").alias("status"))
