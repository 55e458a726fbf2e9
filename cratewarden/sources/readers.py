"""File trees, archives, SBOMs and reports as tables. Schemas are fixed: nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.files import EXCLUDED
from .archives import KEEP
from .trees import list_tree, open_uri

SPDX = (
    "struct<spdxVersion:string,name:string,documentDescribes:array<string>,"
    "packages:array<struct<SPDXID:string,name:string,versionInfo:string,licenseConcluded:string,licenseDeclared:string,fileName:string,sourceInfo:string,"
    "checksums:array<struct<algorithm:string,checksumValue:string>>,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>,"
    "relationships:array<struct<spdxElementId:string,relationshipType:string,relatedSpdxElement:string>>>"
)
CYCLONEDX = (
    "struct<bomFormat:string,metadata:struct<component:struct<name:string,version:string,`bom-ref`:string,licenses:array<struct<expression:string,license:struct<id:string,name:string>>>>>,"
    "components:array<struct<type:string,name:string,version:string,purl:string,hashes:array<struct<alg:string,content:string,value:string>>,"
    "evidence:struct<occurrences:array<struct<location:string>>>,licenses:array<struct<expression:string,license:struct<id:string,name:string>>>>>>"
)
VULNERABILITIES = "struct<matches:array<struct<vulnerability:struct<id:string,severity:string,cvss:array<struct<version:string,metrics:struct<baseScore:double>>>>>>>"
LINTER_TOTALS = "struct<totals:struct<errors:int,warnings:int,fixable:int>>"
LINTER = "struct<files:map<string,struct<errors:int,warnings:int,messages:array<struct<message:string,source:string,severity:int,fixable:boolean,type:string,line:int,column:int>>>>>"


def read_package_files(spark: SparkSession, root: str, *, content: bool = True, keep: int = KEEP) -> DataFrame:
    """(package_id, path, size, content) of every file below root/<package>/, outside excluded directories, hidden and empty files too.

    Tasks list the folders, those of one depth in a round, and then read the
    files; Spark's own reader leaves out names that begin with a dot or an underscore, which
    an audit needs most. A file over `keep` bytes has no content. Symbolic
    links aren't followed. Works with stores that pyarrow opens.
    """
    found = list_tree(spark, root).filter("kind = 'file'").select(F.substring_index("path", "/", 1).alias("package_id"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "size", F.col("path").alias("inner"))
    rows = found.filter(F.col("inner").contains("/") & ~F.col("path").rlike(EXCLUDED))
    if not content:
        return rows.drop("inner")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                inner = row.pop("inner")
                row["content"] = None
                if row["size"] <= keep:
                    with store.open_input_stream(f"{top.rstrip('/')}/{inner}", compression=None) as source:
                        row["content"] = source.read()
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("package_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
    return rows.select("package_id", "path", "size", "inner").mapInArrow(read, "package_id string, path string, size long, content binary")


def read_sbom(df: DataFrame) -> DataFrame:
    """df (package_id, sbom_id, content) -> components; documents of neither format give no rows.

    (package_id, sbom_id, format, spdxid, name, version, ptype, license, purl, is_root).
    """
    both = df.withColumns({"s": F.from_json("content", SPDX), "c": F.from_json("content", CYCLONEDX)})
    key = ["package_id", "sbom_id"]
    spdx = both.filter("s.spdxVersion is not null").select(*key, F.col("s.documentDescribes").alias("roots"), F.explode("s.packages").alias("p"))
    purl = F.get(F.filter("p.externalRefs", lambda r: r["referenceType"] == "purl"), F.lit(0))["referenceLocator"]
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\(", ""), r"\)$", "")
    spdx = spdx.select(
        *key, F.lit("spdx").alias("format"), F.col("p.SPDXID").alias("spdxid"), "p.name", F.coalesce("p.versionInfo", F.lit("unknown")).alias("version"), F.lit(None).cast("string").alias("ptype"),
        trimmed(F.coalesce("p.licenseConcluded", "p.licenseDeclared", F.lit("NOASSERTION"))).alias("license"), F.when(F.size("p.externalRefs") > 0, purl).alias("purl"), F.coalesce(F.array_contains("roots", F.col("p.SPDXID")), F.lit(False)).alias("is_root"),
    )
    cyclone = both.filter("s.spdxVersion is null and c.bomFormat = 'CycloneDX'").select(*key, F.explode("c.components").alias("p"))
    expression = F.get(F.filter("p.licenses", lambda x: x["expression"].isNotNull()), F.lit(0))["expression"]
    ids = F.array_join(F.filter(F.transform("p.licenses", lambda x: F.coalesce(x["license"]["id"], x["license"]["name"])), lambda x: x.isNotNull() & (x != "")), " OR ")
    cyclone = cyclone.select(
        *key, F.lit("cyclonedx").alias("format"), F.lit(None).cast("string").alias("spdxid"), "p.name", F.coalesce("p.version", F.lit("unknown")).alias("version"), F.col("p.type").alias("ptype"),
        F.when(F.size("p.licenses") > 0, F.coalesce(expression, F.when(ids != "", ids))).alias("license"), "p.purl", F.lit(False).alias("is_root"),
    )
    return spdx.unionByName(cyclone)


def read_vuln_report(df: DataFrame) -> DataFrame:
    """df (package_id, content) -> matches (package_id, vuln_id, severity, cvss)."""
    rows = df.select("package_id", F.explode(F.from_json("content", VULNERABILITIES)["matches"]).alias("m"))
    cvss = F.transform("m.vulnerability.cvss", lambda c: F.struct(c["version"].alias("version"), c["metrics"]["baseScore"].alias("score")))
    return rows.select("package_id", F.col("m.vulnerability.id").alias("vuln_id"), F.coalesce("m.vulnerability.severity", F.lit("Unknown")).alias("severity"), F.coalesce(cvss, F.array().cast("array<struct<version:string,score:double>>")).alias("cvss"))


def read_phpcs_report(df: DataFrame) -> DataFrame:
    """df (package_id, content) -> messages; a report that doesn't parse gives one row of type PARSE_ERROR. A clean report has no row here, but in `read_phpcs_totals`."""
    doc = df.withColumn("doc", F.from_json("content", LINTER))
    rows = doc.filter("doc.files is not null").select("package_id", F.explode("doc.files").alias("file", "f")).select("package_id", "file", F.explode("f.messages").alias("m"))
    good = rows.select("package_id", "file", "m.line", F.col("m.column").alias("col"), "m.type", "m.message", "m.source", "m.severity", F.coalesce("m.fixable", F.lit(False)).alias("fixable"))
    bad = doc.filter(F.try_parse_json("content").isNull()).select("package_id", F.lit("PARSE_ERROR").alias("type"), F.lit("unreadable report").alias("message"))
    return good.unionByName(bad, allowMissingColumns=True)


def read_phpcs_totals(df: DataFrame) -> DataFrame:
    """df (package_id, content) -> (package_id, success, errors, warnings, fixable, files) of each report, clean ones too.

    The report's own totals count; where it has none, those of its files, and
    for fixable ones its messages. A report that doesn't parse has no success and zeros.
    """
    doc = df.select("package_id", F.try_parse_json("content").isNotNull().alias("success"), F.from_json("content", LINTER_TOTALS)["totals"].alias("t"), F.map_values(F.from_json("content", LINTER)["files"]).alias("files"))
    zero = F.lit(0).cast("long")
    summed = lambda field: F.aggregate("files", zero, lambda n, f: n + F.coalesce(field(f).cast("long"), zero))
    fixable = summed(lambda f: F.size(F.filter(f["messages"], lambda m: F.coalesce(m["fixable"], F.lit(False)))) * F.when(f["messages"].isNotNull(), 1).otherwise(0))
    counts = {"errors": summed(lambda f: f["errors"]), "warnings": summed(lambda f: f["warnings"]), "fixable": fixable}
    return doc.select("package_id", "success", *(F.coalesce(F.when(F.col("success"), F.coalesce(F.col("t")[c].cast("long"), n)), zero).alias(c) for c, n in counts.items()), F.coalesce(F.array_size("files"), F.lit(0)).cast("long").alias("files"))


def scanned_packages(reports: DataFrame) -> DataFrame:
    """The packages (package_id) whose report parses: the list for summaries of a scan, since a clean package is in no row of its findings."""
    return reports.filter(F.try_parse_json("content").isNotNull()).select("package_id").distinct()


def read_target_list(df: DataFrame, column: str = "value") -> DataFrame:
    """Targets of lists parted by commas, semicolons and newlines, without white space, blanks and lines of comment."""
    lines = df.select(F.explode(F.split(column, "\n")).alias("line")).filter(~F.col("line").rlike(r"^\s*#"))
    return lines.select(F.explode(F.split("line", "[,;]")).alias("t")).select(F.regexp_replace("t", r"\s", "").alias("target")).filter("target <> '' and not startswith(target, '#')")
