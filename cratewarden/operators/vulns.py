"""Vulnerability matches: scores, counts, weighted risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packages import with_clean
from ..functions.text import risk_level
from ..refdata import SEVERITY_WEIGHTS


def _first_of(version: str | None) -> Column:
    test = (lambda c: c["version"] == version) if version else (lambda c: c["version"].isNotNull())
    return F.get(F.filter("cvss", test), F.lit(0))["score"]


def pick_cvss(matches: DataFrame) -> DataFrame:
    """Adds score: of CVSS 3.1, else 3.0, else the first with a version, else 0."""
    return matches.withColumn("score", F.coalesce(_first_of("3.1"), _first_of("3.0"), _first_of(None), F.lit(0.0)))


def vuln_counts(matches: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Per package: matches by severity, those of unknown severity, all, and known ones without a score; 0 for the clean ones of `packages`."""
    known, severity = list(SEVERITY_WEIGHTS), F.col("severity")
    rows = with_clean(pick_cvss(matches).withColumn("severity", F.coalesce("severity", F.lit("Unknown"))), packages)
    return rows.groupBy("package_id").agg(
        *(F.count_if(severity == s).alias(s.lower()) for s in known), F.count_if(~severity.isin(known)).alias("unknown"), F.count("severity").alias("total"), F.count_if(severity.isin(known) & (F.col("score") == 0)).alias("unscored"),
    )


def _weighted(matches: DataFrame) -> DataFrame:
    """Scored matches with the share of each in the risk, as a decimal, so the order of rows doesn't show in sums."""
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY_WEIGHTS.items() for x in kv)), F.col("severity")), F.lit(0.0))
    return pick_cvss(matches).withColumn("share", F.col("score").cast("decimal(10,3)") * weight.cast("decimal(5,1)"))


def _risk(rows: DataFrame, *more: Column) -> DataFrame:
    found = rows.groupBy("package_id").agg(F.coalesce(F.round(F.sum("share"), 2).cast("double"), F.lit(0.0)).alias("weighted_risk"), *more)
    return found.withColumn("level", risk_level(F.col("weighted_risk")))


def vuln_risk(matches: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Per package: scores weighted by severity, to 2 decimals, and the level; 0 and LOW for the clean ones of `packages`."""
    return _risk(with_clean(_weighted(matches).select("package_id", "share"), packages))


def scrub_vuln_report(matches: DataFrame) -> DataFrame:
    """matches (package_id, vuln_id, details struct<path, realPath, matchDetails>) without cache paths and matcher internals."""
    path = F.when(F.col("details.path").rlike("/(\\.cache|tmp|var/cache)/"), "(local cache)").otherwise(F.col("details.path"))
    return matches.withColumn("details", F.col("details").withField("path", path).dropFields("realPath", "matchDetails"))


def merge_sbom_vulns(sboms: DataFrame, matches: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(package_id, document): an SBOM with its matches and risk, or the two alone where there is no SBOM. sboms (package_id, content).

    `packages` are those that were scanned, which by default all are: a clean one has an empty list of
    matches and a risk of 0; an SBOM that wasn't scanned has neither. A
    package's matches are one array there, as the document wants; the long
    table stays the one to query.
    """
    scanned = sboms.select("package_id") if packages is None else packages
    known = list(SEVERITY_WEIGHTS)
    total = lambda s: F.coalesce(F.round(F.sum(F.when(F.col("severity") == s, F.col("score").cast("decimal(10,3)"))), 2).cast("double"), F.lit(0.0)).alias(s.lower())
    rows = with_clean(_weighted(matches).select("package_id", "vuln_id", "severity", "score", "share"), scanned)
    match = F.when(F.col("share").isNotNull(), F.struct("vuln_id", "severity", "score"))
    judged = _risk(rows, F.array_sort(F.collect_list(match)).alias("matches"), F.struct(*(total(s) for s in known)).alias("cvss_totals"), F.struct(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in known)).alias("vuln_counts"))
    both = sboms.join(judged, "package_id", "full")
    risk = F.when(F.col("level").isNotNull(), F.struct("weighted_risk", "level", "cvss_totals", "vuln_counts"))
    body = F.struct(F.col("content").alias("sbom"), F.when(F.col("level").isNotNull(), F.struct("matches")).alias("vulnerability_scan"), risk.alias("risk_assessment"))
    return both.select("package_id", F.to_json(body).alias("document"))
