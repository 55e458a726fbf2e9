"""Provenance statements, build levels, attestations, and the roll-up into one risk and its gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import listed, risk_level
from ..refdata import PROVENANCE_BASE, small

#: Build requirements: the level that needs a field, the field, and what to record in it.
REQUIREMENTS = [
    (1, "builder_id", "name the builder by a URI"),
    (1, "policy_uri", "give the URI of the trust policy"),
    (2, "source_repo", "give the URL of the source repository"),
    (2, "source_ref", "give the branch or tag that was built"),
    (2, "build_trigger", "tell what started the build"),
    (2, "build_id", "give the identifier of the build run"),
    (3, "source_commit", "pin the source to a whole commit hash"),
    (3, "invocation_params", "record every input parameter of the build"),
]


def check_provenance(statements: DataFrame, expected: DataFrame) -> DataFrame:
    """statements (package_id, content) against expected (package_id, builder, repo): one row of checks for each statement."""
    get = lambda p: F.get_json_object("content", p)
    rows = statements.join(expected, "package_id", "left")
    builder = F.coalesce(get("$.predicate.runDetails.builder.id"), get("$.predicate.builder.id"))
    source = F.coalesce(get("$.predicate.buildDefinition.externalParameters.source"), get("$.predicate.invocation.configSource.uri"))
    is_json = F.try_parse_json("content").isNotNull()
    valid = is_json & F.coalesce(get("$.predicateType").contains("slsa.dev/provenance"), F.lit(False))
    trusted = valid & F.coalesce(F.when(F.col("builder").isNull(), builder.isNotNull()).otherwise(builder.contains(F.col("builder"))), F.lit(False))
    repo = valid & F.coalesce(source.contains(F.col("repo")), F.lit(False))
    signed = valid & (get("$.signatures").isNotNull() | get("$.dsseEnvelope").isNotNull())
    level = F.when(trusted & signed, 2).when(valid & builder.isNotNull(), 1).otherwise(0)
    issues = F.size(listed(F.when(~is_json, "not JSON"), F.when(is_json & ~valid, "no provenance predicate"), F.when(valid & ~trusted, "builder"), F.when(valid & F.col("repo").isNotNull() & ~repo, "source")))
    return rows.select("package_id", is_json.alias("found"), valid.alias("valid"), trusted.alias("builder_trusted"), repo.alias("source_verified"), signed.alias("signed"), level.alias("slsa_level"), issues.alias("issues"))


def registry_presence(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """packages (package_id, name, version) against a snapshot registry (name, version): known by name, and in that version."""
    names = registry.select("name").distinct().withColumn("known", F.lit(True))
    versions = registry.select("name", "version").distinct().withColumn("exact", F.lit(True))
    rows = packages.join(names, "name", "left").join(versions, ["name", "version"], "left")
    return rows.select("package_id", "name", "version", F.coalesce("known", F.lit(False)).alias("name_known"), F.coalesce("exact", F.lit(False)).alias("version_known"))


def provenance_risk(checks: DataFrame) -> DataFrame:
    """checks (package_id, package_type, found, valid, source_verified, builder_trusted, slsa_level, files_verified) -> risk."""
    base = small(checks.sparkSession, list(PROVENANCE_BASE.items()), "package_type, base")
    rows = checks.join(F.broadcast(base), "package_type", "left")
    minus = sum((F.when(F.coalesce(F.col(c), F.lit(False)), n).otherwise(0) for c, n in (("found", 100), ("valid", 50), ("source_verified", 50), ("builder_trusted", 50), ("files_verified", 50))), F.when(F.col("slsa_level") >= 2, 50).otherwise(0))
    return rows.select("package_id", F.greatest(F.coalesce("base", F.lit(300)) - minus, F.lit(0)).alias("risk"))


def provenance_status(checks: DataFrame) -> DataFrame:
    """checks (package_id, issues, critical_issues, slsa_level, skip_public) -> status."""
    clean, level = F.col("issues") == 0, F.col("slsa_level")
    status = (
        F.when(clean & (level >= 2), "verified").when(clean & (level >= 1), "partial")
        .when(F.col("skip_public") & (F.col("critical_issues") == 0), F.when(level >= 1, "partial").otherwise("no_provenance")).when(~clean, "failed").otherwise("no_provenance")
    )
    return checks.select("package_id", status.alias("status"))


def slsa_levels(builds: DataFrame, target: int = 3) -> DataFrame:
    """Per build: the highest level reached, unmet requirements with remediation, and warnings for a target level."""
    met = {field: F.coalesce(F.col(field) != "", F.lit(False)) & ((F.col(field) != "observer-only") if field == "builder_id" else F.lit(True)) for _, field, _ in REQUIREMENTS}
    reached = {}
    for level in (1, 2, 3):
        own = reduce(lambda a, b: a & b, (met[f] for n, f, _ in REQUIREMENTS if n == level))
        reached[level] = own if level == 1 else reached[level - 1] & own
    highest = F.when(reached[3], 3).when(reached[2], 2).when(reached[1], 1).otherwise(0)
    steps = [F.when(~met[f], F.lit(f"{f} (level {n}): {text}")) for n, f, text in REQUIREMENTS] + [F.when(~reached[2], F.lit("level 3 builds on level 2"))]
    empty = lambda f: ~F.coalesce(F.col(f) != "", F.lit(False))
    warn = [(2, "source_repo"), (2, "build_trigger"), (2, "build_id"), (3, "source_commit"), (3, "invocation_params")]
    warnings = [F.when(empty(f), F.lit(f)) for n, f in warn if n <= target]
    return builds.select("package_id", highest.alias("slsa_level"), listed(*steps).alias("remediation"), listed(*(F.when(~met[f], F.lit(f)) for _, f, _ in REQUIREMENTS)).alias("unmet"), listed(*warnings).alias("warnings")).withColumn("unmet_count", F.size("unmet"))


def attestation_documents(packages: DataFrame) -> DataFrame:
    """packages (package_id, name, sha256, recorded_sha256, slsa_level, builder_id, source_repo, source_commit, total_issues) -> an in-toto statement each.

    The source appears from level 2 on, the commit at level 3; a warning tells
    that the recorded digest isn't the artifact's.
    """
    level = F.col("slsa_level")
    parameters = F.struct(F.when(level >= 2, F.col("source_repo")).alias("source"), F.when(level >= 3, F.col("source_commit")).alias("commit"))
    statement = F.struct(
        F.lit("https://in-toto.io/Statement/v1").alias("_type"), F.array(F.struct(F.col("name"), F.struct("sha256").alias("digest"))).alias("subject"), F.lit("https://slsa.dev/provenance/v1").alias("predicateType"),
        F.struct(F.struct(parameters.alias("externalParameters")).alias("buildDefinition"), F.struct(F.struct(F.col("builder_id").alias("id")).alias("builder")).alias("runDetails"), F.struct(F.col("total_issues")).alias("scanSummary")).alias("predicate"),
    )
    warning = F.when(F.lower("recorded_sha256") != F.lower("sha256"), "recorded digest differs from the artifact")
    return packages.select("package_id", F.to_json(statement).alias("statement"), warning.alias("warning"))


def package_risk(**parts: DataFrame) -> DataFrame:
    """Sum of each package's risks: parts checksum, provenance, vulnerabilities, license, audit, each (package_id, risk).

    A missing part counts 0. All parts are hashed by package_id, so the joins
    share their exchanges.
    """
    out = None
    for name, part in parts.items():
        own = part.select("package_id", F.col("risk").cast("double").alias(f"{name}_risk"))
        out = own if out is None else out.join(own, "package_id", "full")
    columns = [f"{name}_risk" for name in parts]
    out = out.select("package_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))
    total = F.round(sum((F.col(c) for c in columns), F.lit(0.0)), 2)
    return out.withColumn("total_risk", total).withColumn("level", risk_level(F.col("total_risk")))


def ci_gates(packages: DataFrame, *, max_risk: float = 1000, fail_on: str = "high", gpl: bool = True, names: bool = True) -> DataFrame:
    """packages (package_id, total_risk, critical, high, gpl_incompatible, confusion, typosquat) -> failures and whether all gates hold."""
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("critical", "high", "gpl_incompatible", "confusion", "typosquat")}
    severe = counts["critical"] if fail_on == "critical" else counts["critical"] + counts["high"]
    text = lambda n, what: F.concat(n.cast("string"), F.lit(f" {what}"))
    failures = [F.when(F.col("total_risk") >= max_risk, F.lit(f"risk at or above {max_risk:g}")), F.when(severe > 0, text(severe, "severe vulnerabilities"))]
    if gpl:
        failures.append(F.when(counts["gpl_incompatible"] > 0, text(counts["gpl_incompatible"], "GPL-incompatible licenses")))
    if names:
        failures += [F.when(counts["confusion"] > 0, text(counts["confusion"], "dependency confusions")), F.when(counts["typosquat"] > 0, text(counts["typosquat"], "typosquats"))]
    return packages.select("package_id", listed(*failures).alias("failures")).withColumn("passed", F.size("failures") == 0)


def rank_packages(packages: DataFrame, n: int = 20) -> DataFrame:
    """The n worst packages of the fleet, worst first; ties by package_id."""
    return packages.orderBy(F.col("total_risk").desc(), "package_id").limit(n)
