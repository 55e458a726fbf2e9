"""Queries over checksums, identity, provenance and the roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import content as C
from ..operators import files as O
from ..operators import integrity as I
from ..operators import licenses as L
from ..operators import provenance as P
from ..operators import vulns as V
from ..sources import sinks as S
from ..sources.shared import new_path
from . import supply
from .filescan import FINDINGS
from .registry import Registry

jobs = Registry()

DIG = ", dig AS (SELECT package_id, path, sha256(content) AS sha256 FROM files)"
_uniq = lambda f: f.groupBy("package_id", "path").agg(F.min("content").alias("content"))
UNIQ = ", u AS (SELECT package_id, path, min(content) AS content FROM files GROUP BY ALL)"
jobs.add("file_digests", lambda f: I.file_digests(f).select("package_id", "path", "sha256", F.length("sha384").alias("n384"), F.length("sha512").alias("n512")), "files", sql=f"{DIG} SELECT package_id, path, sha256, CAST(96 AS INT) AS n384, CAST(128 AS INT) AS n512 FROM dig")
jobs.add("tree_digest", I.tree_digest, "files", sql=f"{DIG} SELECT package_id, sha256(string_agg(sha256 || '  ' || path || chr(10), '' ORDER BY path, sha256)) AS digest FROM dig GROUP BY 1")
jobs.add("detect_identity", I.detect_identity, "plugin_files", sql=r"""SELECT package_id, CASE WHEN bool_or(path = 'readme.txt') THEN 'readme.txt' WHEN bool_or(path = 'plugin.php') THEN 'plugin header' ELSE 'file name' END AS source, CASE WHEN bool_or(path IN ('readme.txt', 'plugin.php')) THEN 'wordpress' ELSE 'unknown' END AS ecosystem, CAST(NULL AS VARCHAR) AS vendor,
 CASE WHEN bool_or(path = 'readme.txt') THEN 'Demo' WHEN bool_or(path = 'plugin.php') THEN 'Demo ' || substr(package_id, 4) ELSE package_id END AS name, CASE WHEN bool_or(path IN ('readme.txt', 'plugin.php')) THEN '1.' || (CAST(substr(package_id, 4) AS BIGINT) % 9) END AS version FROM plugin_files GROUP BY package_id""")
REF = "SELECT package_id, CASE k % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'composer' ELSE 'pypi' END AS ecosystem, CASE WHEN k % 2 = 0 THEN 'sdist' ELSE 'wheel' END AS kind, k, p_name FROM sboms"
jobs.add("normalise_reference_hash", lambda s: I.normalise_reference_hash(s.select("package_id", F.expr("CASE k % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'composer' ELSE 'pypi' END").alias("ecosystem"), F.expr("CASE WHEN k % 2 = 0 THEN 'sdist' ELSE 'wheel' END").alias("kind"), F.expr("CASE k % 3 WHEN 0 THEN concat('sha256-', base64(unhex(sha2(p_name, 256)))) WHEN 1 THEN CASE WHEN k % 2 = 0 THEN upper(substring(sha2(p_name, 256), 1, 40)) WHEN k % 5 = 0 THEN 'short' ELSE sha2(p_name, 256) END ELSE upper(sha2(p_name, 256)) END").alias("value"))), "sboms", sql=f"""SELECT package_id, CASE WHEN ecosystem = 'composer' AND k % 2 = 0 THEN 'sha1' ELSE 'sha256' END AS algorithm, CASE WHEN ecosystem = 'composer' AND k % 2 = 0 THEN substr(sha256(p_name), 1, 40) ELSE sha256(p_name) END AS hash FROM ({REF}) r WHERE NOT (ecosystem = 'composer' AND k % 2 = 1 AND k % 5 = 0)""")


def _calculated(sboms):
    digest = lambda n: F.sha2(F.col("p_name"), n).alias(f"sha{n}")
    return sboms.select("package_id", F.lit("1").alias("version"), *(digest(n) for n in (256, 384, 512)), "k")


def _reference(sboms):
    rows = _calculated(sboms).filter("k % 5 <> 0")
    wrong = F.when(F.col("k") % 7 == 0, "00").otherwise(F.upper("sha256"))
    return rows.select("package_id", "version", F.when(F.col("k") % 4 > 0, wrong).alias("sha256"), F.when(F.col("k") % 3 > 0, F.col("sha384")).alias("sha384"), F.lit(None).cast("string").alias("sha512"))


CHECKS = """, chk AS (SELECT package_id, k, CASE WHEN k % 5 = 0 THEN 'no_reference_available' WHEN k % 12 = 0 THEN 'skipped' WHEN k % 4 > 0 AND k % 7 = 0 THEN 'failed' ELSE 'verified' END AS status, CASE WHEN k % 5 = 0 THEN 0 ELSE CAST(k % 4 > 0 AS INT) + CAST(k % 3 > 0 AS INT) END AS checked FROM sboms), cks AS (SELECT package_id, '1' AS version, status, checked, CASE status WHEN 'failed' THEN 500 WHEN 'no_reference_available' THEN 50 ELSE 0 END AS risk FROM chk)"""
jobs.add("verify_checksums", lambda s: I.verify_checksums(_calculated(s).drop("k"), _reference(s)), "sboms", sql=f"{CHECKS} SELECT * FROM cks")
_sums = lambda f: _uniq(f).select("package_id", "path", F.sha2("content", 256).alias("sha256"))
jobs.add("verify_file_manifest", lambda f: I.verify_file_manifest(_sums(f).filter("length(path) % 5 <> 0"), _sums(f).withColumn("sha256", F.expr("CASE WHEN length(path) % 6 = 0 THEN NULL WHEN length(path) % 11 = 0 THEN 'ff' ELSE upper(sha256) END"))), "files", sql=f"""{UNIQ}, c AS (SELECT package_id, CASE WHEN length(path) % 6 = 0 OR length(path) % 5 = 0 THEN 's' WHEN length(path) % 11 = 0 THEN 'f' ELSE 'p' END AS r FROM u)
 SELECT package_id, count(*) FILTER (r = 'p') AS passed, count(*) FILTER (r = 'f') AS failed, count(*) FILTER (r = 's') AS skipped, CASE WHEN count(*) FILTER (r = 'f') > 0 THEN 'CRITICAL' END AS severity FROM c GROUP BY 1""")

# --- provenance ---
STATEMENT = """CASE WHEN k % 6 = 0 THEN 'nope' WHEN k % 6 = 1 THEN '{"predicateType":"other"}' ELSE concat('{"predicateType":"https://slsa.dev/provenance/v1","predicate":{"runDetails":{"builder":{"id":"https://ci.example/', k % 3, '"}},"buildDefinition":{"externalParameters":{"source":"https://git.example/r', k % 2, '"}}}', CASE WHEN k % 4 = 0 THEN ',"signatures":[1]' ELSE '' END, '}') END"""
_statements = lambda s: s.select("package_id", F.expr(STATEMENT).alias("content"))
_expected = lambda s: s.select("package_id", F.expr("CASE WHEN k % 5 > 0 THEN 'ci.example/1' END").alias("builder"), F.expr("CASE WHEN k % 7 > 0 THEN 'git.example/r1' END").alias("repo"))
PROV = """, pv AS (SELECT package_id, k, k % 6 > 0 AS found, k % 6 > 1 AS valid, k % 6 > 1 AND (k % 5 = 0 OR k % 3 = 1) AS builder_trusted, k % 6 > 1 AND k % 7 > 0 AND k % 2 = 1 AS source_verified, k % 6 > 1 AND k % 4 = 0 AS signed FROM sboms),
 prov AS (SELECT package_id, k, found, valid, builder_trusted, source_verified, signed, CASE WHEN builder_trusted AND signed THEN 2 WHEN valid THEN 1 ELSE 0 END AS slsa_level, CAST(NOT found AS INT) + CAST(found AND NOT valid AS INT) + CAST(valid AND NOT builder_trusted AS INT) + CAST(valid AND k % 7 > 0 AND NOT source_verified AS INT) AS issues FROM pv)"""
jobs.add("check_provenance", lambda s: P.check_provenance(_statements(s), _expected(s)), "sboms", sql=f"{PROV} SELECT * EXCLUDE (k) FROM prov")
jobs.add("registry_presence", lambda c, b: P.registry_presence(c.select("package_id", "name", "version").distinct(), b.filter("length(name) % 5 > 0").select("name", "version")), "components", "baseline", sql="""SELECT c.package_id, c.name, c.version, c.name IN (SELECT name FROM baseline WHERE length(name) % 5 > 0) AS name_known, (c.name, c.version) IN (SELECT (name, version) FROM baseline WHERE length(name) % 5 > 0) AS version_known FROM (SELECT DISTINCT package_id, name, version FROM components) c""")
_typed = lambda s: P.check_provenance(_statements(s), _expected(s)).join(s.select("package_id", F.expr("element_at(array('public', 'custom', 'internal', 'prerelease', 'odd'), CAST(k % 5 + 1 AS INT))").alias("package_type"), (F.col("k") % 8 == 0).alias("files_verified"), (F.col("k") % 3 == 0).alias("skip_public")), "package_id")
PRISK = """, prisk AS (SELECT package_id, greatest(0, (CASE k % 5 WHEN 1 THEN 150 WHEN 2 THEN 100 WHEN 3 THEN 100 ELSE 300 END) - 100 * CAST(found AS INT) - 50 * CAST(valid AS INT) - 50 * CAST(source_verified AS INT) - 50 * CAST(builder_trusted AS INT) - 50 * CAST(k % 8 = 0 AS INT) - 50 * CAST(slsa_level >= 2 AS INT)) AS risk FROM prov)"""
jobs.add("provenance_risk", lambda s: P.provenance_risk(_typed(s)), "sboms", sql=f"{PROV}{PRISK} SELECT package_id, CAST(risk AS INT) AS risk FROM prisk")
jobs.add("provenance_status", lambda s: P.provenance_status(_typed(s).withColumn("critical_issues", F.when(~F.col("found"), 1).otherwise(0))), "sboms", sql=f"{PROV} SELECT package_id, CASE WHEN issues = 0 AND slsa_level >= 2 THEN 'verified' WHEN issues = 0 AND slsa_level >= 1 THEN 'partial' WHEN k % 3 = 0 AND found THEN CASE WHEN slsa_level >= 1 THEN 'partial' ELSE 'no_provenance' END WHEN issues > 0 THEN 'failed' ELSE 'no_provenance' END AS status FROM prov")
BUILD_FIELDS = {"builder_id": "CASE WHEN k % 11 = 0 THEN 'observer-only' WHEN k % 11 > 1 THEN 'b' END", "policy_uri": "CASE WHEN k % 7 > 0 THEN 'p' END", "source_repo": "CASE WHEN k % 5 > 0 THEN 'r' ELSE '' END", "source_ref": "CASE WHEN k % 3 > 0 THEN 'main' END", "build_trigger": "'push'", "build_id": "CASE WHEN k % 13 > 0 THEN '7' END", "source_commit": "CASE WHEN k % 2 = 0 THEN 'c0ffee' END", "invocation_params": "CASE WHEN k % 4 < 3 THEN '{}' END"}
_builds = lambda s: s.select("package_id", "k", *(F.expr(e).alias(c) for c, e in BUILD_FIELDS.items()))
_unmet = ", ".join(f"CASE WHEN coalesce({f}, '') = ''{' OR builder_id = ' + chr(39) + 'observer-only' + chr(39) if f == 'builder_id' else ''} THEN '{f}' END" for f in BUILD_FIELDS)
BUILDS = f""", bd AS (SELECT package_id, k, {', '.join(f'{e} AS {c}' for c, e in BUILD_FIELDS.items())} FROM sboms), bl AS (SELECT *, list_filter([{_unmet}], lambda x: x IS NOT NULL) AS unmet FROM bd), bv AS (SELECT *, CASE WHEN list_has_any(unmet, ['builder_id', 'policy_uri']) THEN 0 WHEN list_has_any(unmet, ['source_repo', 'source_ref', 'build_trigger', 'build_id']) THEN 1 WHEN len(unmet) > 0 THEN 2 ELSE 3 END AS slsa_level FROM bl)"""
jobs.add("slsa_levels", lambda s: P.slsa_levels(_builds(s)).select("package_id", "slsa_level", F.array_join("unmet", ",").alias("unmet"), F.array_join("warnings", ",").alias("warnings"), F.size("remediation").alias("steps"), "unmet_count"), "sboms", sql=f"""{BUILDS} SELECT package_id, slsa_level, array_to_string(unmet, ',') AS unmet, array_to_string(list_filter([CASE WHEN coalesce(source_repo, '') = '' THEN 'source_repo' END, CASE WHEN coalesce(build_id, '') = '' THEN 'build_id' END, CASE WHEN source_commit IS NULL THEN 'source_commit' END, CASE WHEN invocation_params IS NULL THEN 'invocation_params' END], lambda x: x IS NOT NULL), ',') AS warnings, CAST(len(unmet) + CAST(slsa_level < 2 AS INT) AS INT) AS steps, CAST(len(unmet) AS INT) AS unmet_count FROM bv""")


def _attested(s):
    levels = P.slsa_levels(_builds(s)).select("package_id", "slsa_level")
    rows = _builds(s).join(levels, "package_id").join(s.select("package_id", F.col("p_name").alias("name")), "package_id")
    return P.attestation_documents(rows.withColumns({"sha256": F.sha2("name", 256), "recorded_sha256": F.when(F.col("k") % 6 == 0, "ab").otherwise(F.upper(F.sha2("name", 256))), "total_issues": F.col("k") % 4}))


jobs.add("attestation_documents", lambda s: _attested(s).select("package_id", F.get_json_object("statement", "$.subject[0].digest.sha256").alias("sha256"), F.get_json_object("statement", "$.predicate.buildDefinition.externalParameters.source").alias("source"), F.get_json_object("statement", "$.predicate.buildDefinition.externalParameters.commit").alias("commit"), "warning"), "sboms", sql=f"{BUILDS} SELECT bv.package_id, sha256(p_name) AS sha256, CASE WHEN slsa_level >= 2 THEN source_repo END AS source, CASE WHEN slsa_level >= 3 THEN source_commit END AS commit, CASE WHEN bv.k % 6 = 0 THEN 'recorded digest differs from the artifact' END AS warning FROM bv JOIN sboms USING (package_id)")

# --- roll-up ---


def _risks(s, m, c):
    return P.package_risk(
        checksum=I.verify_checksums(_calculated(s).drop("k"), _reference(s)), provenance=P.provenance_risk(_typed(s)), vulnerabilities=V.vuln_risk(supply.scored_matches(m)).select("package_id", F.col("weighted_risk").alias("risk")),
        license=L.license_summary(c).select("package_id", F.col("risk_score").alias("risk")), audit=A.audit_summary(A.audit_findings(c)).select("package_id", F.col("risk_score").alias("risk")),
    )


TOTAL = f"""{CHECKS}{PROV}{PRISK}{supply.SCORED}{supply.LICENSED}, ls AS ({supply.LICENSE_SUMMARY}){supply.AUDIT}, au AS ({supply.AUDIT_SUM}), ids AS (SELECT package_id FROM cks UNION SELECT package_id FROM prisk UNION SELECT package_id FROM vrisk UNION SELECT package_id FROM ls UNION SELECT package_id FROM au),
 parts AS (SELECT i.package_id, coalesce(CAST(cks.risk AS DOUBLE), 0) AS checksum_risk, coalesce(CAST(prisk.risk AS DOUBLE), 0) AS provenance_risk, coalesce(weighted_risk, 0) AS vulnerabilities_risk, coalesce(CAST(ls.risk_score AS DOUBLE), 0) AS license_risk, coalesce(CAST(au.risk_score AS DOUBLE), 0) AS audit_risk FROM ids i LEFT JOIN cks USING (package_id) LEFT JOIN prisk USING (package_id) LEFT JOIN vrisk USING (package_id) LEFT JOIN ls USING (package_id) LEFT JOIN au USING (package_id)),
 total AS (SELECT *, CASE WHEN total_risk >= 1000 THEN 'CRITICAL' WHEN total_risk >= 500 THEN 'HIGH' WHEN total_risk >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT *, round(checksum_risk + provenance_risk + vulnerabilities_risk + license_risk + audit_risk, 2) AS total_risk FROM parts))"""
jobs.add("package_risk", _risks, "sboms", "matches", "components", sql=f"{TOTAL} SELECT * FROM total")


def _gates(s, m, c):
    rows = _risks(s, m, c).join(V.vuln_counts(supply.scored_matches(m)).select("package_id", "critical", "high"), "package_id", "left").join(L.license_summary(c).select("package_id", "gpl_incompatible"), "package_id", "left")
    audit = A.audit_summary(A.audit_findings(c)).select("package_id", F.col("dependency_confusion").alias("confusion"), "typosquat")
    return P.ci_gates(rows.join(audit, "package_id", "left")).select("package_id", F.array_join("failures", "; ").alias("failures"), "passed")


jobs.add("ci_gates", _gates, "sboms", "matches", "components", sql=f"""{TOTAL}, sev AS (SELECT package_id, count(*) FILTER (severity IN ('Critical', 'High')) AS n FROM sc GROUP BY 1), g AS (SELECT t.package_id, list_filter([CASE WHEN total_risk >= 1000 THEN 'risk at or above 1000' END, CASE WHEN n > 0 THEN n || ' severe vulnerabilities' END, CASE WHEN gpl_incompatible > 0 THEN gpl_incompatible || ' GPL-incompatible licenses' END, CASE WHEN dependency_confusion > 0 THEN dependency_confusion || ' dependency confusions' END, CASE WHEN typosquat > 0 THEN typosquat || ' typosquats' END], lambda x: x IS NOT NULL) AS f
 FROM total t LEFT JOIN sev USING (package_id) LEFT JOIN ls USING (package_id) LEFT JOIN au USING (package_id)) SELECT package_id, array_to_string(f, '; ') AS failures, len(f) = 0 AS passed FROM g""")
jobs.add("rank_packages", lambda s, m, c: P.rank_packages(_risks(s, m, c)).select("package_id", "total_risk", "level"), "sboms", "matches", "components", sql=f"{TOTAL} SELECT package_id, total_risk, level FROM total ORDER BY total_risk DESC, package_id LIMIT 20")
jobs.add("write_package_documents", lambda f: _kept_documents(f).select("package_id", F.get_json_object("document", "$.stats.files").cast("bigint").alias("files"), F.get_json_object("document", "$.filescan.total_issues").cast("bigint").alias("total_issues")), "files", sql=f"{FINDINGS}, s AS (SELECT package_id, count(*) AS files FROM files GROUP BY 1), c AS (SELECT package_id, count(*) AS n FROM found GROUP BY 1) SELECT package_id, files, coalesce(n, 0) AS total_issues FROM s LEFT JOIN c USING (package_id)")


def _kept_documents(files):
    """What a store holds after two scans that each write their own key, the second of them twice."""
    spark = files.sparkSession
    path = new_path(spark, "package-documents")
    S.write_package_documents(S.package_documents(stats=O.file_totals(files)), path)
    scan = S.package_documents(filescan=C.content_summary(C.all_content_findings(files), files))
    for _ in range(2):
        S.write_package_documents(scan, path)
    return S.read_package_documents(spark, path)


jobs.add("result_envelope", lambda s: S.result_envelope(P.slsa_levels(_builds(s)).select("package_id", "slsa_level", F.col("unmet").alias("issues")), "slsa").select("package_id", F.get_json_object("envelope", "$.tool").alias("tool"), F.get_json_object("envelope", "$.success").alias("success"), F.get_json_object("envelope", "$.summary.issue_count").alias("issue_count"), F.get_json_object("envelope", "$.data.slsa_level").alias("slsa_level")), "sboms", sql=f"{BUILDS} SELECT package_id, 'slsa' AS tool, CASE WHEN len(unmet) = 0 THEN 'true' ELSE 'false' END AS success, CAST(len(unmet) AS VARCHAR) AS issue_count, CAST(slsa_level AS VARCHAR) AS slsa_level FROM bv")
