"""Queries over SBOMs, manifests, licenses, dependency names and vulnerabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import text as T
from ..operators import audit as A
from ..operators import graph as H
from ..operators import licenses as L
from ..operators import sbom as B
from ..operators import vendored as N
from ..operators import vulns as V
from ..sources import manifests as M
from ..sources import readers as D
from ..sources.shared import cut
from .registry import Registry

jobs = Registry()
lit = lambda x: R.literal(x, duck=True)
within = lambda items: "(" + ", ".join(map(lit, items)) + ")"
NAME = "regexp_extract(path, '[^/]*$')"

# --- readers ---
SPDX_ROWS = """SELECT package_id, sbom_id, 'spdx' AS format, 'SPDXRef-DocumentRoot-Directory-..-packages-app' AS spdxid, 'app' AS name, CASE WHEN k % 5 = 0 THEN '0123456789abcdef0123456789abcdef01' ELSE '3.1' END AS version, NULL AS ptype, 'MIT' AS license, NULL AS purl, true AS is_root FROM sboms WHERE k % 4 < 2
 UNION ALL SELECT package_id, sbom_id, 'spdx', 'SPDXRef-b', 'vendor/' || p_size, 'unknown', NULL, 'ISC', 'pkg:composer/v', false FROM sboms WHERE k % 4 < 2
 UNION ALL SELECT package_id, sbom_id, 'cyclonedx', NULL, p_name, '1.' || p_size, 'library', 'MIT OR ISC', 'pkg:npm/x', false FROM sboms WHERE k % 4 = 2 UNION ALL SELECT package_id, sbom_id, 'cyclonedx', NULL, './lib/plain', 'unknown', NULL, NULL, NULL, false FROM sboms WHERE k % 4 = 2"""
jobs.add("read_sbom", D.read_sbom, "sboms", sql=SPDX_ROWS)
MANIFEST_ROWS = {
    "parse_composer_lock": "SELECT package_id, path, 'a/b' AS name, v AS version FROM manifests WHERE k % 8 = 0 UNION ALL SELECT package_id, path, 'c/d', 'unknown' FROM manifests WHERE k % 8 = 0",
    "parse_package_json": "SELECT package_id, path, 'x' AS name, '^' || v AS version FROM manifests WHERE k % 8 = 1 UNION ALL SELECT package_id, path, 'y', '2' FROM manifests WHERE k % 8 = 1",
    "parse_package_lock": "SELECT package_id, path, CASE WHEN k % 3 = 0 THEN '@s/m' ELSE 'old' END AS name, v AS version FROM manifests WHERE k % 8 = 2 UNION ALL SELECT package_id, path, 'nov', 'unknown' FROM manifests WHERE k % 8 = 2 AND k % 3 <> 0",
    "parse_yarn_lock": "SELECT package_id, path, '@sc/pk' AS name, v AS version FROM manifests WHERE k % 8 = 3 UNION ALL SELECT package_id, path, 'left-pad', '1.3.0' FROM manifests WHERE k % 8 = 3",
    "parse_requirements": "SELECT package_id, path, 'flask' AS name, v AS version FROM manifests WHERE k % 8 = 4 UNION ALL SELECT package_id, path, 'requests', '' FROM manifests WHERE k % 8 = 4 AND false",
    "parse_pipfile_lock": "SELECT package_id, path, 'p' AS name, v AS version FROM manifests WHERE k % 8 = 5 UNION ALL SELECT package_id, path, 'q', '2' FROM manifests WHERE k % 8 = 5 UNION ALL SELECT package_id, path, 'r', 'unknown' FROM manifests WHERE k % 8 = 5",
    "parse_go_mod": "SELECT package_id, path, 'github.com/a/b' AS name, 'v' || v AS version FROM manifests WHERE k % 8 = 6 UNION ALL SELECT package_id, path, 'github.com/c/d', 'v2' FROM manifests WHERE k % 8 = 6",
}
for _name, _sql in MANIFEST_ROWS.items():
    _parse = getattr(M, _name)
    _file = next(f for f, p in M.PARSERS.items() if p is _parse)
    jobs.add(_name, lambda m, parse=_parse, file=_file: parse(m.filter(F.col("path").endswith("/" + file)).select("package_id", "path", "content")), "manifests", sql=_sql)
jobs.add("read_manifests", M.read_manifests, "manifests", sql=" UNION ALL ".join(f"({q})" for q in MANIFEST_ROWS.values()))
VULNS = "SELECT package_id, 'CVE-' || k AS vuln_id, 'High' AS severity, 2 AS n_cvss, CAST(p_size % 10 + 0.5 AS DOUBLE) AS score FROM vuln_reports WHERE k % 9 > 1 UNION ALL SELECT package_id, 'GHSA-x', 'Unknown', 0, CAST(0 AS DOUBLE) FROM vuln_reports WHERE k % 9 > 1"
jobs.add("read_vuln_report", lambda r: V.pick_cvss(D.read_vuln_report(r)).select("package_id", "vuln_id", "severity", F.size("cvss").alias("n_cvss"), "score"), "vuln_reports", sql=VULNS)
jobs.add("read_phpcs_report", D.read_phpcs_report, "lint_reports", sql="""SELECT package_id, 'a.php' AS file, p_size AS line, 1 AS col, 'ERROR' AS type, 'm' || p_size AS message, 'S.R' AS source, 5 AS severity, true AS fixable FROM lint_reports WHERE k % 9 > 1
 UNION ALL SELECT package_id, 'b.php', 2, NULL, 'WARNING', 'w', NULL, NULL, false FROM lint_reports WHERE k % 9 > 1 UNION ALL SELECT package_id, NULL, NULL, NULL, 'PARSE_ERROR', 'unreadable report', NULL, NULL, NULL FROM lint_reports WHERE k % 9 = 0""")
jobs.add("read_phpcs_totals", D.read_phpcs_totals, "lint_reports", sql="""SELECT package_id, k % 9 <> 0 AS success, CAST(CASE WHEN k % 9 < 2 THEN 0 WHEN k % 9 = 2 THEN 7 ELSE 1 END AS BIGINT) AS errors, CAST(CASE WHEN k % 9 < 2 THEN 0 WHEN k % 9 = 2 THEN 3 ELSE 1 END AS BIGINT) AS warnings, CAST(CASE WHEN k % 9 < 2 THEN 0 ELSE 1 END AS BIGINT) AS fixable, CAST(CASE WHEN k % 9 < 2 THEN 0 ELSE 2 END AS BIGINT) AS files FROM lint_reports""")
jobs.add("scanned_packages", D.scanned_packages, "vuln_reports", sql="SELECT DISTINCT package_id FROM vuln_reports WHERE k % 9 <> 0")
jobs.add("read_target_list", D.read_target_list, "target_lists", sql="SELECT unnest(['a' || k || '@x.example', 'b.example', 'c.example', 'd' || k || '.example', 'e.example']) AS target FROM target_lists")

# --- discovery ---
TYPES = R.values(list(R.MANIFEST_TYPES.items()), "base, t")
CAND = f""", cand AS (SELECT f.*, CASE WHEN regexp_matches(lower({NAME}), 'sbom|bom|spdx|cyclonedx|\\.cdx\\.json$') THEN 'sbom' WHEN t IS NOT NULL OR ends_with(path, '.podspec') THEN 'manifest' END AS candidate, coalesce(t, CASE WHEN ends_with(path, '.podspec') THEN 'cocoapods_podspec' END, 'unknown_manifest') AS manifest_type
 FROM files f LEFT JOIN (SELECT * FROM {TYPES}) x ON {NAME} = x.base WHERE length(path) - length(replace(path, '/', '')) < 8), c2 AS (SELECT * FROM cand WHERE candidate IS NOT NULL)"""
_prio = " ".join(f"WHEN ends_with(path, {lit(e)}) THEN {p}" for e, p in reversed(R.CANDIDATE_PRIORITY))
jobs.add("classify_manifest", lambda f: B.classify_manifest(f).select("package_id", "path", "manifest_type"), "files", sql=f"{CAND} SELECT package_id, path, manifest_type FROM cand")
jobs.add("find_sbom_candidates", lambda f: B.find_sbom_candidates(f).select("package_id", "path", "candidate", "manifest_type"), "files", sql=f"{CAND} SELECT package_id, path, candidate, manifest_type FROM c2")
RANKED = f", rk AS (SELECT package_id, path, length(path) - length(replace(path, '/', '')) AS depth, CASE {_prio} ELSE 50 END AS priority FROM (SELECT DISTINCT package_id, path FROM c2))"
jobs.add("rank_candidates", lambda f: B.rank_candidates(B.find_sbom_candidates(f).select("package_id", "path").distinct()).select("package_id", "path", "depth", "priority", "rank"), "files", sql=f"{CAND}{RANKED} SELECT package_id, path, CAST(depth AS INT) AS depth, priority, CAST(row_number() OVER (PARTITION BY package_id ORDER BY depth, priority, path) AS INT) AS rank FROM rk")
VALID = "SELECT package_id, sbom_id || '.json' AS path, k % 4 < 3 AS valid, CASE WHEN k % 4 = 2 THEN 'cyclonedx' WHEN k % 4 < 2 THEN 'spdx' END AS format, CASE WHEN k % 4 < 3 THEN 2 END AS components, CASE WHEN k % 8 = 3 THEN 'not JSON' WHEN k % 8 = 7 THEN 'neither SPDX nor CycloneDX' END AS reason FROM sboms"
_candidates = lambda s: s.select("package_id", F.concat("sbom_id", F.lit(".json")).alias("path"), "content")
jobs.add("validate_sboms", lambda s: B.validate_sboms(_candidates(s)), "sboms", sql=VALID)
jobs.add("discovery_status", lambda s, f: B.discovery_status(B.validate_sboms(_candidates(s)).select("package_id", F.lit("sbom").alias("candidate"), "valid").unionByName(B.find_sbom_candidates(f).filter("candidate = 'manifest'").select("package_id", "candidate", F.lit(None).cast("boolean").alias("valid")))), "sboms", "files", sql=f"""{CAND}, v AS ({VALID}), u AS (SELECT package_id, 'sbom' AS candidate, valid FROM v UNION ALL SELECT package_id, 'manifest', NULL FROM c2 WHERE candidate = 'manifest'),
 n AS (SELECT package_id, count(*) FILTER (candidate = 'sbom' AND valid) AS valid_sboms, count(*) FILTER (candidate = 'sbom' AND NOT valid) AS invalid_sboms, count(*) FILTER (candidate = 'manifest') AS manifests FROM u GROUP BY 1) SELECT *, CASE WHEN valid_sboms > 0 THEN 'sbom_found' WHEN invalid_sboms > 0 THEN 'sbom_invalid' WHEN manifests > 0 THEN 'manifests_only' ELSE 'nothing_found' END AS status FROM n""")
jobs.add("redact_sbom_paths", lambda s: B.redact_sbom_paths(s).select("package_id", *(F.get_json_object("document", p).alias(n) for n, p in {"name": "$.name", "pkg": "$.packages[0].SPDXID", "info": "$.packages[0].sourceInfo", "vendor": "$.packages[1].name", "sum": "$.packages[0].checksums[0].checksumValue", "rel": "$.relationships[0].spdxElementId", "ref": "$.metadata.component.bom-ref", "plain": "$.components[1].name", "loc": "$.components[0].evidence.occurrences[0].location", "hash": "$.components[0].hashes[0].value"}.items())), "sboms", sql="""SELECT package_id,
 CASE WHEN k % 4 < 2 THEN 'app' END AS name, CASE WHEN k % 4 < 2 THEN 'SPDXRef-DocumentRoot-Directory-app' END AS pkg, CASE WHEN k % 4 < 2 THEN 'acquired from [local cache] and [local cache] here' END AS info, CASE WHEN k % 4 < 2 THEN 'vendor/' || p_size END AS vendor, CASE WHEN k % 4 < 2 THEN '0a' END AS "sum", CASE WHEN k % 4 < 2 THEN 'SPDXRef-DocumentRoot-Directory-app' END AS rel,
 CASE WHEN k % 4 = 2 THEN 'scanner:root' END AS ref, CASE WHEN k % 4 = 2 THEN 'plain' END AS plain, CASE WHEN k % 4 = 2 THEN 'b.js' END AS loc, CASE WHEN k % 4 = 2 THEN 'ab' END AS hash FROM sboms""")
jobs.add("resolve_root_version", B.resolve_root_version, "sboms", sql="SELECT package_id, CASE WHEN k % 4 < 2 AND k % 5 <> 0 THEN '3.1' WHEN k % 4 = 2 AND k % 3 <> 0 THEN '2.0' END AS version FROM sboms")

# --- comparison ---
DIFF = """, a AS (SELECT package_id, name, min(version) AS va, bool_or(is_root) AS ra, min(purl) AS pa FROM components GROUP BY ALL), b AS (SELECT package_id, name, min(version) AS vb, bool_or(is_root) AS rb, min(purl) AS pb FROM baseline GROUP BY ALL),
 diff AS (SELECT package_id, name, va AS version_a, vb AS version_b, CASE WHEN vb IS NULL THEN 'only_a' WHEN va IS NULL THEN 'only_b' WHEN va = vb THEN 'same' ELSE 'changed' END AS change, coalesce(ra, false) OR coalesce(rb, false) AS is_root, coalesce(pa, pb) AS purl FROM a FULL JOIN b USING (package_id, name)),
 lab AS (SELECT *, CASE change WHEN 'only_a' THEN 'added' WHEN 'only_b' THEN 'removed' ELSE 'changed' END AS label FROM diff WHERE NOT is_root AND change <> 'same')"""
jobs.add("diff_packages", B.diff_packages, "components", "baseline", sql=f"{DIFF} SELECT * FROM diff")
jobs.add("sbom_added", B.sbom_added, "components", "baseline", sql="SELECT package_id, name FROM components EXCEPT SELECT package_id, name FROM baseline")
jobs.add("sbom_removed", B.sbom_removed, "components", "baseline", sql="SELECT package_id, name FROM baseline EXCEPT SELECT package_id, name FROM components")
jobs.add("sbom_common", B.sbom_common, "components", "baseline", sql="SELECT package_id, name FROM components INTERSECT SELECT package_id, name FROM baseline")
jobs.add("label_diff", lambda a, b: B.label_diff(B.diff_packages(a, b), "manifest", True).select("package_id", "name", "label", "note"), "components", "baseline", sql=f"{DIFF} SELECT package_id, name, CASE change WHEN 'only_a' THEN 'sbom_only' WHEN 'only_b' THEN 'manifest_only' ELSE 'changed' END AS label, CASE WHEN change = 'only_a' AND starts_with(purl, 'pkg:wordpress/') THEN 'platform package, not expected in a manifest' END AS note FROM diff WHERE change <> 'same'")
jobs.add("diff_summary", lambda a, b, w: B.diff_summary(B.label_diff(B.diff_packages(a, b)), w), "components", "baseline", "scanned", sql=f"{DIFF} SELECT package_id, count(*) FILTER (label = 'added') AS added, count(*) FILTER (label = 'removed') AS removed, count(*) FILTER (label = 'changed') AS changed, CAST(0 AS BIGINT) AS sbom_only, CAST(0 AS BIGINT) AS manifest_only, count(label) AS total FROM (SELECT package_id, label FROM lab UNION ALL SELECT package_id, NULL FROM scanned) GROUP BY 1")

jobs.add("read_relationships", H.read_relationships, "sboms", sql="SELECT package_id, sbom_id, 'SPDXRef-DocumentRoot-Directory-..-packages-app' AS source, 'SPDXRef-b' AS target FROM sboms WHERE k % 4 < 2")
jobs.add("component_depths", H.component_depths, "nodes", "links", sql="""
 , walk(package_id, spdxid, depth) AS (SELECT DISTINCT package_id, spdxid, 0 FROM nodes WHERE is_root UNION SELECT l.package_id, l.target, depth + 1 FROM walk w JOIN links l ON l.package_id = w.package_id AND l.source = w.spdxid WHERE depth < 60), far AS (SELECT package_id, spdxid, min(depth) AS depth FROM walk GROUP BY ALL)
 SELECT n.package_id, n.sbom_id, n.spdxid, depth, CASE WHEN depth IS NULL THEN 'unreachable' WHEN depth = 0 THEN 'root' WHEN depth = 1 THEN 'direct' ELSE 'transitive' END AS reach FROM (SELECT DISTINCT package_id, sbom_id, spdxid FROM nodes) n LEFT JOIN far USING (package_id, spdxid)""")
jobs.sql["component_depths"] = jobs.sql["component_depths"].replace("WITH ", "WITH RECURSIVE ", 1)
_three = lambda c, b: {"built": c, "declared": b, "deployed": c.filter("length(name) % 3 > 0").unionByName(b.filter("length(name) % 3 = 0").select(*c.columns))}
jobs.add("reconcile_sboms", lambda c, b: H.reconcile_sboms(**_three(c, b)), "components", "baseline", sql=""", src AS (SELECT 1 AS bit, package_id, name, version FROM components UNION SELECT 2, package_id, name, version FROM baseline UNION SELECT 4, package_id, name, version FROM components WHERE length(name) % 3 > 0 UNION SELECT 4, package_id, name, version FROM baseline WHERE length(name) % 3 = 0),
 e AS (SELECT package_id, name, version, CAST(sum(bit) AS BIGINT) AS sources, CAST(count(*) AS INT) AS held FROM src GROUP BY ALL), k AS (SELECT package_id, count(DISTINCT bit) AS known FROM src GROUP BY 1) SELECT package_id, name, version, sources, held, count(*) OVER (PARTITION BY package_id, name) AS versions, CASE WHEN held = known THEN 'agreed' WHEN 2 * held > known THEN 'majority' WHEN 2 * held = known THEN 'tied' ELSE 'minority' END AS verdict FROM e JOIN k USING (package_id)""")


def _vendored(libraries, packages):
    """What each package holds and what it declares: one of its two libraries, and one that it hasn't."""
    found, known = N.find_vendored(libraries, packages)
    found = cut(found, "vendored")
    declared = packages.filter("k % 2 = 0").select("package_id", "name").unionByName(packages.filter("k % 2 = 0").select("package_id", F.concat(F.lit("lib"), F.col("k") + 7).alias("name")))
    return N.declared_and_found(found, declared, known).join(found, ["package_id", "library"], "left")


jobs.add("vendored_libraries", _vendored, "libraries", "vendoring")

# --- licenses ---
_norm = "CASE " + " ".join(f"WHEN regexp_matches(license, {lit(p)}) THEN {lit(i)}" for p, i in R.LICENSE_SPELLINGS) + " ELSE license END"
jobs.add("normalise_license", lambda c: c.select("license").distinct().select("license", T.normalise_license(F.col("license")).alias("spdx")), "components", sql=f"SELECT DISTINCT license, {_norm} AS spdx FROM components")
LT = R.values(R.pairs(R.LICENSES), "id, c")
#: Terms are judged by set: any permissive, the last weak, then the first strong or unknown; for AND the worst present.
LICENSED = f""", lt AS (SELECT * FROM {LT}), lic AS (SELECT DISTINCT license, {_norm} AS spdx FROM components), single AS (SELECT license, spdx, coalesce(c, CASE WHEN regexp_matches(spdx, {lit(R.PROPRIETARY)}) THEN 'proprietary' END) AS known FROM lic LEFT JOIN lt ON spdx = id),
 terms AS (SELECT license, unnest(ts) AS license_term, generate_subscripts(ts, 1) AS pos FROM (SELECT license, list_filter(string_split(spdx, ' '), lambda x: x <> '' AND NOT regexp_matches(x, '^(AND|OR|WITH|\\()')) AS ts FROM lic)),
 tcat AS (SELECT t.license, pos, coalesce(c, CASE WHEN regexp_matches(s, {lit(R.PROPRIETARY)}) THEN 'proprietary' END, 'unknown') AS c FROM (SELECT license, pos, {_norm.replace('license', 'license_term')} AS s FROM terms) t LEFT JOIN lt ON s = id),
 fold AS (SELECT license, bool_or(c = 'permissive') AS perm, bool_or(c = 'weak_copyleft') AS weak, bool_or(c = 'strong_copyleft') AS strong, bool_or(c = 'unknown') AS unk, arg_min(c, pos) FILTER (c IN ('strong_copyleft', 'unknown')) AS firstsu, arg_min(c, pos) FILTER (c IN ('proprietary', 'gpl_incompatible')) AS bad FROM tcat GROUP BY 1),
 full_c AS (SELECT s.license, CASE WHEN s.license IS NULL OR s.license IN ('', 'NOASSERTION', 'NONE') THEN 'unknown' WHEN known IS NOT NULL THEN known WHEN regexp_matches(spdx, '\\bOR\\b') THEN CASE WHEN perm THEN 'permissive' WHEN weak THEN 'weak_copyleft' ELSE coalesce(firstsu, 'gpl_incompatible') END || ':dual'
 WHEN regexp_matches(spdx, '\\b(AND|WITH)\\b') THEN CASE WHEN bad IS NOT NULL THEN bad WHEN strong THEN 'strong_copyleft' WHEN weak THEN 'weak_copyleft' WHEN unk THEN 'unknown' ELSE 'permissive' END ELSE 'unknown' END AS f FROM single s LEFT JOIN fold USING (license)),
 comp AS (SELECT c.*, split_part(f, ':', 1) AS category, ends_with(f, ':dual') AS dual FROM components c JOIN full_c ON c.license IS NOT DISTINCT FROM full_c.license)"""
POLICY = R.values(R.LICENSE_POLICY, "category, severity, reason, risk")
jobs.add("extract_licenses", lambda s: D.read_sbom(s).select("package_id", "name", "license"), "sboms", sql=f"SELECT package_id, name, license FROM ({SPDX_ROWS})")
jobs.add("classify_license", lambda c: L.classify_license(c).select("license", "category", "dual").distinct(), "components", sql=f"{LICENSED} SELECT DISTINCT license, category, dual FROM comp")
jobs.add("license_policy", lambda c: L.license_policy(c).select("package_id", "sbom_id", "name", "version", "category", "severity", "reason", "risk"), "components", sql=f"{LICENSED} SELECT package_id, sbom_id, name, version, category, severity, reason, risk FROM comp JOIN (SELECT * FROM {POLICY}) USING (category)")
_ecosystems = lambda c: c.select("package_id").distinct().withColumn("ecosystem", F.when(F.length("package_id") == 4, "wordpress").otherwise("npm"))
ROOTS = """, own AS (SELECT package_id, arg_min(coalesce(license, chr(0)), (NOT is_root, name, version, coalesce(license, chr(0)))) AS o FROM components GROUP BY 1), roots AS (SELECT package_id, CASE WHEN o IN ('', 'NOASSERTION', 'NONE', chr(0)) THEN CASE WHEN length(package_id) = 4 THEN 'GPL-2.0-or-later' END ELSE o END AS root_license, CASE WHEN o NOT IN ('', 'NOASSERTION', 'NONE', chr(0)) THEN 'sbom' WHEN length(package_id) = 4 THEN 'ecosystem_default' ELSE 'none' END AS source FROM own)"""
_firm = lambda c: c.groupBy("package_id", "name", "version", "is_root").agg(F.min("license").alias("license"))
FIRM = ", components AS (SELECT package_id, name, version, is_root, min(license) AS license FROM components0 GROUP BY ALL)"
jobs.add("root_license", lambda c: L.root_license(_firm(c), _ecosystems(c)), "components", sql=f"{FIRM}{ROOTS} SELECT * FROM roots")
jobs.sql["root_license"] = jobs.sql["root_license"].replace("WITH components AS", "WITH components0 AS")
COMPAT = f"""{LICENSED}{ROOTS.replace('FROM components GROUP BY 1', 'FROM (SELECT package_id, name, version, is_root, min(license) AS license FROM components GROUP BY ALL) GROUP BY 1')}, rcat AS (SELECT package_id, f AS root_category FROM roots JOIN (SELECT license, f FROM full_c UNION ALL SELECT 'GPL-2.0-or-later', 'strong_copyleft' UNION ALL SELECT NULL, 'unknown' WHERE NOT EXISTS (SELECT 1 FROM full_c WHERE license IS NULL)) z ON root_license IS NOT DISTINCT FROM license),
 clash AS (SELECT package_id, name, version, license, CASE WHEN category = 'gpl_incompatible' THEN 'dep_gpl_incompatible' WHEN root_category = 'strong_copyleft' AND category = 'proprietary' THEN 'dep_incompatible_with_gpl_root' WHEN root_category = 'strong_copyleft' AND category = 'unknown' THEN 'dep_unknown_with_gpl_root' WHEN root_category = 'proprietary' AND category = 'strong_copyleft' THEN 'root_incompatible_with_copyleft_dep' END AS issue FROM comp JOIN rcat USING (package_id))"""
jobs.add("license_compat", lambda c: L.license_compat(c, L.root_license(_firm(c), _ecosystems(c))), "components", sql=f"{COMPAT} SELECT *, CASE WHEN issue = 'dep_unknown_with_gpl_root' THEN 'WARNING' ELSE 'CRITICAL' END AS severity FROM clash WHERE issue IS NOT NULL")
LSUM = ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c, *_ in R.LICENSE_POLICY)
LICENSE_SUMMARY = f"SELECT package_id, {LSUM}, CAST(sum(risk) AS BIGINT) AS risk_score, count(*) FILTER (category IN ('gpl_incompatible', 'proprietary')) = 0 AS gpl_compatible, CASE WHEN count(*) FILTER (category IN ('gpl_incompatible', 'proprietary')) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM comp JOIN (SELECT * FROM {POLICY}) USING (category) GROUP BY 1"
jobs.add("license_summary", L.license_summary, "components", sql=f"{LICENSED} {LICENSE_SUMMARY}")

# --- audit ---
BARE = "replace(replace(regexp_replace(lower(name), '^.*/', ''), '-', ''), '_', '')"
POP = R.values([(p, p) for p in R.POPULAR], "k, shown")
COMP = R.values([(x.split("/")[0] + "/" + x.split("/")[1].replace("-", ""), x) for x in R.POPULAR_COMPOSER], "k, shown")
SQUAT = f""", nm AS (SELECT DISTINCT name, {BARE} AS s3, CASE WHEN regexp_matches(lower(name), '^[^@/]+/[^/]+$') THEN replace(replace(split_part(lower(name), '/', 1), '-', ''), '_', '') END AS s2, CASE WHEN regexp_matches(lower(name), '^[^@/]+/[^/]+$') THEN split_part(lower(name), '/', 1) || '/' || {BARE} END AS s1 FROM components),
 near AS (SELECT name, 1 AS o, 'full' AS stage, levenshtein(s1, k) AS d, shown FROM nm, (SELECT * FROM {COMP}) WHERE s1 IS NOT NULL UNION ALL SELECT name, 2, 'vendor', levenshtein(s2, k), shown FROM nm, (SELECT * FROM {POP}) WHERE s2 IS NOT NULL UNION ALL SELECT name, 3, 'package', levenshtein(s3, k), shown FROM nm, (SELECT * FROM {POP})),
 hit AS (SELECT name, unnest(arg_min({{stage: stage, d: d, shown: shown}}, (o, d, shown))) FROM near WHERE d <= 2 GROUP BY 1), squat AS (SELECT package_id, name, version, shown AS target, CAST(d AS INT) AS distance, stage FROM components JOIN hit USING (name) WHERE d >= 1)"""
CONF = f", conf AS (SELECT package_id, name, version, CASE WHEN regexp_matches(lower(name), {lit(R.INTERNAL_SCOPE)}) THEN 'internal_scope' ELSE 'internal_name_pattern' END AS reason, 'CRITICAL' AS severity FROM components WHERE regexp_matches(lower(name), {lit(R.INTERNAL_SCOPE)}) OR regexp_matches(lower(name), {lit(R.INTERNAL_NAME)}))"
SUSP = f", susp AS (SELECT * FROM (SELECT package_id, name, version, CASE WHEN regexp_matches(version, {lit(R.SUSPICIOUS_VERSION)}) THEN 'suspicious_version' WHEN regexp_matches(lower(name), {lit(R.TEST_NAME)}) THEN 'test_name_pattern' WHEN length({BARE}) BETWEEN 1 AND 2 THEN 'very_short_name' WHEN regexp_full_match(name, '[0-9]+') THEN 'numeric_name' END AS reason, 'MEDIUM' AS severity FROM components) WHERE reason IS NOT NULL)"
AUDIT = f"{SQUAT}{CONF}{SUSP}, found AS (SELECT package_id, 'typosquat' AS kind FROM squat UNION ALL SELECT package_id, 'dependency_confusion' FROM conf UNION ALL SELECT package_id, 'suspicious' FROM susp)"
AUDIT_SUM = "SELECT package_id, count(*) FILTER (kind = 'dependency_confusion') AS dependency_confusion, count(*) FILTER (kind = 'typosquat') AS typosquat, count(*) FILTER (kind = 'suspicious') AS suspicious, CAST(sum(CASE kind WHEN 'dependency_confusion' THEN 500 WHEN 'typosquat' THEN 400 ELSE 100 END) AS BIGINT) AS risk_score FROM found GROUP BY 1"
jobs.add("normalise_name", lambda c: c.select("name").distinct().select("name", T.normalise_name(F.col("name")).alias("bare")), "components", sql=f"SELECT DISTINCT name, {BARE} AS bare FROM components")
jobs.add("typosquat", A.typosquat, "components", sql=f"{SQUAT} SELECT * FROM squat")
REGISTRY = f", reg AS (SELECT list, k, min(name) AS shown FROM (SELECT 'flat' AS list, {BARE} AS k, name FROM registry UNION ALL SELECT 'composer', split_part(lower(name), '/', 1) || '/' || {BARE}, name FROM registry WHERE regexp_matches(lower(name), '^[^@/]+/[^/]+$')) GROUP BY ALL)"
jobs.add("typosquat_registry", A.typosquat, "imports", "registry", sql=REGISTRY + SQUAT.replace("components", "imports").replace(f"(SELECT * FROM {COMP})", "(SELECT k, shown FROM reg WHERE list = 'composer')").replace(f"(SELECT * FROM {POP})", "(SELECT k, shown FROM reg WHERE list = 'flat')") + " SELECT * FROM squat")
jobs.add("dependency_confusion", A.dependency_confusion, "components", sql=f"{CONF} SELECT * FROM conf")
jobs.add("suspicious_names", A.suspicious_names, "components", sql=f"{SUSP} SELECT * FROM susp")
jobs.add("audit_summary", lambda c, w: A.audit_summary(A.audit_findings(c), w), "components", "scanned", sql=f"{AUDIT} {AUDIT_SUM.replace('FROM found', 'FROM (FROM found UNION ALL SELECT package_id, NULL FROM scanned)').replace('ELSE 100', 'WHEN ' + chr(39) + 'suspicious' + chr(39) + ' THEN 100 ELSE 0')}")

# --- vulnerabilities ---


def scored_matches(matches):
    """The derived columns as the array that a report has."""
    cvss = F.filter(F.array(*(F.struct(F.lit(v).alias("version"), F.col(c).cast("double").alias("score")) for v, c in (("2.0", "v2"), ("3.0", "v30"), ("3.1", "v31")))), lambda x: x["score"].isNotNull())
    return matches.select("package_id", "vuln_id", "severity", cvss.alias("cvss"))


WEIGHT = "CASE severity WHEN 'Critical' THEN 100.0 WHEN 'High' THEN 25.0 WHEN 'Medium' THEN 5.0 WHEN 'Low' THEN 1.0 WHEN 'Negligible' THEN 0.1 ELSE 0.0 END"
SCORED = f", sc AS (SELECT package_id, vuln_id, severity, CAST(coalesce(v31, v30, v2, 0.0) AS DOUBLE) AS score FROM matches), vr AS (SELECT package_id, CAST(round(sum(CAST(score AS DECIMAL(10,3)) * CAST({WEIGHT} AS DECIMAL(5,1))), 2) AS DOUBLE) AS weighted_risk FROM sc GROUP BY 1), vrisk AS (SELECT *, CASE WHEN weighted_risk >= 1000 THEN 'CRITICAL' WHEN weighted_risk >= 500 THEN 'HIGH' WHEN weighted_risk >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM vr)"
jobs.add("pick_cvss", lambda m: V.pick_cvss(scored_matches(m)).select("package_id", "vuln_id", "severity", "score"), "matches", sql=f"{SCORED} SELECT * FROM sc")
jobs.add("vuln_counts", lambda m, w: V.vuln_counts(scored_matches(m), w), "matches", "scanned", sql=f"{SCORED} SELECT package_id, {', '.join(f'count(*) FILTER (severity = {lit(s)}) AS {s.lower()}' for s in R.SEVERITY_WEIGHTS)}, count(*) FILTER (severity = 'Unknown') AS unknown, count(severity) AS total, count(*) FILTER (severity <> 'Unknown' AND score = 0) AS unscored FROM (SELECT package_id, severity, score FROM sc UNION ALL SELECT package_id, NULL, NULL FROM scanned) GROUP BY 1")
jobs.add("vuln_risk", lambda m, w: V.vuln_risk(scored_matches(m), w), "matches", "scanned", sql=f"{SCORED} SELECT * FROM vrisk UNION ALL SELECT package_id, 0.0::DOUBLE, 'LOW' FROM scanned WHERE package_id NOT IN (SELECT package_id FROM sc)")
jobs.add("scrub_vuln_report", lambda m: V.scrub_vuln_report(m.select("package_id", "vuln_id", F.struct(F.when(F.col("v2").isNotNull(), F.concat(F.lit("/root/.cache/db/"), "vuln_id")).otherwise(F.concat(F.lit("/app/"), "vuln_id")).alias("path"), F.lit("/real").alias("realPath"), F.lit("x").alias("matchDetails")).alias("details"))).select("package_id", "vuln_id", F.to_json("details").alias("details")), "matches", sql="""SELECT package_id, vuln_id, CASE WHEN v2 IS NOT NULL THEN '{"path":"(local cache)"}' ELSE '{"path":"/app/' || vuln_id || '"}' END AS details FROM matches""")
_fields = lambda d, *paths: d.select("package_id", *(F.get_json_object("document", f"$.{p}").alias(n) for n, p in paths))
jobs.add("merge_sbom_vulns", lambda s, m, w: _fields(V.merge_sbom_vulns(s.select("package_id", "content"), scored_matches(m), w), ("level", "risk_assessment.level"), ("first_match", "vulnerability_scan.matches[0].vuln_id"), ("listed", "vulnerability_scan.matches"), ("sbom", "sbom"), ("critical", "risk_assessment.vuln_counts.critical"), ("high_cvss", "risk_assessment.cvss_totals.high")).withColumns({"listed": F.col("listed").isNotNull(), "has_sbom": F.col("sbom").isNotNull(), "high_cvss": F.col("high_cvss").cast("double")}).drop("sbom"), "sboms", "matches", "scanned", sql=f"""{SCORED}, f AS (SELECT package_id, min(vuln_id) AS first_match, CAST(count(*) FILTER (severity = 'Critical') AS VARCHAR) AS critical, CAST(coalesce(sum(CAST(score AS DECIMAL(10,3))) FILTER (severity = 'High'), 0) AS DOUBLE) AS high_cvss FROM sc GROUP BY 1),
 g AS (SELECT package_id, first_match, coalesce(critical, '0') AS critical, coalesce(high_cvss, 0) AS high_cvss FROM f FULL JOIN scanned USING (package_id)), h AS (SELECT g.*, coalesce(level, 'LOW') AS level FROM g LEFT JOIN vrisk USING (package_id))
 SELECT coalesce(s.package_id, h.package_id) AS package_id, level, first_match, level IS NOT NULL AS listed, critical, high_cvss, s.package_id IS NOT NULL AS has_sbom FROM sboms s FULL JOIN h ON s.package_id = h.package_id""")
jobs.add("risk_delta", lambda m: B.risk_delta(V.vuln_risk(scored_matches(m)).select("package_id", F.col("weighted_risk").alias("risk")), V.vuln_risk(scored_matches(m).filter("severity <> 'Low'")).filter("weighted_risk > 200").select("package_id", F.col("weighted_risk").alias("risk"))), "matches", sql=f"""{SCORED}, b AS (SELECT package_id, CAST(round(sum(CAST(score AS DECIMAL(10,3)) * CAST({WEIGHT} AS DECIMAL(5,1))), 2) AS DOUBLE) AS risk_b FROM sc WHERE severity <> 'Low' GROUP BY 1 HAVING risk_b > 200)
 SELECT package_id, weighted_risk AS risk_a, risk_b, round(weighted_risk - risk_b, 2) AS delta, CASE WHEN risk_b IS NULL THEN NULL WHEN round(weighted_risk - risk_b, 2) > 0 THEN 'increased' WHEN round(weighted_risk - risk_b, 2) < 0 THEN 'decreased' ELSE 'unchanged' END AS direction FROM vr FULL JOIN b USING (package_id)""")
