"""Queries over file trees: statistics, content scan, permissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import text as T
from ..operators import content as C
from ..operators import files as O
from ..operators import permissions as P
from ..operators import verdicts as W
from ..sources.readers import read_package_files
from ..sources.shared import new_path
from ..sources.trees import open_uri
from .registry import Registry

jobs = Registry()
lit = lambda x: R.literal(x, duck=True)
within = lambda items: "(" + ", ".join(map(lit, items)) + ")"

# The check SQL writes every rule again, in DuckDB's terms.
NAME = "regexp_extract(path, '[^/]*$')"
EXT = f"CASE WHEN regexp_matches({NAME}, '^.+\\.[^.]*$') THEN lower(regexp_extract({NAME}, '\\.([^.]*)$', 1)) END"
CATEGORIES = R.values(R.pairs(R.CATEGORY_EXTENSIONS), "ext, c")
BARE = R.values(R.pairs(R.KNOWN_NAMES), "bare, c")
CATEGORISED = f""", cat AS (SELECT f.*, coalesce(e.c, n.c, 'other') AS category, {NAME} AS name, CASE WHEN coalesce(e.c, n.c, 'other') IN {within(R.TEXT_CATEGORIES)} AND size > 0 THEN length(content) - length(replace(content, chr(10), '')) ELSE 0 END AS lines
 FROM (SELECT *, {EXT} AS ext FROM files) f LEFT JOIN (SELECT * FROM {CATEGORIES}) e ON f.ext = e.ext LEFT JOIN (SELECT * FROM {BARE}) n ON f.ext IS NULL AND lower({NAME}) = n.bare)"""



def _tree(files):
    """The files, written by tasks as a tree of <package>/<path> below a new folder of the shared one, and read by the reader."""
    root = new_path(files.sparkSession, "tree")

    def write(batches):
        for batch in batches:
            for package, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = open_uri(f"{root}/{package}/{path}")
                store.create_dir(at.rsplit("/", 1)[0])
                with store.open_output_stream(at, compression=None) as out:
                    out.write(content.encode())
            yield batch.select([0]).slice(0, 1)

    files.groupBy("package_id", "path").agg(F.min("content").alias("content")).mapInArrow(write, "package_id string").count()
    return read_package_files(files.sparkSession, root).select("package_id", "path", "size", F.sha2("content", 256).alias("sha256"))


jobs.add("read_package_files", _tree, "files", sql=r"SELECT package_id, path, CAST(strlen(min(content)) AS BIGINT) AS size, sha256(min(content)) AS sha256 FROM files WHERE NOT regexp_matches(path, '(^|/)(\.git|\.svn|\.hg|node_modules|vendor|venv|\.venv|__pycache__)/') GROUP BY package_id, path")
jobs.add("drop_excluded", lambda f: O.drop_excluded(f).select("package_id", "path", "size"), "files", sql=r"SELECT package_id, path, size FROM files WHERE NOT regexp_matches(path, '(^|/)(\.git|\.svn|\.hg|node_modules|vendor|venv|\.venv|__pycache__)/')")
jobs.add("with_extension", lambda f: O.with_extension(f).select("package_id", "path", "ext"), "files", sql=f"SELECT package_id, path, {EXT} AS ext FROM files")
jobs.add("format_bytes", lambda f: f.select("package_id", "path", T.format_bytes(F.col("size") * F.col("size")).alias("shown")), "files", sql="""SELECT package_id, path, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN ((b + 512) // 1024) || ' KB' WHEN b < 1073741824 THEN ((b*10 + 524288) // 1048576 // 10) || '.' || ((b*10 + 524288) // 1048576 % 10) || ' MB'
 ELSE ((b*10 + 536870912) // 1073741824 // 10) || '.' || ((b*10 + 536870912) // 1073741824 % 10) || ' GB' END AS shown FROM (SELECT *, size * size AS b FROM files)""")
_clean = NAME
for _s in R.NAME_SUFFIXES:
    _clean = f"regexp_replace({_clean}, '{_s.replace('.', chr(92) + '.')}$', '')"
jobs.add("clean_name", lambda f: f.select("package_id", "path", T.clean_name(F.col("path")).alias("clean")), "files", sql=f"SELECT package_id, path, regexp_replace({_clean}, '[^a-zA-Z0-9._-]', '_', 'g') AS clean FROM files")
jobs.add("categorise_files", lambda f: O.categorise_files(f).select("package_id", "path", "ext", "category"), "files", sql=f"{CATEGORISED} SELECT package_id, path, ext, category FROM cat")
jobs.add("file_totals", O.file_totals, "files", sql=f"""{CATEGORISED} SELECT package_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (size = 0) AS empty, count(*) FILTER (starts_with(name, '.')) AS hidden, count(*) FILTER (contains(name, '.min.')) AS minified,
 CAST(coalesce(sum(size) FILTER (contains(name, '.min.')), 0) AS BIGINT) AS minified_bytes, CAST(sum(lines) AS BIGINT) AS lines FROM cat GROUP BY 1""")
jobs.add("count_hidden_dirs", O.count_hidden_dirs, "entries", sql=f"SELECT package_id, count(*) FILTER (kind = 'dir' AND starts_with({NAME}, '.') AND NOT regexp_matches(path, '(^|/)\\.(git|svn|hg)/')) AS hidden_dirs FROM entries GROUP BY 1")
jobs.add("category_stats", O.category_stats, "files", sql=f"{CATEGORISED} SELECT package_id, category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(lines) AS BIGINT) AS lines FROM cat GROUP BY ALL")
jobs.add("extension_stats", O.extension_stats, "files", sql=f"{CATEGORISED} SELECT package_id, category, coalesce(ext, '_noext') AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(lines) AS BIGINT) AS lines, CASE WHEN ext IS NULL THEN '(no extension)' ELSE '.' || ext END AS display FROM cat GROUP BY ALL")
_places = " ".join(f"WHEN {lit(c)} THEN {n}" for n, c in enumerate(R.CATEGORY_ORDER, 1))
jobs.add("category_order", lambda f: O.category_order(O.category_stats(f)).select("package_id", "category", "files", "place"), "files", sql=f"{CATEGORISED} SELECT package_id, category, count(*) AS files, CASE category {_places} END AS place FROM cat GROUP BY ALL")
_rules = R.values([(k, w, n, p.replace("*", "%").replace("_", "\\_")) for k, w, ps in R.BEST_PRACTICES for n, p in enumerate(ps.split())], "key, place, n, pattern")
BEST = f""", rules AS (SELECT * FROM {_rules}), met AS (SELECT package_id, key, n, path FROM files JOIN rules ON lower({NAME}) LIKE pattern ESCAPE '\\' WHERE (place = 'root' AND NOT contains(path, '/')) OR (place = 'deep' AND length(path) - length(replace(path, '/', '')) <= 1 AND NOT regexp_matches(path, '^(vendor|node_modules)/'))),
 best AS (SELECT package_id, key, arg_min(path, (n, path)) AS found FROM met GROUP BY ALL), wanted AS (SELECT DISTINCT package_id, key FROM files, rules), bp AS (SELECT w.*, found FROM wanted w LEFT JOIN best USING (package_id, key))"""
jobs.add("best_practice_files", O.best_practice_files, "files", sql=f"{BEST} SELECT package_id, key, found FROM bp")
jobs.add("best_practice_counts", lambda f: O.best_practice_counts(O.best_practice_files(f)), "files", sql=f"{BEST} SELECT package_id, count(found) AS found, count(*) FILTER (found IS NULL) AS missing FROM bp GROUP BY 1")
jobs.add("unwrap_single_root", lambda e: O.unwrap_single_root(e.withColumn("path", F.when(F.expr("length(package_id) = 4"), F.concat(F.lit("top/"), F.col("path"))).otherwise(F.col("path")))).select("package_id", "path", "kind", "root"), "entries", sql="""
 , e AS (SELECT * REPLACE (CASE WHEN length(package_id) = 4 THEN 'top/' || path ELSE path END AS path) FROM entries), s AS (SELECT package_id, count(DISTINCT split_part(path, '/', 1)) = 1 AND count(*) FILTER (NOT contains(path, '/') AND kind <> 'dir') = 0 AND count(*) FILTER (contains(path, '/')) > 0 AS single FROM e GROUP BY 1)
 SELECT package_id, CASE WHEN single THEN substr(path, instr(path, '/') + 1) ELSE path END AS path, kind, CASE WHEN single THEN split_part(path, '/', 1) ELSE '' END AS root FROM e JOIN s USING (package_id) WHERE NOT (single AND NOT contains(path, '/'))""")

# --- content scan ---
SCANNABLE = f"size > 0 AND size <= {R.SCAN_LIMIT} AND coalesce({EXT}, '') NOT IN {within(R.SKIPPED_EXTENSIONS)}"
COMBINED = lit("(?i)(" + "|".join(f"(?:{p})" for p in R.PATTERNS) + ")")
PATTERN_ROWS = R.values([(n, "(?i)" + p, *next((t, s) for t, s, a, b in R.PATTERN_TYPES if a <= n <= b)) for n, p in enumerate(R.PATTERNS, 1)], "pattern_id, pattern, type, severity")
HITS = f""", scan AS (SELECT * FROM files WHERE {SCANNABLE}), suspicious AS (SELECT package_id, path, string_split(content, chr(10)) AS ls FROM scan WHERE regexp_matches(content, {COMBINED})),
 ln AS (SELECT package_id, path, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM suspicious), hits AS (SELECT package_id, path, CAST(line AS INT) AS line, pattern_id, type, severity, text FROM (SELECT * FROM ln WHERE regexp_matches(text, {COMBINED})) l JOIN {PATTERN_ROWS} ON regexp_matches(text, pattern)),
 firsts AS (SELECT package_id, path, type, unnest(arg_min({{pattern_id: pattern_id, line: line, severity: severity, text: text}}, (pattern_id, line, severity, text))) FROM hits GROUP BY package_id, path, type)"""
STRICT = R.values([(e, p) for es, p in R.STRICT_TYPES.items() for e in es.split()], "ext, expected")
MISMATCH = f""", strict AS (SELECT * FROM {STRICT}), typed AS (SELECT f.*, expected FROM (SELECT *, {EXT} AS ext FROM files) f LEFT JOIN strict s ON f.ext = s.ext WHERE f.ext IS NOT NULL),
 mism AS (SELECT package_id, path, ext, mime, CASE WHEN regexp_matches(mime, {lit(R.EXECUTABLE_TYPE)}) THEN 'CRITICAL' WHEN starts_with(expected, 'image/') AND starts_with(mime, 'image/') THEN 'LOW' ELSE 'HIGH' END AS severity,
 CASE WHEN expected IS NOT NULL THEN 'expected ' || replace(expected, '\\', '') || ', got ' || mime ELSE 'text extension has binary MIME: ' || mime END AS detail FROM typed WHERE CASE WHEN expected IS NOT NULL THEN NOT regexp_full_match(mime, expected) AND NOT (mime = 'application/octet-stream' AND ext NOT IN {within(R.UNFORGIVEN_EXTENSIONS)}) ELSE ext IN {within(R.TEXT_EXTENSIONS)} AND regexp_matches(mime, {lit(R.BINARY_TYPE)}) END)"""
LOWNAME = f"lower({NAME})"
DECEPTIVE = f""", decep AS (SELECT package_id, path, regexp_extract({LOWNAME}, '([^.]*)\\.[^.]*$', 1) AS shown, regexp_extract({LOWNAME}, '\\.([^.]*)$', 1) AS ext, 'CRITICAL' AS severity FROM files WHERE length({NAME}) - length(replace({NAME}, '.', '')) >= 2 AND NOT regexp_matches({LOWNAME}, '\\.({"|".join(p.replace(".", chr(92) + ".") for p in R.SAFE_PAIRS)})$')
 AND regexp_extract({LOWNAME}, '\\.([^.]*)$', 1) IN {within(R.EXECUTABLE_EXTENSIONS)} AND regexp_extract({LOWNAME}, '([^.]*)\\.[^.]*$', 1) IN {within(R.DATA_LIKE_EXTENSIONS)})"""
ACTIVE = "regexp_matches(content, '(?i)(</?script[\\s>]|\\bon[a-z]+\\s*=|javascript\\s*:|<foreignObject)')"
EMBEDDED = f""", emb AS (SELECT package_id, path, ext, severity FROM (SELECT package_id, path, ext, CASE WHEN ext IN {within(R.CODELESS_EXTENSIONS)} AND regexp_matches(content, '<\\?php|<%(eval|exec|system)') THEN 'CRITICAL' WHEN ext IN {within(R.SCRIPTABLE_EXTENSIONS)} AND {ACTIVE} THEN 'HIGH'
 WHEN ext = 'xml' AND {ACTIVE} AND regexp_matches(content, '(?i)xmlns[^=]*=\\s*["'']http://www\\.w3\\.org/(2000/svg|1999/xhtml|1999/XSL/Transform)') THEN 'HIGH' END AS severity FROM (SELECT *, {EXT} AS ext FROM files WHERE size > 0 AND size < {R.SCAN_LIMIT})) WHERE severity IS NOT NULL)"""
HYGIENE = f""", imgs AS (SELECT package_id, count(*) AS images FROM files WHERE {EXT} IN {within(R.IMAGE_EXTENSIONS)} GROUP BY 1), prs AS (SELECT package_id, ext || '→' || mime AS pair, count(*) AS n FROM mism WHERE severity = 'LOW' GROUP BY ALL),
 hyg AS (SELECT package_id, images, mislabels, percent, CASE WHEN kinds > 1 AND percent >= 10 THEN 'HIGH' WHEN mislabels >= 20 OR percent >= 5 THEN 'MEDIUM' END AS severity, CASE WHEN topn * 100 // mislabels >= 80 THEN 'systematic' ELSE 'mixed' END AS habit
 FROM (SELECT package_id, any_value(images) AS images, CAST(sum(n) AS BIGINT) AS mislabels, count(*) AS kinds, max(n) AS topn, CAST(sum(n) AS BIGINT) * 100 // any_value(images) AS percent FROM prs JOIN imgs USING (package_id) GROUP BY 1) WHERE (kinds > 1 AND percent >= 10) OR mislabels >= 20 OR percent >= 5)"""
FINDINGS = f"""{HITS}{MISMATCH}{DECEPTIVE}{EMBEDDED}{HYGIENE}, found AS (SELECT package_id, path, 'pattern' AS kind, type, severity FROM firsts UNION ALL SELECT package_id, path, 'mime_mismatch', 'mime_mismatch', severity FROM mism UNION ALL SELECT package_id, path, 'deceptive_extension', 'deceptive', severity FROM decep
 UNION ALL SELECT package_id, path, 'embedded_code', 'embedded_code', severity FROM emb UNION ALL SELECT package_id, '(scan root)', 'file_hygiene', 'file_hygiene', severity FROM hyg)"""
WEIGHTS = R.values(list(R.CONTENT_WEIGHTS.items()), "name, weight")
CONTENT_RISK = f""", risk AS (SELECT package_id, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS risk_score, CASE WHEN count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) > 0 THEN 'fail' ELSE 'pass' END AS status
 FROM (SELECT package_id FROM files GROUP BY 1) p LEFT JOIN (SELECT *, CASE kind WHEN 'mime_mismatch' THEN 'mismatch_' || lower(severity) WHEN 'embedded_code' THEN 'embedded_' || lower(severity) WHEN 'file_hygiene' THEN 'hygiene_' || lower(severity) ELSE type END AS nm FROM found) f USING (package_id) LEFT JOIN (SELECT * FROM {WEIGHTS}) w ON f.nm = w.name GROUP BY 1)"""

jobs.add("scannable_files", lambda f: C.scannable_files(f).select("package_id", "path", "size"), "files", sql=f"SELECT package_id, path, size FROM files WHERE {SCANNABLE}")
jobs.add("scan_coverage", lambda f: C.scan_coverage(f, 20_000), "files", sql=f"SELECT package_id, count(*) AS files, count(*) FILTER (size > 0 AND size <= 20000 AND coalesce({EXT}, '') NOT IN {within(R.SKIPPED_EXTENSIONS)}) AS scanned, count(*) FILTER (size > 20000) AS size_skipped FROM files GROUP BY 1")
jobs.add("pattern_hits", lambda f: C.pattern_hits(C.scannable_files(f)), "files", sql=f"{HITS} SELECT * FROM hits")
jobs.add("first_hit_per_type", lambda f: C.first_hit_per_type(C.pattern_hits(C.scannable_files(f))), "files", sql=f"{HITS} SELECT package_id, path, type, pattern_id, line, severity, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS text FROM firsts")
_sniff = " ".join(f"WHEN starts_with(h, '{p}') THEN '{m}'" for p, m in R.SIGNATURES)
jobs.add("sniff_mime", lambda f: C.sniff_mime(f.drop("mime")).select("package_id", "path", "mime"), "files", sql=f"SELECT package_id, path, CASE WHEN h = '' THEN 'inode/x-empty' {_sniff} ELSE 'text/plain' END AS mime FROM (SELECT *, hex(encode(substr(content, 1, 16))) AS h FROM files)")
jobs.add("mime_mismatch", C.mime_mismatch, "files", sql=f"{MISMATCH} SELECT * FROM mism")
jobs.add("deceptive_extension", C.deceptive_extension, "files", sql=f"{DECEPTIVE} SELECT * FROM decep")
jobs.add("embedded_code", C.embedded_code, "files", sql=f"{EMBEDDED} SELECT * FROM emb")
jobs.add("image_hygiene", C.image_hygiene, "files", sql=f"{MISMATCH}{HYGIENE} SELECT * FROM hyg")
jobs.add("all_content_findings", C.all_content_findings, "files", sql=f"{FINDINGS} SELECT * FROM found")


def _by_digest(files):
    """Findings from verdicts, judged in a first run; a second one over the same files finds nothing left to judge."""
    spark = files.sparkSession
    path, listed = new_path(spark, "verdicts"), W.with_digest(files)
    W.judge_new(listed, path)
    if W.judge_new(listed, path):
        raise AssertionError("a second run judged contents again")
    return W.findings(listed, W.known_verdicts(spark, path))


jobs.add("content_scan_by_digest", _by_digest, "files", sql=f"{FINDINGS} SELECT * FROM found")
jobs.add("content_summary", lambda f: C.content_summary(C.all_content_findings(f), f), "files", sql=f"{FINDINGS} SELECT package_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(severity) AS total_issues FROM (SELECT package_id FROM files GROUP BY 1) p LEFT JOIN found USING (package_id) GROUP BY 1")
jobs.add("content_risk", lambda f: C.content_risk(C.all_content_findings(f), f), "files", sql=f"{FINDINGS}{CONTENT_RISK} SELECT * FROM risk")

# --- permissions ---
O_, G_, U_, S_ = "(mode % 10)", "(mode // 10 % 10)", "(mode // 100 % 10)", "(mode // 1000 % 10)"
WW, INV, SEC, ESC, STK = f"{O_} & 2 > 0", f"({U_} < {G_} OR {U_} < {O_})", f"({O_} & 2 = 0 AND {G_} & 2 = 0 AND {U_} & 2 = 0 OR {G_} = 0 AND {O_} = 0)", f"({S_} & 6 > 0)", f"{S_} & 1 > 0"
WW, STK = f"(({O_} & 2) > 0)", f"(({S_} & 1) > 0)"
SEC = f"((({O_} | {G_} | {U_}) & 2) = 0 OR ({G_} = 0 AND {O_} = 0))"
ESC = f"(({S_} & 6) > 0)"
LINK = "CASE WHEN link_resolved IS NULL THEN 'dangling' WHEN starts_with(link_resolved || '/', '/srv/' || package_id || '/') THEN 'internal' ELSE 'external' END"
EXEC = f"(kind = 'file' AND (({O_} | {G_} | {U_}) & 1) > 0 AND coalesce({EXT}, '') IN {within(R.NO_EXEC_EXTENSIONS)})"
SENS = f"(kind = 'file' AND mode % 100 > 0 AND (lower({NAME}) IN {within(R.SENSITIVE_NAMES)} OR coalesce({EXT}, '') IN {within(R.SENSITIVE_EXTENSIONS)}))"
ART = f"((kind = 'dir' AND {NAME} IN {within(R.ARTIFACT_DIRS)} OR kind = 'file' AND ({NAME} IN {within(R.ARTIFACT_FILES)} OR starts_with({NAME}, '._'))) AND NOT regexp_matches(path, '(^|/)\\.(git|svn|hg|bzr|idea|vscode)/'))"
PFOUND = f""", tests AS (SELECT *, CASE WHEN kind = 'link' THEN {LINK} END AS lc FROM entries), flags AS (SELECT *, [CASE WHEN kind = 'file' AND {WW} THEN 'world_writable_file' END, CASE WHEN kind = 'dir' AND {WW} AND NOT {STK} THEN 'sticky_missing' END, CASE WHEN kind = 'dir' AND {WW} THEN 'world_writable_dir' END, CASE WHEN kind = 'file' AND {ESC} THEN 'privilege_escalation' END,
 CASE WHEN kind <> 'link' AND {INV} THEN 'inversion' END, CASE WHEN lc = 'external' THEN 'external_link' END, CASE WHEN {SENS} THEN 'sensitive_exposed' END] AS crit, [CASE WHEN lc = 'internal' THEN 'internal_link' END, CASE WHEN lc = 'dangling' THEN 'dangling_link' END, CASE WHEN {EXEC} THEN 'unneeded_exec' END, CASE WHEN {ART} THEN 'deploy_artifact' END] AS oth FROM tests),
 pf AS (SELECT package_id, path, mode, issue, regexp_matches(path, '(^|/)(vendor|node_modules)/') AS in_dependencies FROM (SELECT *, unnest(list_concat(list_concat(crit, oth), [CASE WHEN kind <> 'link' AND {SEC} AND mode IN (400,440,444,500,550,555,600,700) AND len(list_filter(crit, lambda x: x IS NOT NULL)) = 0 AND NOT {EXEC} THEN 'secure_permissions' END])) AS issue FROM flags) WHERE issue IS NOT NULL)"""
PWEIGHTS = R.values(R.PERMISSION_WEIGHTS, "issue, weight, critical, counted")
PRISK = f"""{PFOUND}, prisk AS (SELECT package_id, CAST(coalesce(sum(weight), 0) AS BIGINT) AS risk_score, count(*) FILTER (counted) AS issues, count(*) FILTER (critical) AS critical_issues, count(*) FILTER (issue = 'secure_permissions' AND NOT in_dependencies) AS hardened, count(*) FILTER (issue = 'secure_permissions' AND in_dependencies) AS hardened_dependencies,
 CASE WHEN count(*) FILTER (critical) > 0 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT package_id FROM entries GROUP BY 1) e LEFT JOIN (SELECT * FROM pf JOIN (SELECT * FROM {PWEIGHTS}) USING (issue)) w USING (package_id) GROUP BY 1)"""
MODE_COLUMNS = ["package_id", "path", "mode", "world_writable", "inversion", "secure", "priv_esc", "sticky"]
jobs.add("classify_modes", lambda e: P.classify_modes(e).select(*MODE_COLUMNS), "entries", sql=f"SELECT package_id, path, mode, {WW} AS world_writable, {INV} AS inversion, {SEC} AS secure, {ESC} AS priv_esc, {STK} AS sticky FROM entries WHERE kind <> 'link'")
jobs.add("classify_symlinks", P.classify_symlinks, "entries", sql=f"SELECT package_id, path, link_target, link_resolved, {LINK} AS link_class FROM entries WHERE kind = 'link'")
jobs.add("exec_on_data_files", P.exec_on_data_files, "entries", sql=f"SELECT package_id, path, mode, {EXT} AS ext FROM entries WHERE {EXEC}")
jobs.add("exposed_secrets", P.exposed_secrets, "entries", sql=f"SELECT package_id, path, mode FROM entries WHERE {SENS}")
jobs.add("orphan_ownership", lambda e: P.orphan_ownership(e, R.small(e.sparkSession, [(n,) for n in range(7)], "uid"), R.small(e.sparkSession, [(n,) for n in range(4)], "gid")), "entries", sql="SELECT package_id, path, uid, gid, uid > 6 AS no_user, gid > 3 AS no_group FROM entries WHERE kind <> 'link' AND (uid > 6 OR gid > 3)")
jobs.add("deploy_artifacts", P.deploy_artifacts, "entries", sql=f"SELECT package_id, path, kind FROM entries WHERE {ART}")
jobs.add("permission_findings", P.permission_findings, "entries", sql=f"{PFOUND} SELECT * FROM pf")
jobs.add("permission_risk", lambda e: P.permission_risk(P.permission_findings(e), e), "entries", sql=f"{PRISK} SELECT * FROM prisk")
jobs.add("permission_fix_plan", lambda e: P.permission_fix_plan(P.permission_findings(e)), "entries", sql=f"""{PFOUND} SELECT * FROM (SELECT package_id, path, issue, mode, CAST(CASE WHEN issue IN ('world_writable_file', 'world_writable_dir') THEN mode - 2 WHEN issue = 'sticky_missing' THEN mode + 1000 WHEN issue = 'sensitive_exposed' THEN mode // 100 * 100 WHEN issue = 'unneeded_exec' THEN mode - {O_} % 2 - 10 * ({G_} % 2) - 100 * ({U_} % 2) END AS INT) AS proposed FROM pf) WHERE proposed IS NOT NULL""")
jobs.add("filescan_rollup", lambda f, e: P.filescan_rollup(O.file_totals(f), P.permission_risk(P.permission_findings(e), e).filter("risk_score % 3 <> 1"), C.content_summary(C.all_content_findings(f), f)), "files", "entries", sql=f"""{FINDINGS}{PRISK}, s AS (SELECT package_id, count(*) AS files FROM files GROUP BY 1), c AS (SELECT package_id, count(severity) AS total_issues FROM (SELECT package_id FROM files GROUP BY 1) p LEFT JOIN found USING (package_id) GROUP BY 1)
 SELECT package_id, files, issues, total_issues, CASE WHEN coalesce(issues, 0) > 0 OR coalesce(total_issues, 0) > 0 THEN 'HIGH' WHEN files IS NULL OR issues IS NULL OR total_issues IS NULL THEN 'ERROR' ELSE 'CLEAN' END AS level FROM s FULL JOIN (SELECT package_id, issues FROM prisk WHERE risk_score % 3 <> 1) p USING (package_id) FULL JOIN c USING (package_id)""")
