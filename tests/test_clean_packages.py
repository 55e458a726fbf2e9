"""Packages without findings, and the rules of reports and contacts, with known answers."""

import json

import pytest

from cratewarden.operators import audit as A
from cratewarden.operators import lint as N
from cratewarden.operators import plugins as G
from cratewarden.operators import sbom as B
from cratewarden.operators import vulns as V
from cratewarden.sources import readers as D

PHPCS = "package_id string, php_version string, file string, line int, col int, type string, message string, source string, severity int, fixable boolean"


@pytest.fixture(scope="module")
def packages(spark):
    return spark.createDataFrame([("bad",), ("clean",), ("clean",)], "package_id string")


def by_package(df):
    return {r.package_id: r for r in df.collect()}


def test_reports(spark):
    message = lambda **m: {"message": "m", "source": "S", "severity": 5, "fixable": False, "type": "ERROR", "line": 1, "column": 1} | m
    reports = {
        "counted": {"files": {"a.php": {"errors": 2, "warnings": 1, "messages": [message(fixable=True), message(), message(type="WARNING")]}, "b.php": {"errors": 1, "messages": [message(fixable=True)]}}},
        "own": {"totals": {"errors": 9, "warnings": 8, "fixable": 7}, "files": {"a.php": {"errors": 1, "warnings": 0, "messages": [message()]}}},
        "clean": {"totals": {"errors": 0, "warnings": 0, "fixable": 0}, "files": {}}, "bare": {}, "empty list": {"files": []}, "nothing in a file": {"files": {"a.php": {}}},
    }
    rows = [(k, json.dumps(v)) for k, v in reports.items()] + [("broken", "PHP Fatal error"), ("none", None)]
    df = spark.createDataFrame(rows, "package_id string, content string")
    got = {k: tuple(r)[1:] for k, r in by_package(D.read_phpcs_totals(df)).items()}
    assert got == {
        "counted": (True, 3, 1, 2, 2), "own": (True, 9, 8, 7, 1), "clean": (True, 0, 0, 0, 0), "bare": (True, 0, 0, 0, 0), "empty list": (True, 0, 0, 0, 0), "nothing in a file": (True, 0, 0, 0, 1),
        "broken": (False, 0, 0, 0, 0), "none": (False, 0, 0, 0, 0),
    }
    assert {r.package_id for r in D.read_phpcs_report(df).filter("type = 'PARSE_ERROR'").collect()} == {"broken", "none"}
    assert {r.package_id for r in D.scanned_packages(df).collect()} == set(reports)


def test_message_defaults(spark, packages):
    df = spark.createDataFrame([("bad", "8.0", "a.php", None, None, None, None, None, None, None), ("bad", "8.1", "a.php", 3, 1, "WARNING", "w", "S", 5, True)], PHPCS)
    got = {(r.line, r.col, r.type, r.message, r.source, r.severity, r.fixable) for r in N.phpcs_issues(df).collect()}
    assert got == {(0, 0, "ERROR", "", "", 0, False), (3, 1, "WARNING", "w", "S", 5, True)}
    assert {k: tuple(r)[1:] for k, r in by_package(N.phpcs_totals(df, packages)).items()} == {"bad": (1, 1, 1, 1), "clean": (0, 0, 0, 0)}
    assert tuple(by_package(N.phpcs_totals(df, packages, kind="ERROR", min_severity=1))["bad"])[1:] == (0, 0, 0, 0)


def test_versions(spark, packages):
    df = spark.createDataFrame([("bad", v, "a.php", 1, 1, t, "m" + v, "S", 5, False) for v, t in [("5.2", "ERROR"), ("7.0", "WARNING"), ("8.4", "ERROR"), ("5.2", "WARNING")]], PHPCS)
    matrix = N.php_version_matrix(df, packages)
    assert matrix.count() == 30
    assert {(r.php_version, r.status) for r in matrix.filter("package_id = 'bad' and status <> 'passed'").collect()} == {("5.2", "failed"), ("7.0", "warning"), ("8.4", "failed")}
    got = {k: tuple(r)[1:] for k, r in by_package(N.php_range(matrix)).items()}
    assert got == {"clean": ("5.2", "8.4", ">=5.2 <=8.4", "^5.2 || ^6.0 || ^7.0 || ^8.0"), "bad": ("5.3", "8.3", ">=5.3 <=8.3", "^5.3 || ^6.0 || ^7.0 || ^8.0")}
    assert [(r.message, r.versions) for r in N.php_affected_versions(df).collect()] == [("m5.2", ["5.2", "7.0", "8.4"])]
    assert N.php_version_matrix(df.limit(0)).count() == 0


@pytest.mark.parametrize(("passing", "expected"), [
    (["7.4"], ("=7.4", "~7.4.0")), (["7.4", "8.0", "8.4"], (">=7.4 <=8.4", "^7.4 || ^8.0")), (["8.0", "8.1"], (">=8.0 <=8.1", ">=8.0")), ([], (None, None)),
])
def test_ranges(spark, passing, expected):
    matrix = spark.createDataFrame([("p", v, "passed" if v in passing else "failed") for v in ("5.6", "7.4", "8.0", "8.1", "8.4")], "package_id string, php_version string, status string")
    row = N.php_range(matrix).first()
    assert (row.version_range, row.composer) == expected


def test_vulnerabilities(spark, packages):
    cvss = lambda s: [("3.1", s)]
    matches = spark.createDataFrame([("bad", "C1", "Critical", cvss(9.8)), ("bad", "C2", "High", cvss(7.5)), ("bad", "C3", "Medium", cvss(5.0)), ("bad", "C4", None, []), ("bad", "C5", "Low", [])], "package_id string, vuln_id string, severity string, cvss array<struct<version:string,score:double>>")
    counts = by_package(V.vuln_counts(matches, packages))
    assert counts["bad"].asDict() == {"package_id": "bad", "critical": 1, "high": 1, "medium": 1, "low": 1, "negligible": 0, "unknown": 1, "total": 5, "unscored": 1}
    assert set(tuple(counts["clean"])[1:]) == {0}
    assert {k: tuple(r)[1:] for k, r in by_package(V.vuln_risk(matches, packages)).items()} == {"bad": (1192.5, "CRITICAL"), "clean": (0.0, "LOW")}
    sboms = spark.createDataFrame([("clean", "{}"), ("unscanned", "{}")], "package_id string, content string")
    documents = {k: json.loads(r.document) for k, r in by_package(V.merge_sbom_vulns(sboms, matches, packages)).items()}
    none = {s: 0.0 for s in ("critical", "high", "medium", "low", "negligible")}
    assert documents["clean"] == {"sbom": "{}", "vulnerability_scan": {"matches": []}, "risk_assessment": {"weighted_risk": 0.0, "level": "LOW", "cvss_totals": none, "vuln_counts": none}}
    assert documents["unscanned"] == {"sbom": "{}"}
    assert documents["bad"]["risk_assessment"]["cvss_totals"]["critical"] == 9.8 and len(documents["bad"]["vulnerability_scan"]["matches"]) == 5


def test_summaries(spark, packages):
    findings = spark.createDataFrame([("bad", "n", "1", "typosquat")], "package_id string, name string, version string, kind string")
    assert {k: r.risk_score for k, r in by_package(A.audit_summary(findings, packages)).items()} == {"bad": 400, "clean": 0}
    labelled = spark.createDataFrame([("bad", "n", "added")], "package_id string, name string, label string")
    assert {k: (r.added, r.total) for k, r in by_package(B.diff_summary(labelled, packages)).items()} == {"bad": (1, 1), "clean": (0, 0)}


@pytest.mark.parametrize(("headers", "readme", "passes", "issues"), [
    (" * Author: Jane\n * Author URI: mailto:jane@x.org\n", None, True, ["no_contributors"]),
    (" * Author URI: https://x.org\n", "=== D ===\nContributors: a\nDonate link: https://x.org/?m=me@x.org\n", True, ["no_author_header"]),
    (" * Author: Jane\n * Author URI: https://x.org\n", "=== D ===\nContributors: a\n", False, ["no_contact_email"]),
    (" * Author: Jane\n", "=== D ===\nContributors: a\nDonate link: mailto:me@x.org\n", True, ["no_author_uri_header"]),
    ("", "=== D ===\nContributors: a\nDonate link: mailto:me@x.org\n", False, ["no_author_header", "no_author_uri_header"]),
])
def test_contacts(spark, headers, readme, passes, issues):
    rows = [("p", "plugin.php", f"<?php\n/*\n * Plugin Name: Demo\n{headers} */")] + ([("p", "readme.txt", readme)] if readme else [])
    got = G.contact_info(spark.createDataFrame(rows, "package_id string, path string, content string")).first()
    assert (got.passes, got.issues) == (passes, issues)
