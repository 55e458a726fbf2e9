"""SBOMs, manifests, licenses, names, vulnerabilities, checksums, provenance."""

import json

from pyspark.sql import functions as F

from cratewarden.jobs import inputs
from cratewarden.operators import audit as A
from cratewarden.operators import integrity as I
from cratewarden.operators import licenses as L
from cratewarden.operators import provenance as P
from cratewarden.operators import sbom as B
from cratewarden.operators import vulns as V
from cratewarden.sources import readers as D

COMPONENTS = "package_id string, sbom_id string, name string, version string, license string, is_root boolean, purl string"


def components(spark, rows):
    return spark.createDataFrame([("p", "s", n, v, lic, root, None) for n, v, lic, root in rows], COMPONENTS)


def test_license_policy_of_a_gpl_root(spark):
    rows = [("app", "1", "GPL-2.0-or-later", True), ("m", "1", "MIT", False), ("s", "1", "SSPL-1.0", False)]
    bad = L.license_summary(components(spark, rows)).collect()[0]
    assert (bad.gpl_compatible, bad.status) == (False, "FAIL")
    good = L.license_summary(components(spark, rows[:2])).collect()[0]
    assert (good.gpl_compatible, good.status) == (True, "PASS")
    roots = spark.createDataFrame([("p", "GPL-2.0-or-later")], "package_id string, root_license string")
    assert [r.issue for r in L.license_compat(components(spark, rows), roots).collect()] == ["dep_gpl_incompatible"]


def test_license_expressions(spark):
    cases = {"SSPL-1.0 OR MIT": ("permissive", True), "GPL-2.0-only AND MIT": ("strong_copyleft", False), "all rights reserved OR MIT": ("proprietary", False), "Foo OR GPL-2.0": ("unknown", True), "GPL-2.0 OR Foo": ("strong_copyleft", True), "GPLv2+": ("strong_copyleft", False), None: ("unknown", False), "": ("unknown", False), "LGPL-2.1 WITH x": ("weak_copyleft", False)}
    out = {r.license: (r.category, r.dual) for r in L.classify_license(components(spark, [("n", "1", c, False) for c in cases])).collect()}
    assert out == cases


def test_names(spark):
    rows = components(spark, [(n, "1.0", None, False) for n in ("reqeusts", "@internal/auth-tokens", "guzzlehttq/guzzle", "guzzlehttp/guzle", "guzzlehttp/guzzle", "vue", "vite", "my-test-kit", "12345", "Lod_ash")])
    assert {r.name: r.target for r in A.typosquat(rows).collect()} == {"reqeusts": "requests", "guzzlehttq/guzzle": "guzzlehttp/guzzle", "guzzlehttp/guzle": "guzzlehttp/guzzle"}
    assert [r.name for r in A.dependency_confusion(rows).collect()] == ["@internal/auth-tokens"]
    assert {r.name: r.reason for r in A.suspicious_names(rows).collect()} == {"my-test-kit": "test_name_pattern", "12345": "numeric_name"}


def test_weighted_risk(spark):
    cvss = lambda s: [("3.1", s)]
    matches = spark.createDataFrame([("p", "a", "Critical", cvss(9.8)), ("p", "b", "High", cvss(7.5)), ("p", "c", "Medium", cvss(5.0))], "package_id string, vuln_id string, severity string, cvss array<struct<version string, score double>>")
    row = V.vuln_risk(matches).collect()[0]
    assert (row.weighted_risk, row.level) == (1192.5, "CRITICAL")
    assert V.vuln_counts(matches).collect()[0].critical == 1


def test_identity(spark):
    files = [("akismet", "akismet/readme.txt", "=== Akismet ===\nContributors: a\nStable tag: 5.3.3\n"), ("rst", "readme.txt", "=== Title ===\nplain words\n"), ("core-6.5.3.zip", "wordpress/wp-includes/version.php", "<?php\n$wp_version = '6.5.3';"), ("js", "package.json", '{"name":"left-pad","version":"1.3.0"}'), ("lib-2.1.tar.gz", "x", "y")]
    out = {r.package_id: (r.ecosystem, r.name, r.version) for r in I.detect_identity(spark.createDataFrame(files, "package_id string, path string, content string")).collect()}
    assert out == {"akismet": ("wordpress", "Akismet", "5.3.3"), "rst": ("unknown", "rst", None), "core-6.5.3.zip": ("wordpress_core", "wordpress", "6.5.3"), "js": ("npm", "left-pad", "1.3.0"), "lib-2.1.tar.gz": ("unknown", "lib", "2.1")}


def test_difference(spark):
    a, b = components(spark, [("x", "1", None, False), ("y", "2", None, False), ("y", "1", None, False), ("r", "1", None, True)]), components(spark, [("y", "2", None, False), ("z", "1", None, False)])
    assert {(r.name, r.change) for r in B.diff_packages(a, b).collect()} == {("x", "only_a"), ("y", "changed"), ("z", "only_b"), ("r", "only_a")}
    assert {(r.name, r.label) for r in B.label_diff(B.diff_packages(a, b)).collect()} == {("x", "added"), ("y", "changed"), ("z", "removed")}


def test_unreadable_documents(spark):
    docs = spark.createDataFrame([("p", "s", None), ("q", "s", "{"), ("r", "s", "[1]"), ("t", "s", json.dumps({"spdxVersion": "SPDX-2.3"}))], "package_id string, sbom_id string, content string")
    assert D.read_sbom(docs).count() == 0
    assert {r.package_id: r.valid for r in B.validate_sboms(docs.withColumn("path", F.lit("bom.json"))).collect()} == {"p": False, "q": False, "r": False, "t": True}


def test_provenance_risk_floor(spark):
    checks = spark.createDataFrame([("p", "internal", True, True, True, True, 2, True), ("q", "public", False, False, False, False, 0, None)], "package_id string, package_type string, found boolean, valid boolean, source_verified boolean, builder_trusted boolean, slsa_level int, files_verified boolean")
    assert {r.package_id: r.risk for r in P.provenance_risk(checks).collect()} == {"p": 0, "q": 300}


def test_read_package_files(spark, tmp_path):
    """Hidden, empty and oddly named files too; nothing of excluded folders, and no links."""
    files = {"pkg/a.txt": "hello", "pkg/.git/config": "x", "pkg/sub/b c.php": "hello", "other/vendor/x": "x", "pkg/.env": "SECRET=1", "pkg/_under/.hidden/x.tar.gz": "plain", "pkg/empty": "", "pkg/é 100%.md": "q", "top.txt": "x", "pkg/sub/node_modules/y/z": "x"}
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "pkg" / "loop").symlink_to(tmp_path / "pkg")
    expected = {("pkg", p.removeprefix("pkg/")): files[p] for p in files if p.startswith("pkg/") and ".git/" not in p and "node_modules" not in p}
    for root in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        rows = D.read_package_files(spark, root).collect()
        assert {(r.package_id, r.path): r.content.decode() for r in rows} == expected and all(r.size == len(r.content) for r in rows)
    assert {(r.package_id, r.path) for r in D.read_package_files(spark, str(tmp_path), content=False).collect()} == set(expected)
    assert {r.path: r.content for r in D.read_package_files(spark, str(tmp_path), keep=4).collect()}["a.txt"] is None
    assert D.read_package_files(spark, f"{tmp_path}/nowhere").count() == 0


def test_linter_messages_come_from_every_row(spark):
    sf = "/root/testdata/sf0.001"
    assert inputs.frame(spark, sf, "phpcs").count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
