"""What must not grow in the driver, or in what is shuffled, when the tables do."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cratewarden.operators import audit as A
from cratewarden.operators import graph as H
from cratewarden.operators import identities as P
from cratewarden.operators import vendored as V
from cratewarden.sources import archives as R

from .test_indexes import edits


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_registry_is_never_broadcast(spark, tmp_path):
    """An index of names is many times its names, which Spark doesn't see when it plans a broadcast by the size of files."""
    spark.createDataFrame([("p", "reqeusts", "1"), ("p", "requests", "1")], "package_id string, name string, version string").write.parquet(f"{tmp_path}/components")
    spark.createDataFrame([("requests",)], "name string").write.parquet(f"{tmp_path}/registry")
    found = A.typosquat(spark.read.parquet(f"{tmp_path}/components"), spark.read.parquet(f"{tmp_path}/registry"))
    assert broadcasts(found) == 0
    assert [(r.name, r.target, r.distance) for r in found.collect()] == [("reqeusts", "requests", 2)]


def test_far_names_with_a_common_rest_are_no_pair(spark):
    """Two letters gone from each give `abcd`, but they are three edits apart; such pairs grow with the square of a registry."""
    keys = spark.createDataFrame([("flat", "1abcd2"), ("flat", "1abcd")], "list string, key string")
    registry = spark.createDataFrame([("flat", "abcd34", "abcd34")], "list string, popular string, canonical string")
    assert A.shared_deletions(keys, registry, 2).count() == 0
    registry = spark.createDataFrame([("flat", "abcd3", "abcd3")], "list string, popular string, canonical string")
    assert {(r.key, r.popular) for r in A.shared_deletions(keys, registry, 2).collect()} == {("1abcd2", "abcd3"), ("1abcd", "abcd3")}


def test_only_near_names_leave_the_index(spark, monkeypatch):
    """All pairs of near names and no others, among short names, names that end alike in one letter less or more, and many with one end."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abc", k=n))
    ends = [word(9) for _ in range(3)]
    names = {word(n) for n in range(12) for _ in range(25)} | {word(rng.randint(0, 5)) + e for e in ends for _ in range(40)}
    names |= {n[:at] + rng.choice(("", "b", "cc", n[at : at + 1] + "a")) + n[at + 1 :] for n in sorted(names) for at in [rng.randint(0, len(n))]}
    keys = spark.createDataFrame([("flat", n) for n in sorted(names)] + [("flat", None)], "list string, key string")
    registry = spark.createDataFrame([("flat", n, n.upper()) for n in sorted(names) if rng.random() < 0.7] + [("composer", "ab", "AB"), ("flat", None, "n")], "list string, popular string, canonical string")
    known = [r.popular for r in registry.filter("list = 'flat' and popular is not null").collect()]
    between = {(a, b): edits(a, b) for a in names for b in known if abs(len(a) - len(b)) <= 2}
    for most in (A.MOST, 12, 0):
        monkeypatch.setattr(A, "MOST", most)
        for distance in (1, 2):
            got = {(r.key, r.popular, r.canonical, r.distance) for r in A.shared_deletions(keys, registry, distance).collect()}
            assert got == {(a, b, b.upper(), d) for (a, b), d in between.items() if d <= distance}
    nearest = {r.key: (r.distance, r.canonical) for r in A.nearest_names(keys, registry, 2).collect()}
    assert nearest == {a: min(near) for a in names if (near := [(d, b.upper()) for b in known if (d := between.get((a, b), 3)) <= 2])}


def test_sliding_activity_is_exact(spark, tmp_path):
    """Equal to its SQL where a package has far more contributors than a sketch counts exactly."""
    events = spark.range(90000).select((F.col("id") % 40000 * 31).alias("user_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 29).cast("int"))).alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select user_id, ts::timestamp as ts from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    expected = con.execute(entry.oracle_sql()["sliding_activity"]).fetchall()
    found = entry.queries()["sliding_activity"](spark, str(tmp_path)).select("package_id", "period", "commits", "contributors")
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected) and max(r[3] for r in expected) > 20000


def test_publishers_are_never_broadcast(spark, monkeypatch):
    """Neither in a round nor before or after."""
    seen, cut = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df, name: (seen.append(broadcasts(df)), cut(df, name))[1])
    found = entry.queries()["publisher_rollup"](spark, "/root/testdata/sf0.001")
    assert seen == [0] * len(seen) and len(seen) > 4 and broadcasts(found) == 0


def test_sbom_graphs_are_walked_at_once_or_in_rounds(spark):
    """Both ways give the same, the first without a broadcast; null keys link nothing."""
    nodes = [("p", "s", str(k), k == 3) for k in range(40)] + [("q", "s", str(k), k % 9 == 0) for k in range(30)] + [(None, "s", "a", True), ("r", None, "a", True), ("q", "s", "0", False)]
    edges = [(p, "s", str(k), str((k * m + 1) % 50)) for p in "pqz" for k in range(0, 50, 3) for m in (3, 5)] + [(None, "s", "a", "b"), ("p", "s", None, "1"), ("p", "s", "3", None)]
    components = spark.createDataFrame(nodes, "package_id string, sbom_id string, spdxid string, is_root boolean")
    links = spark.createDataFrame(edges, "package_id string, sbom_id string, source string, target string")
    made = [H.component_depths(components, links, most=m) for m in (H.MOST, 70, 0)]
    assert broadcasts(made[0]) == 0
    one, two, three = (sorted(map(tuple, df.collect()), key=str) for df in made)
    assert one == two == three and len(one) == 72 and (None, "s", "a", None, "unreachable") in one


def test_archives_are_opened_once(spark):
    """What tells damaged archives is not a second pass over their bytes."""
    rows = spark.createDataFrame([("p", "a.tar", b"no archive"), ("q", "b.tar", None)], "package_id string, path string, content binary")
    opened = spark.sparkContext.accumulator(0)

    def task(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    assert R.whole_archives(R.expand_archives(rows.mapInArrow(task, rows.schema))).count() == 0
    assert opened.value == 2


def test_vendored_in_one_shuffle_of_fingerprints(spark):
    """Equal to sets of fingerprints in plain Python, also where a key has several files; each side is dealt by fingerprint alone, as two numbers."""
    text = lambda k: " ".join(f"{'abcdefghij'[(k * i * i + i) % 10]}{k * i % 97}" for i in range(1, 90))
    libraries = [(f"l{k}", text(k)) for k in range(12)] + [("l1", text(40)), ("twin", text(3)), (None, text(5)), ("empty", None)]
    files = [(f"p{k % 5}", text(k) + " " + text(k + 20)) for k in range(14)] + [("p0", text(40)), (None, text(1))]
    prints = lambda rows: {n: set().union(*(V.winnowed(t.encode()).tolist() for m, t in rows if m == n and t)) for n in {r[0] for r in rows if r[0]}}
    own, held = prints(libraries), prints(files)
    own = {n: {h for h in s if sum(h in o for o in own.values()) <= 1} for n, s in own.items()}
    expected = {(p, n, len(s & hs), len(s)) for p, hs in held.items() for n, s in own.items() if s and len(s & hs) >= max(0.3 * len(s), min(5, len(s)))}
    frames = spark.createDataFrame(libraries, "library string, content string"), spark.createDataFrame(files, "package_id string, content string")
    found, known = V.find_vendored(*frames, most=1)
    assert {tuple(r)[:4] for r in found.collect()} == expected and len(expected) > 5
    assert {r.library for r in known.collect()} == {n for n, s in own.items() if s}
    assert {tuple(r)[:4] for r in V.vendored_libraries(frames[1], V.library_index(frames[0], most=1)).collect()} == expected
