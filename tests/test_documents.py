"""The document store: merging by key, untouched buckets, reruns."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from cratewarden.sources import sinks as S


def documents(spark, **rows):
    return spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in rows.items()], "package_id string, document string")


def stored(spark, path):
    return {r.package_id: json.loads(r.document) for r in S.read_package_documents(spark, path).collect()}


def written(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_keys_are_merged(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert stored(spark, path) == {}
    S.write_package_documents(documents(spark, a={"stats": {"files": 3, "share": 0.5}, "old": [1, "x", None, True]}, b={"stats": {"files": 1}}, c={"text": 'q"é\n', "n": 12345678901234}), path)
    S.write_package_documents(documents(spark, a={"filescan": {"issues": 2}}, d={"filescan": {"issues": 0}}), path)
    expected = {
        "a": {"stats": {"files": 3, "share": 0.5}, "old": [1, "x", None, True], "filescan": {"issues": 2}}, "b": {"stats": {"files": 1}}, "c": {"text": 'q"é\n', "n": 12345678901234}, "d": {"filescan": {"issues": 0}},
    }
    assert stored(spark, path) == expected
    S.write_package_documents(documents(spark, a={"filescan": {"issues": 2}}, d={"filescan": {"issues": 0}}), path)
    assert stored(spark, path) == expected
    S.write_package_documents(documents(spark, a={"stats": None}), path)
    assert stored(spark, path) == expected | {"a": {"stats": None, "old": [1, "x", None, True], "filescan": {"issues": 2}}}
    assert [r.package_id for r in S.read_package_documents(spark, path, "a", "nobody").collect()] == ["a"]


def test_other_buckets_stay(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    S.write_package_documents(documents(spark, **{f"p{k}": {"n": k} for k in range(200)}), path, 16)
    before = written(tmp_path / "store")
    S.write_package_documents(documents(spark, p7={"more": 1}), path, 16)
    after = written(tmp_path / "store")
    bucket = spark.createDataFrame([("p7",)], "package_id string").select(S._bucket(16).alias("b")).first().b
    own = f"bucket={bucket}/"
    assert {k: v for k, v in before.items() if not k.startswith(own)} == {k: v for k, v in after.items() if not k.startswith(own)}
    assert {k for k in before if k.startswith(own)} != {k for k in after if k.startswith(own)}
    assert stored(spark, path) == {f"p{k}": {"n": k} for k in range(200)} | {"p7": {"n": 7, "more": 1}}


def test_odd_documents(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    S.write_package_documents(documents(spark, a={"k": 1}).limit(0), path)
    assert stored(spark, path) == {}
    rows = [("a", "not json"), ("b", None), ("c", "[1]"), ("d", '{"k": 1}'), ("d", '{"k": 2}'), (None, '{"k": 3}'), ("", '{"k": {"k": {}}}')]
    S.write_package_documents(spark.createDataFrame(rows, "package_id string, document string").withColumns({"old": F.lit(1), "bucket": F.lit("x")}), path)
    assert stored(spark, path) == {"a": {}, "b": {}, "c": {}, "d": {"k": 2}, None: {"k": 3}, "": {"k": {"k": {}}}}
    S.write_package_documents(spark.createDataFrame([(None, '{"j": 1}'), ("a", '{"j": 2}'), ("d", "broken")], "package_id string, document string"), path)
    assert stored(spark, path) == {"a": {"j": 2}, "b": {}, "c": {}, "d": {"k": 2}, None: {"k": 3, "j": 1}, "": {"k": {"k": {}}}}
