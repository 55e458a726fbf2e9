"""What must not grow in the driver when the tables do."""

import random

from cratewarden.llm import components, simhash


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_fingerprints_and_links_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Spark plans by the bytes of a file, and an explode makes 36 rows of each fingerprint without changing them."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=40)) for _ in range(30)]
    spark.createDataFrame([(k, t + " x" * (k % 3)) for k, t in enumerate(texts * 3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    for made in (simhash.simhash_report, simhash.drop_near_copies):
        seen = []
        for module in (simhash, components):
            monkeypatch.setattr(module, "cut", lambda df, name, cut=module.cut: (seen.append(broadcasts(df)), cut(df, name))[1])
        found = made(docs)
        assert seen == [0] * len(seen) and len(seen) > 4 and broadcasts(found) == 0
        monkeypatch.undo()
