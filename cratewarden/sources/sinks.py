"""One JSON document for each package, kept in buckets and merged key by key; and the common result envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, stored

#: Folders of a document store; a package is in that of its hash. Fixed for the life of a store.
BUCKETS = 64
#: A document's top-level keys, each with its value as it stands.
KEYS = "map<string,variant>"
STORE = "package_id string, document string, bucket int"


def package_documents(**parts: DataFrame) -> DataFrame:
    """(package_id, document): each part's row of a package under the part's name, as JSON. Parts have one row for each package."""
    out = None
    for name, part in parts.items():
        body = part.select("package_id", F.struct(*(c for c in part.columns if c != "package_id")).alias(name))
        out = body if out is None else out.join(body, "package_id", "full")
    return out.select("package_id", F.to_json(F.struct(*parts)).alias("document"))


def merged(old: Column, new: Column) -> Column:
    """Two JSON objects as one: the keys of `new` replace those of `old`, other keys stay as they are. What is no object counts as none."""
    parsed = lambda c: F.coalesce(F.from_json(c, KEYS), F.from_json(F.lit("{}"), KEYS))
    before, after = parsed(old), parsed(new)
    kept = F.map_filter(before, lambda k, v: ~F.map_contains_key(after, k))
    return F.to_json(F.map_concat(kept, after))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("package_id"), F.lit(buckets)).cast("int")


def write_package_documents(documents: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Merge documents (package_id, document) into the store at `path`: their top-level keys replace those of a package's record, its other keys stay.

    Only buckets that the documents touch are read and written again; the rest of
    the store stays as it is, and so do the other packages in those buckets. Writing
    the same documents again changes nothing. What is written is first kept
    in the shared folder, so a run that breaks off while it replaces folders can
    be repeated from the same documents. A null package_id is a package of its own; a document that isn't a
    JSON object has no keys; of several for one package in one call the greatest text counts. One
    writer at a time.
    """
    spark = documents.sparkSession
    new = cut(documents.groupBy("package_id").agg(F.max("document").alias("new")).withColumn("bucket", _bucket(buckets)), "documents-new")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # `buckets` numbers at most
    if not touched:
        return
    old = stored(spark, path, STORE)
    if old is None:
        rows = new.withColumn("document", merged(F.lit("{}"), F.col("new")))
    else:
        old = old.filter(F.col("bucket").isin(touched)).select(F.col("package_id").alias("id"), F.col("document").alias("old"))
        both = old.join(new.drop("bucket"), old["id"].eqNullSafe(new["package_id"]), "full")
        text = F.when(F.col("new").isNull() & F.col("package_id").isNull(), F.col("old")).otherwise(merged(F.col("old"), F.col("new")))
        rows = both.select(F.coalesce("package_id", "id").alias("package_id"), text.alias("document")).withColumn("bucket", _bucket(buckets))
    ready = cut(rows.select("package_id", "document", "bucket"), "documents-merged")
    ready.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "package_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_package_documents(spark: SparkSession, path: str, *packages: str, buckets: int = BUCKETS) -> DataFrame:
    """(package_id, document) of a store: of some packages, from their buckets alone, or of all; none if there is no store yet."""
    rows = stored(spark, path, STORE)
    if rows is None:
        return spark.createDataFrame([], "package_id string, document string")
    if packages:
        wanted = [r.b for r in spark.createDataFrame([(p,) for p in packages], "package_id string").select(_bucket(buckets).alias("b")).distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(wanted) & F.col("package_id").isin(*packages))
    return rows.select("package_id", "document")


def result_envelope(df: DataFrame, tool: str, issues: str = "issues") -> DataFrame:
    """df (package_id, issues array, ...) -> (package_id, envelope JSON). The remaining columns are the data."""
    data = [c for c in df.columns if c not in ("package_id", issues)]
    body = F.struct(
        F.lit("1.0").alias("schema_version"), F.lit(tool).alias("tool"), (F.size(issues) == 0).alias("success"), F.struct(F.size(issues).alias("issue_count")).alias("summary"),
        F.struct(*data).alias("data"), F.col(issues).alias("issues"), F.struct(F.col("package_id")).alias("metadata"),
    )
    return df.select("package_id", F.to_json(body).alias("envelope"))
