"""File statistics: categories, totals, conventions. All per package, over any number of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, extension, lines
from ..refdata import BEST_PRACTICES, CATEGORY_EXTENSIONS, CATEGORY_ORDER, EXCLUDED_DIRS, KNOWN_NAMES, TEXT_CATEGORIES, pairs, small

EXCLUDED = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in EXCLUDED_DIRS) + ")/"


def drop_excluded(files: DataFrame) -> DataFrame:
    """Files outside version-control, dependency and cache directories."""
    return files.filter(~F.col("path").rlike(EXCLUDED))


def with_extension(files: DataFrame) -> DataFrame:
    return files.withColumn("ext", extension(F.col("path")))


def categorise_files(files: DataFrame) -> DataFrame:
    """Adds category: by extension, else by the whole lower-case name of a file without one, else `other`."""
    spark = files.sparkSession
    by_ext = small(spark, pairs(CATEGORY_EXTENSIONS), "ext, ext_category")
    by_name = small(spark, pairs(KNOWN_NAMES), "bare, name_category")
    rows = with_extension(files).withColumn("bare", F.when(F.col("ext").isNull(), F.lower(basename(F.col("path")))))
    rows = rows.join(F.broadcast(by_ext), "ext", "left").join(F.broadcast(by_name), "bare", "left")
    return rows.select(*files.columns, "ext", F.coalesce("ext_category", "name_category", F.lit("other")).alias("category"))


def counted_lines(category: Column, size: Column, content: Column) -> Column:
    return F.when(category.isin(TEXT_CATEGORIES) & (size > 0), lines(content)).otherwise(F.lit(0).cast("long"))


def file_totals(files: DataFrame) -> DataFrame:
    """Per package: files, bytes, empty, hidden, minified and its bytes, lines."""
    name = basename(F.col("path"))
    minified = name.contains(".min.")
    rows = categorise_files(files)
    return rows.groupBy("package_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("size") == 0).alias("empty"), F.count_if(name.startswith(".")).alias("hidden"),
        F.count_if(minified).alias("minified"), F.sum(F.when(minified, F.col("size")).otherwise(0)).alias("minified_bytes"),
        F.sum(counted_lines(F.col("category"), F.col("size"), F.col("content"))).alias("lines"),
    )


def count_hidden_dirs(entries: DataFrame) -> DataFrame:
    """Per package, directories named .* that lie in no version-control directory."""
    inside = F.col("path").rlike(r"(^|/)\.(git|svn|hg)/")
    hidden = (F.col("kind") == "dir") & basename(F.col("path")).startswith(".") & ~inside
    return entries.groupBy("package_id").agg(F.count_if(hidden).alias("hidden_dirs"))


def category_stats(files: DataFrame) -> DataFrame:
    rows = categorise_files(files)
    return rows.groupBy("package_id", "category").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(counted_lines(F.col("category"), F.col("size"), F.col("content"))).alias("lines")
    )


def extension_stats(files: DataFrame) -> DataFrame:
    """Per package, category and extension; `_noext` stands for none. Each file's lines go to its own category."""
    rows = categorise_files(files).withColumn("ext", F.coalesce("ext", F.lit("_noext")))
    stats = rows.groupBy("package_id", "category", "ext").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(counted_lines(F.col("category"), F.col("size"), F.col("content"))).alias("lines")
    )
    return stats.withColumn("display", F.when(F.col("ext") == "_noext", "(no extension)").otherwise(F.concat(F.lit("."), F.col("ext"))))


def category_order(stats: DataFrame) -> DataFrame:
    """Category rows with their place in the fixed display order."""
    return stats.withColumn("place", F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category")).cast("int"))


def best_practice_files(files: DataFrame) -> DataFrame:
    """For each package and convention: the file that meets it, or null. The first pattern counts, then the smallest path."""
    spark = files.sparkSession
    rules = [(key, where, n, pattern) for key, where, patterns in BEST_PRACTICES for n, pattern in enumerate(patterns.split())]
    exact = small(spark, [(k, w, n, p) for k, w, n, p in rules if "*" not in p], "key, place, n, low")
    depth = F.size(F.split("path", "/"))
    named = files.filter(depth <= 2).select("package_id", "path", depth.alias("depth"), F.lower(basename(F.col("path"))).alias("low"))
    by_ending = F.array(*(F.when(F.col("low").endswith(p[1:]), F.struct(F.lit(k).alias("key"), F.lit(w).alias("place"), F.lit(n).alias("n"))) for k, w, n, p in rules if "*" in p))
    ending = named.select("package_id", "path", "depth", F.explode(F.filter(by_ending, lambda x: x.isNotNull())).alias("r")).select("package_id", "path", "depth", "r.*")
    met = named.join(F.broadcast(exact), "low").select("package_id", "path", "depth", "key", "place", "n").unionByName(ending)
    allowed = ((F.col("place") == "root") & (F.col("depth") == 1)) | ((F.col("place") == "deep") & ~F.col("path").rlike("^(vendor|node_modules)/"))
    best = met.filter(allowed).groupBy("package_id", "key").agg(F.min(F.struct("n", "path"))["path"].alias("found"))
    keys = small(spark, [(k,) for k, *_ in BEST_PRACTICES], "key")
    wanted = files.select("package_id").distinct().crossJoin(F.broadcast(keys))  # eleven rows for each package
    return wanted.join(best, ["package_id", "key"], "left")


def best_practice_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("package_id").agg(F.count("found").alias("found"), F.count_if(F.col("found").isNull()).alias("missing"))


def unwrap_single_root(entries: DataFrame) -> DataFrame:
    """Paths without their top directory where a package has nothing else at the top.

    Two aggregates per package decide it, so a package of any size is never sorted.
    """
    top = F.substring_index("path", "/", 1)
    inside = F.col("path").contains("/")
    tops = entries.groupBy("package_id").agg((F.min(top) == F.max(top)).alias("one"), F.count_if(~inside & (F.col("kind") != "dir")).alias("loose"), F.count_if(inside).alias("below"))
    rows = entries.join(tops, "package_id")
    single = F.col("one") & (F.col("loose") == 0) & (F.col("below") > 0)
    return rows.withColumn("root", F.when(single, top).otherwise("")).filter(~(single & ~inside)).withColumn("path", F.when(single, F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.col("path"))).drop("one", "loose", "below")


