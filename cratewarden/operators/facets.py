"""Faceted counts from a bitmap index: for each value of each facet, how many packages have it under a selection of the other facets.

Packages are numbered, and for each (facet, value) a bitmap says which of them
have it, in buckets of 32768 packages. A selection is the OR of some bitmaps of
a facet, selections meet by AND, and counts are the bits left. The index is made
once; a search reads bitmaps only, some 4 KB for each value and bucket at most, and no package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def version_order(version: Column) -> Column:
    """A version's numbers as an array that is in order of version; without any number it is empty."""
    return F.transform(F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0)), lambda n: F.lpad(n, 12, "0"))


def facet_index(packages: DataFrame, *facets: str) -> DataFrame:
    """(facet, value, bucket, bits): the bitmap index of some columns of a table with a row for each package. A missing value is one of its own."""
    # numbers run on within a task, so buckets are full; written, as they aren't the same in another run
    numbered = cut(packages.select(*(F.col(f).cast("string").alias(f) for f in facets)).withColumn("number", F.monotonically_increasing_id()), "facet-numbers")
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets)))
    rows = numbered.select("number", pairs.alias("p")).select("p.*", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("at"))
    return rows.groupBy("facet", "value", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def facet_counts(index: DataFrame, **chosen: Column) -> DataFrame:
    """(facet, value, n) of every value that is left: how many packages have it and are in the selections of all *other* facets.

    A selection is a condition on `value`, as in F.col("value").isin("MIT"),
    F.col("value") != "GPL", or version_order(F.col("value")) <= version_order(F.lit("7.4"))
    for "not above". A null condition selects nothing. Without selections all packages count.
    """
    counted = index.withColumn("n", F.bitmap_count("bits"))
    facets = [F.struct(F.lit(f).alias("facet"), F.lit(g).alias("chosen")) for f in chosen for g in chosen if f != g]
    # a facet that nothing is chosen of is under all selections; "" stands for those
    facets += [F.struct(F.lit("").alias("facet"), F.lit(g).alias("chosen")) for g in chosen]
    if not chosen:
        return counted.groupBy("facet", "value").agg(F.sum("n").alias("n"))
    condition = F.lit(False)
    for facet, test in chosen.items():
        condition = condition | ((F.col("facet") == facet) & F.coalesce(test, F.lit(False)))
    selected = index.filter(condition).groupBy(F.col("facet").alias("chosen"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    scopes = index.sparkSession.range(1).select(F.explode(F.array(*facets)).alias("s")).select("s.*")  # the square of the number of chosen facets
    needed = scopes.groupBy("facet").agg(F.count(F.lit(1)).alias("needed"))
    scope = selected.join(F.broadcast(scopes), "chosen").groupBy("facet", "bucket").agg(F.bitmap_and_agg("bits").alias("within"), F.count(F.lit(1)).alias("met"))
    scope = scope.join(F.broadcast(needed), "facet").filter("met = needed").select(F.col("facet").alias("scope"), "bucket", "within")
    free = [f for f in chosen if len(chosen) == 1]  # the only facet chosen is itself under no selection
    under = F.when(F.col("facet").isin(*chosen), F.col("facet")).otherwise(F.lit(""))
    met = index.withColumn("scope", under).join(scope, ["scope", "bucket"])
    both = met.select("facet", "value", "bucket", F.explode(F.array("bits", "within")).alias("bits")).groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    rows = both.select("facet", "value", F.bitmap_count("bits").alias("n"))
    if free:
        rows = rows.unionByName(counted.filter(F.col("facet").isin(*free)).select("facet", "value", "n"))
    return rows.groupBy("facet", "value").agg(F.sum("n").alias("n")).filter("n > 0")
