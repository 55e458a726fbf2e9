"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round. links (a, b), a > b.

    Large star: every node ties its larger neighbours to the smallest of its
    neighbourhood. Small star: it ties its smaller neighbours and itself to it.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    tied = both.join(least.hint("merge"), "a")
    if large:
        tied = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of any comparable type, in any order -> (node, component): the smallest node reachable, for nodes with a link.

    Rounds are written to the shared folder; their number grows with the
    logarithm of the longest chain. A hub's links meet only in partial
    aggregates and in a merge join, whose partitions Spark can split; files of
    few bytes hold very many links, so none is broadcast.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links, "links")
    state = None
    while True:
        links = cut(_star(_star(links, large=True), large=False), "links")
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
