"""Publishers behind packages: records linked by the author names, addresses and domains that they share, and verdicts rolled up by publisher.

A key that many packages share, such as a forge's domain or the name `admin`, tells nobody apart;
keys of more than `most` packages don't link. What links is one star for each key, from each of its packages
to the least, so a key costs as many rows as it has packages. Components come from rounds in which a
package takes the least label among its neighbours, and then that label's own; their number
grows with the logarithm of the longest way between two packages. Labels and links meet in merge joins:
files of few bytes hold very many names, and a broadcast a round would go through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

KEYS = ("author", "address", "domain")
MOST = 50


def _plain(text: Column) -> Column:
    """Lower case, without outer space or `mailto:`, runs of space as one; empty is missing."""
    return F.nullif(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "^\\s*mailto:", "")), r"\s+", " "), F.lit(""))


def publisher_keys(records: DataFrame) -> DataFrame:
    """records (package_id, author, address, domain) -> (package_id, kind, value, packages): the distinct keys of each package, and how many packages have each. A domain without one is that of the address."""
    address = _plain(F.col("address"))
    domain = F.coalesce(_plain(F.col("domain")), F.nullif(F.regexp_extract(address, "@([^@]+)$", 1), F.lit("")))
    values = {"author": _plain(F.col("author")), "address": address, "domain": domain}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), values[k].alias("value")) for k in KEYS)))
    rows = records.filter("package_id is not null").select("package_id", pairs.alias("k")).select("package_id", "k.*").filter("value is not null").distinct()
    many = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("packages"), F.min("package_id").alias("least"))
    return rows.join(many.hint("merge"), ["kind", "value"]).select("package_id", "kind", "value", "packages", "least")


def publisher_identities(records: DataFrame, most: int = MOST) -> DataFrame:
    """records (package_id, author, address, domain) -> (package_id, publisher): the least package_id that is linked to it in any number of steps, itself included.

    Packages without any key, or with common ones only, are publishers of their own. Null package_ids are left out.
    """
    keys = cut(publisher_keys(records), "publisher-keys")
    edges = keys.filter((F.col("packages") <= most) & (F.col("package_id") != F.col("least"))).select(F.col("package_id").alias("a"), F.col("least").alias("b")).distinct()
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "publisher-links")
    nodes = records.filter("package_id is not null").select("package_id").distinct()
    # only packages with a link take part in rounds
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "publisher-labels")
    while not labels.isEmpty():
        heard = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("string").alias("before"))
        least = labels.select("node", "label", F.col("label").alias("before")).unionByName(heard).groupBy("node").agg(F.min("label").alias("label"), F.max("before").alias("before"))
        least = cut(least, "publisher-least")
        # the label's own label is as good, and may be less
        labels = least.join(least.select(F.col("node").alias("label"), F.col("label").alias("next")).hint("merge"), "label").select("node", F.least("label", "next").alias("label"), "before")
        labels = cut(labels, "publisher-labels")
        if labels.filter("label <> before").isEmpty():
            break
    return nodes.join(labels.select(F.col("node").alias("package_id"), "label").hint("merge"), "package_id", "left").select("package_id", F.coalesce("label", "package_id").alias("publisher"))


def publisher_rollup(identities: DataFrame, verdicts: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """identities (package_id, publisher), verdicts (package_id, verdict), of domains or addresses -> (publisher, packages, judged, worst, doubtful).

    `order` lists verdicts from bad to good; worst is the first of them that any package of the publisher has,
    and doubtful how many packages have any but the last. Others don't count as judged.
    """
    place = F.nullif(F.array_position(F.lit(list(order)), F.col("verdict")), F.lit(0))
    worst = verdicts.withColumn("place", place.cast("int")).groupBy("package_id").agg(F.min("place").alias("place"))
    rows = identities.join(worst.hint("merge"), "package_id", "left").groupBy("publisher")
    found = rows.agg(F.count(F.lit(1)).alias("packages"), F.count("place").alias("judged"), F.min("place").alias("place"), F.count_if(F.col("place") < len(order)).alias("doubtful"))
    return found.select("publisher", "packages", "judged", F.get(F.lit(list(order)), F.col("place") - 1).alias("worst"), "doubtful")
