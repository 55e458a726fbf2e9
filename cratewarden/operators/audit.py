"""Dependency audit: look-alike names, names that invite confusion, suspicious names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packages import with_clean
from ..functions.text import listed, normalise_composer, normalise_name
from ..refdata import AUDIT_WEIGHTS, INTERNAL_NAME, INTERNAL_SCOPE, POPULAR, POPULAR_COMPOSER, SUSPICIOUS_VERSION, TEST_NAME, small
from ..sources.shared import cut

#: Characters at the end of a name by which it is indexed, and how many names of a registry may have the same there.
END, MOST = 8, 1000


def _popular(spark) -> DataFrame:
    """(list, popular, canonical, length): under 100 rows."""
    rows = [("flat", p, p, len(p)) for p in POPULAR]
    for shown in POPULAR_COMPOSER:
        vendor, package = shown.split("/")
        key = vendor + "/" + package.replace("-", "").replace("_", "")
        rows.append(("composer", key, shown, len(key)))
    return small(spark, rows, "list, popular, canonical, length")


def deletions(key: Column, most: int) -> Column:
    """The distinct texts that a text becomes when up to `most` of its characters are left out, itself included."""
    found = F.array(key)
    for _ in range(most):
        places = lambda t: F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
        less = lambda t: F.transform(places(t), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, less))))
    return found


def registry_keys(registry: DataFrame) -> DataFrame:
    """registry (name) -> (list, popular, canonical): each name as it is compared, vendor/package names also whole; of names that are compared alike the first stands for all."""
    low = F.lower("name")
    both = listed(
        F.when(low.rlike("^[^@/]+/[^/]+$"), F.struct(F.lit("composer").alias("list"), normalise_composer(F.col("name")).alias("popular"))),
        F.struct(F.lit("flat").alias("list"), normalise_name(F.col("name")).alias("popular")),
    )
    rows = registry.filter("name is not null").select("name", F.explode(both).alias("k")).select("name", "k.*")
    return rows.groupBy("list", "popular").agg(F.min("name").alias("canonical"))


def shared_deletions(keys: DataFrame, registry: DataFrame, max_distance: int) -> DataFrame:
    """keys (list, key), registry (list, popular, canonical) -> the pairs within max_distance (list, key, popular, canonical, distance), each at least once.

    Two texts within d edits share a text that either becomes by leaving out up
    to d characters, and so do their last p characters: they have p - d in
    common, in order. Both sides are indexed by hashes of what their ends become
    with d characters gone, some p ** d / d! a name, and meet in an equi-join that
    measures the distance of what it meets, so only true pairs leave it. Ends
    that over `MOST` names of the registry share tell few apart: those names are
    indexed by all their characters, for keys that are near such an end. How many
    rows come of a name Spark can't foresee, so no join here may be a broadcast.
    """
    size = max(END, 4 * max_distance)
    end = lambda c: F.right(F.col(c), F.lit(size))
    hashes = lambda texts: F.explode(F.transform(texts, lambda t: F.xxhash64("list", t))).alias("h")
    short = lambda c: hashes(F.filter(deletions(end(c), max_distance), lambda t: (F.length(t) == size - max_distance) | (F.length(c) < size)))
    whole = lambda c: hashes(deletions(F.col(c), max_distance))
    own, others = keys.filter("key is not null").select("list", "key").distinct(), registry.filter("popular is not null")
    crowded = others.groupBy("list", end("popular").alias("end")).agg(F.count(F.lit(1)).alias("names")).filter(F.col("names") > MOST).select("list", "end")

    def met(left: DataFrame, right: DataFrame, texts: Callable[[str], Column]) -> DataFrame:
        pairs = left.join(right.select("list", "popular", "canonical", texts("popular")).hint("merge"), ["h", "list"])
        return pairs.withColumn("distance", F.levenshtein("key", "popular", max_distance)).filter("distance >= 0").drop("h")

    ends, named = own.select("list", "key", short("key")), others.withColumn("end", end("popular"))
    near = ends.join(crowded.select("list", short("end")).hint("merge"), ["h", "list"], "left_semi").select("list", "key").distinct()
    alone, shared = (named.join(crowded.hint("merge"), ["list", "end"], how).drop("end") for how in ("left_anti", "left_semi"))
    return met(ends, alone, short).unionByName(met(near.select("list", "key", whole("key")), shared, whole))


def nearest_names(keys: DataFrame, registry: DataFrame, max_distance: int) -> DataFrame:
    """keys (list, key), registry (list, popular, canonical) -> (list, key, distance, canonical): the nearest name of each key, of several the first.

    Most keys are on the registry or one edit from it, and are settled by an
    index of one character gone; only the others meet a larger one.
    """
    registry, left = cut(registry, "registry-names"), cut(keys.select("list", "key").distinct(), "registry-keys")
    found = None
    for distance in sorted({min(1, max_distance), max_distance}):
        near = shared_deletions(left, registry, distance).groupBy("list", "key").agg(F.min(F.struct("distance", "canonical")).alias("b"))
        near = cut(near.select("list", "key", "b.*"), "registry-nearest")
        found = near if found is None else found.unionByName(near)
        left = left.join(near.hint("merge"), ["list", "key"], "left_anti")
    return found


def typosquat(components: DataFrame, popular: DataFrame | None = None, max_distance: int = 2) -> DataFrame:
    """Names at 1 to max_distance edits of a popular one: (package_id, name, version, target, distance, stage).

    vendor/package names are held against the vendor/package names of the list, then the
    vendor and the package alone against the others. An exact hit
    anywhere on a list clears the name, as does one at an earlier stage; else
    the smallest distance counts, then the canonical name. `popular` (name) is a
    table of any size, such as a registry: distinct names meet it in
    `nearest_names`. Without one the fixed lists count, under 100
    names that distinct names meet by length.
    """
    low = F.lower("name")
    pair = low.rlike("^[^@/]+/[^/]+$")
    stage = lambda n, label, which, key: F.struct(F.lit(n).alias("n"), F.lit(label).alias("stage"), F.lit(which).alias("list"), key.alias("key"))
    stages = listed(
        F.when(pair, stage(1, "full", "composer", normalise_composer(F.col("name")))),
        F.when(pair, stage(2, "vendor", "flat", F.translate(F.substring_index(low, "/", 1), "-_", ""))),
        stage(3, "package", "flat", normalise_name(F.col("name"))),
    )
    keys = components.select("name").distinct().select("name", F.explode(stages).alias("s")).select("name", "s.*")
    if popular is None:
        lengths = F.sequence(F.length("key") - max_distance, F.length("key") + max_distance)
        met = keys.withColumn("length", F.explode(lengths)).join(F.broadcast(_popular(components.sparkSession)), ["list", "length"])
        near = met.withColumn("distance", F.levenshtein("key", "popular", max_distance)).filter("distance >= 0")
    else:
        keys = cut(keys, "registry-stages")
        near = keys.join(nearest_names(keys, registry_keys(popular), max_distance).hint("merge"), ["list", "key"])
    best = near.groupBy("name").agg(F.min(F.struct("n", "distance", "canonical", "stage")).alias("b")).filter("b.distance >= 1")
    found = best.select("name", F.col("b.canonical").alias("target"), "b.distance", "b.stage")
    found = found if popular is None else found.hint("merge")
    return components.select("package_id", "name", "version").join(found, "name").select("package_id", "name", "version", "target", "distance", "stage")


def dependency_confusion(components: DataFrame) -> DataFrame:
    low = F.lower("name")
    reason = F.when(low.rlike(INTERNAL_SCOPE), "internal_scope").when(low.rlike(INTERNAL_NAME), "internal_name_pattern")
    return components.withColumn("reason", reason).filter("reason is not null").select("package_id", "name", "version", "reason", F.lit("CRITICAL").alias("severity"))


def suspicious_names(components: DataFrame) -> DataFrame:
    bare = normalise_name(F.col("name"))
    reason = (
        F.when(F.col("version").rlike(SUSPICIOUS_VERSION), "suspicious_version")
        .when(F.lower("name").rlike(TEST_NAME), "test_name_pattern")
        .when(F.length(bare).between(1, 2), "very_short_name")
        .when(F.col("name").rlike("^[0-9]+$"), "numeric_name")
    )
    return components.withColumn("reason", reason).filter("reason is not null").select("package_id", "name", "version", "reason", F.lit("MEDIUM").alias("severity"))


def audit_findings(components: DataFrame) -> DataFrame:
    """All findings: (package_id, name, version, kind)."""
    parts = {"typosquat": typosquat(components), "dependency_confusion": dependency_confusion(components), "suspicious": suspicious_names(components)}
    out = None
    for kind, part in parts.items():
        part = part.select("package_id", "name", "version", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def audit_summary(findings: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Per package: findings by kind and the weighted risk; 0 for the clean ones of `packages`."""
    counts = {k: F.count_if(F.col("kind") == k) for k in AUDIT_WEIGHTS}
    score = sum((counts[k] * w for k, w in AUDIT_WEIGHTS.items()), F.lit(0))
    return with_clean(findings.select("package_id", "kind"), packages).groupBy("package_id").agg(*(c.alias(k) for k, c in counts.items()), score.cast("long").alias("risk_score"))
