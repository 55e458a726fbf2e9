"""How alive a package is: contributors over any span, exact or from mergeable sketches, and how soon affected versions were left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 2 ** 14 registers: a standard error of 0.8 %, and exact counts up to some hundred.
SKETCH_BITS = 14


def activity_sketches(commits: DataFrame, unit: str = "month", bits: int = SKETCH_BITS) -> DataFrame:
    """commits (package_id, author, ts) -> (package_id, period, commits, authors): a sketch of the distinct authors of each period.

    New commits need no old ones: sketches of the same period, or of several,
    are merged by `merge_sketches`. A commit without a time is left out, one without author is a commit of nobody.
    """
    rows = commits.filter("ts is not null").withColumn("period", F.date_trunc(unit, "ts"))
    return rows.groupBy("package_id", "period").agg(F.count(F.lit(1)).alias("commits"), F.hll_sketch_agg("author", bits).alias("authors"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of the same packages and periods as one."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("package_id", "period").agg(F.sum("commits").alias("commits"), F.hll_union_agg("authors").alias("authors"))


def sliding_activity(sketches: DataFrame, spans: int, unit: str = "month") -> DataFrame:
    """(package_id, period, commits, contributors): for each period from a package's first on, and the `spans` - 1 before it.

    Each sketch counts for the periods that look back on it, up to the last of all;
    periods without commits of their own are there, too. Contributors are estimates, within 3 %.
    """
    rows = _spread(sketches, spans, unit, "commits", "authors")
    found = rows.groupBy("package_id", "period").agg(F.sum("commits").alias("commits"), F.hll_union_agg("authors").alias("authors"))
    return found.select("package_id", "period", "commits", F.hll_sketch_estimate("authors").alias("contributors"))


def activity_authors(commits: DataFrame, unit: str = "month") -> DataFrame:
    """commits (package_id, author, ts) -> (package_id, period, author, commits): what `activity_sketches` sums up, a row for each author of a period. Unions of parts are as good as the whole."""
    rows = commits.filter("ts is not null").withColumn("period", F.date_trunc(unit, "ts"))
    return rows.groupBy("package_id", "period", "author").agg(F.count(F.lit(1)).alias("commits"))


def exact_activity(authors: DataFrame, spans: int, unit: str = "month") -> DataFrame:
    """The rows of `sliding_activity` with exact numbers of contributors, from `activity_authors`. An author costs a row for each period that looks back on one with commits of theirs."""
    each = _spread(authors, spans, unit, "author", "commits").groupBy("package_id", "period", "author").agg(F.sum("commits").alias("commits"))
    return each.groupBy("package_id", "period").agg(F.sum("commits").alias("commits"), F.count("author").alias("contributors"))


def _spread(rows: DataFrame, spans: int, unit: str, *columns: str) -> DataFrame:
    """Rows of a period, once for each period that looks back on it, up to the last of all."""
    last = rows.agg(F.max("period").alias("last"))
    until = F.least(F.col("last"), F.col("period") + F.expr(f"interval {spans - 1} {unit}"))
    both = rows.crossJoin(F.broadcast(last))  # one row
    return both.select("package_id", *columns, F.explode(F.sequence("period", until, F.expr(f"interval 1 {unit}"))).alias("period"))


# --- releases that leave an affected range ---


def version_key(version: Column) -> Column:
    """A text that is in order of version: numbers by size, trailing zeros without weight, and what comes before a release before it.

    1.9 < 1.10, 1.0 = 1.0.0, 2.0-beta.2 < 2.0-beta.10 < 2.0-rc1 < 2.0. A `v` in front and a build after `+` don't count. Numbers of up to 12 digits.
    """
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(version), "^[vV=]+", ""), r"\+.*$", ""))
    release = F.regexp_extract(bare, r"^[0-9]+(?:\.[0-9]+)*", 0)
    before = F.regexp_replace(F.substring(bare, F.length(release) + 1, F.length(bare)), r"^[.\-_]+", "")
    numbers = F.regexp_replace(release, r"(\.0+)+$", "")
    padded = lambda text, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p))
    return F.concat(F.array_join(padded(numbers, "[0-9]+"), "."), F.lit(" "), F.when(before == "", "~").otherwise(F.array_join(padded(before, "[0-9]+|[a-z]+"), " ")))


def branch(key: Column) -> Column:
    """The first number of a version key: what releases are parted by."""
    return F.substring(key, 1, 12)


def first_fixes(affected: DataFrame, releases: DataFrame) -> DataFrame:
    """affected (package_id, vuln_id, last_affected, exposed), releases (package_id, version, released) -> (package_id, vuln_id, version, released, days).

    The release that first leaves each affected range: of the versions above
    its last one the lowest, and from exposure to it the days, negative if the release was there before;
    null where there is none yet. Of releases of one version the earliest counts.

    Ranges and releases lie on one line of version keys and meet by a window from
    above, parted by package and branch, so a package with most of the
    rows is parted, too. What finds nothing in its branch takes the lowest
    release of the next one, from a table of one row for each branch.
    """
    key = version_key(F.col("version"))
    by_key = releases.filter("version is not null").withColumn("key", key).groupBy("package_id", "key").agg(F.min(F.struct("released", "version")).alias("r"))
    points = by_key.select("package_id", "key", F.lit(1).alias("place"), F.struct("key", "r.version", "r.released").alias("release"), F.lit(None).cast("string").alias("vuln_id"), F.lit(None).cast("date").alias("exposed"))
    ends = affected.select("package_id", version_key(F.col("last_affected")).alias("key"), F.lit(0).alias("place"), F.lit(None).cast(points.schema["release"].dataType).alias("release"), "vuln_id", F.col("exposed").cast("date").alias("exposed"))
    # from the highest key down; of equal keys the range is first, as a release must lie above it
    above = Window.partitionBy("package_id", branch(F.col("key"))).orderBy(F.col("key").desc(), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = points.unionByName(ends).withColumn("fix", F.last("release", ignorenulls=True).over(above)).filter("place = 0")
    lowest = by_key.groupBy("package_id", branch(F.col("key")).alias("branch")).agg(F.min(F.struct("key", "r.version", "r.released")).alias("lowest"))
    after = Window.partitionBy("package_id").orderBy(F.col("branch").desc(), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = rows.select("package_id", branch(F.col("key")).alias("branch")).distinct()
    line = lowest.withColumn("place", F.lit(1)).unionByName(wanted.withColumn("place", F.lit(0)), allowMissingColumns=True)
    following = line.withColumn("lowest", F.last("lowest", ignorenulls=True).over(after)).filter("place = 0").select("package_id", "branch", F.col("lowest").alias("next"))
    found = rows.withColumn("branch", branch(F.col("key"))).join(following, ["package_id", "branch"], "left").withColumn("fix", F.coalesce("fix", "next"))
    return found.select("package_id", "vuln_id", F.col("fix.version").alias("version"), F.col("fix.released").cast("date").alias("released"), F.datediff(F.col("fix.released"), F.col("exposed")).alias("days"))
