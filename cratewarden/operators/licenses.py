"""License classification and compatibility. Distinct license texts are classified once and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_license
from ..refdata import LICENSE_POLICY, LICENSES, PROPRIETARY, pairs, small


def _known(name: Column) -> Column:
    """Category of an exact identifier, else of proprietary words, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for category, ids in LICENSES.items():
        out = out.when(name.isin(ids.split()), category)
    return out.when(name.rlike(PROPRIETARY), "proprietary")


def _term(name: Column) -> Column:
    return F.when(name.isin("NOASSERTION", "NONE", ""), "unknown").otherwise(F.coalesce(_known(normalise_license(name)), F.lit("unknown")))


def category_of(name: Column) -> Column:
    """permissive, weak_copyleft, strong_copyleft, gpl_incompatible, proprietary or unknown; `:dual` follows for a choice.

    Terms of an OR count by the least restrictive, of an AND or WITH by the
    most; both folds depend on order, so they are folds.
    """
    spdx = normalise_license(name)
    terms = F.transform(F.filter(F.split(spdx, " "), lambda t: (t != "") & ~t.rlike(r"^(AND|OR|WITH|\()")), _term)
    either = F.aggregate(
        terms, F.lit("gpl_incompatible"),
        lambda best, t: F.when(best == "permissive", best).when(t == "permissive", t).when(t == "weak_copyleft", t).when(t.isin("strong_copyleft", "unknown") & (best == "gpl_incompatible"), t).otherwise(best),
    )
    every = F.aggregate(
        terms, F.lit("permissive"),
        lambda worst, t: F.when(worst.isin("proprietary", "gpl_incompatible"), worst).when(t.isin("proprietary", "gpl_incompatible", "strong_copyleft"), t)
        .when((t == "weak_copyleft") & (worst != "strong_copyleft"), t).when((t == "unknown") & (worst == "permissive"), t).otherwise(worst),
    )
    return (
        F.when(name.isNull() | name.isin("", "NOASSERTION", "NONE"), "unknown")
        .otherwise(F.coalesce(_known(spdx), F.when(spdx.rlike(r"\bOR\b"), F.concat(either, F.lit(":dual"))).when(spdx.rlike(r"\b(AND|WITH)\b"), every), F.lit("unknown")))
    )


def classify_license(components: DataFrame) -> DataFrame:
    """Adds category and dual."""
    distinct = components.select("license").distinct().withColumn("full", category_of(F.col("license")))
    rows = components.join(distinct, components["license"].eqNullSafe(distinct["license"]), "left").drop(distinct["license"])
    return rows.withColumns({"category": F.split_part("full", F.lit(":"), F.lit(1)), "dual": F.col("full").endswith(":dual")}).drop("full")


def license_policy(components: DataFrame) -> DataFrame:
    """Adds severity, reason and risk by category."""
    policy = small(components.sparkSession, LICENSE_POLICY, "category, severity, reason, risk")
    return classify_license(components).join(F.broadcast(policy), "category")


def root_license(components: DataFrame, ecosystems: DataFrame) -> DataFrame:
    """The license of each package's root: its own, else the ecosystem's default. ecosystems (package_id, ecosystem)."""
    root = F.min_by("license", F.struct((~F.col("is_root")).alias("other"), F.col("name"), F.col("version")))
    rows = components.groupBy("package_id").agg(root.alias("own")).join(ecosystems, "package_id", "left")
    stated = F.when(~F.col("own").isin("", "NOASSERTION", "NONE"), F.col("own"))
    default = F.when(F.col("ecosystem").isin("wordpress", "typo3", "drupal"), "GPL-2.0-or-later")
    source = F.when(stated.isNotNull(), "sbom").when(default.isNotNull(), "ecosystem_default").otherwise("none")
    return rows.select("package_id", F.coalesce(stated, default).alias("root_license"), source.alias("source"))


def license_compat(components: DataFrame, roots: DataFrame) -> DataFrame:
    """One row for each component that clashes: (package_id, name, version, license, issue, severity). roots (package_id, root_license).

    A root under a choice of licenses meets only the rule that always holds.
    """
    root = roots.select("package_id", category_of(F.col("root_license")).alias("root_category"))
    rows = classify_license(components).join(root, "package_id")
    category = F.col("category")
    issue = (
        F.when(category == "gpl_incompatible", "dep_gpl_incompatible")
        .when((F.col("root_category") == "strong_copyleft") & (category == "proprietary"), "dep_incompatible_with_gpl_root")
        .when((F.col("root_category") == "strong_copyleft") & (category == "unknown"), "dep_unknown_with_gpl_root")
        .when((F.col("root_category") == "proprietary") & (category == "strong_copyleft"), "root_incompatible_with_copyleft_dep")
    )
    severity = F.when(issue == "dep_unknown_with_gpl_root", "WARNING").otherwise("CRITICAL")
    return rows.withColumn("issue", issue).filter("issue is not null").select("package_id", "name", "version", "license", "issue", severity.alias("severity"))


def license_summary(components: DataFrame, require_known: bool = False) -> DataFrame:
    """Per package: components by category, risk, whether all are GPL-compatible, and PASS without any issue."""
    rows = license_policy(components)
    bad = F.col("category").isin("gpl_incompatible", "proprietary")
    unknown = F.col("category") == "unknown"
    issue = bad | unknown if require_known else bad
    categories = [c for c, *_ in LICENSE_POLICY]
    return rows.groupBy("package_id").agg(
        *(F.count_if(F.col("category") == c).alias(c) for c in categories), F.sum("risk").cast("long").alias("risk_score"), (F.count_if(issue) == 0).alias("gpl_compatible"), F.when(F.count_if(issue) == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def license_table(spark) -> DataFrame:
    """Identifiers and their categories."""
    return small(spark, pairs(LICENSES), "license, category")
