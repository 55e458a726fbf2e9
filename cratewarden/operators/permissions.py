"""Permission audit. A mode is an int that holds the decimal digits of the octal number: 755, 4755."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, extension, listed
from ..refdata import ARTIFACT_DIRS, ARTIFACT_FILES, NO_EXEC_EXTENSIONS, PERMISSION_WEIGHTS, SECURE_MODES, SENSITIVE_EXTENSIONS, SENSITIVE_NAMES, small


def _digit(n: int) -> Column:
    """The n-th octal digit of mode, from the right: others, group, owner, special."""
    return (F.floor(F.col("mode") / 10**n) % 10).cast("int")


OTHERS, GROUP, OWNER, SPECIAL = range(4)


def _bit(digit: int, bit: int) -> Column:
    return _digit(digit).bitwiseAND(F.lit(bit)) > 0


def classify_modes(entries: DataFrame) -> DataFrame:
    """Adds world_writable, inversion, secure, priv_esc and sticky. Links are left out."""
    writable = reduce(lambda a, b: a | b, (_bit(d, 2) for d in (OTHERS, GROUP, OWNER)))
    return entries.filter("kind <> 'link'").withColumns({
        "world_writable": _bit(OTHERS, 2),
        "inversion": (_digit(OWNER) < _digit(GROUP)) | (_digit(OWNER) < _digit(OTHERS)),
        "secure": ~writable | ((_digit(GROUP) == 0) & (_digit(OTHERS) == 0)),
        "priv_esc": _bit(SPECIAL, 4) | _bit(SPECIAL, 2),
        "sticky": _bit(SPECIAL, 1),
    })


def link_class(root: Column) -> Column:
    return F.when(F.col("link_resolved").isNull(), "dangling").when((F.col("link_resolved") == root) | F.col("link_resolved").startswith(F.concat(root, F.lit("/"))), "internal").otherwise("external")


def package_root() -> Column:
    return F.concat(F.lit("/srv/"), F.col("package_id"))


def classify_symlinks(entries: DataFrame) -> DataFrame:
    return entries.filter("kind = 'link'").select("package_id", "path", "link_target", "link_resolved", link_class(package_root()).alias("link_class"))


def _exec_flag() -> Column:
    executable = reduce(lambda a, b: a | b, (_bit(d, 1) for d in (OTHERS, GROUP, OWNER)))
    return (F.col("kind") == "file") & executable & F.coalesce(extension(F.col("path")).isin(NO_EXEC_EXTENSIONS), F.lit(False))


def exec_on_data_files(entries: DataFrame) -> DataFrame:
    return entries.filter(_exec_flag()).select("package_id", "path", "mode", extension(F.col("path")).alias("ext"))


def _sensitive_flag() -> Column:
    name = F.lower(basename(F.col("path")))
    named = name.isin(SENSITIVE_NAMES) | F.coalesce(extension(F.col("path")).isin(SENSITIVE_EXTENSIONS), F.lit(False))
    return (F.col("kind") == "file") & named & (F.col("mode") % 100 > 0)


def exposed_secrets(entries: DataFrame) -> DataFrame:
    return entries.filter(_sensitive_flag()).select("package_id", "path", "mode")


def orphan_ownership(entries: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries, links aside, whose uid or gid is unknown. users (uid), groups (gid): lists of one host, broadcast by their size."""
    rows = entries.filter("kind <> 'link'").join(users.select("uid", F.lit(True).alias("known_user")), "uid", "left").join(groups.select("gid", F.lit(True).alias("known_group")), "gid", "left")
    return rows.filter("known_user is null or known_group is null").select("package_id", "path", "uid", "gid", F.col("known_user").isNull().alias("no_user"), F.col("known_group").isNull().alias("no_group"))


_ARTIFACT_PARENT = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in ARTIFACT_DIRS) + ")/"


def _artifact_flag() -> Column:
    name = basename(F.col("path"))
    directory = (F.col("kind") == "dir") & name.isin(ARTIFACT_DIRS)
    file = (F.col("kind") == "file") & (name.isin(ARTIFACT_FILES) | name.startswith("._"))
    return (directory | file) & ~F.col("path").rlike(_ARTIFACT_PARENT)


def deploy_artifacts(entries: DataFrame) -> DataFrame:
    """Version-control, editor and system remains; what lies in a reported directory isn't reported again."""
    return entries.filter(_artifact_flag()).select("package_id", "path", "kind")


def permission_findings(entries: DataFrame) -> DataFrame:
    """(package_id, path, mode, issue): one row for each entry and issue, in one pass."""
    link = F.col("kind") == "link"
    rows = entries.withColumn("link_class", F.when(link, link_class(package_root())))
    file, directory = F.col("kind") == "file", F.col("kind") == "dir"
    writable = reduce(lambda a, b: a | b, (_bit(d, 2) for d in (OTHERS, GROUP, OWNER)))
    secure = ~writable | ((_digit(GROUP) == 0) & (_digit(OTHERS) == 0))
    world, inverted, special = _bit(OTHERS, 2), (_digit(OWNER) < _digit(GROUP)) | (_digit(OWNER) < _digit(OTHERS)), _bit(SPECIAL, 4) | _bit(SPECIAL, 2)
    critical = [
        (file & world, "world_writable_file"), (directory & world & _bit(SPECIAL, 1), None), (directory & world & ~_bit(SPECIAL, 1), "sticky_missing"), (directory & world, "world_writable_dir"),
        (file & special, "privilege_escalation"), (~link & inverted, "inversion"), (F.col("link_class") == "external", "external_link"), (_sensitive_flag(), "sensitive_exposed"),
    ]
    other = [(F.col("link_class") == "internal", "internal_link"), (F.col("link_class") == "dangling", "dangling_link"), (_exec_flag(), "unneeded_exec"), (_artifact_flag(), "deploy_artifact")]
    any_critical = reduce(lambda a, b: a | b, (F.coalesce(test, F.lit(False)) for test, name in critical if name))
    hardened = ~link & secure & F.col("mode").isin(SECURE_MODES) & ~any_critical & ~_exec_flag()
    tests = [(t, n) for t, n in critical if n] + other + [(hardened, "secure_permissions")]
    found = rows.select("package_id", "path", "mode", F.explode(listed(*(F.when(t, F.lit(n)) for t, n in tests))).alias("issue"))
    vendor = F.col("path").rlike("(^|/)(vendor|node_modules)/")
    return found.withColumn("in_dependencies", vendor)


def permission_risk(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """For each of the `packages` (package_id, once or more): weighted score, issues, hardened entries and verdict; 0 and pass for a clean one.

    Links inside the package score but are no issue.
    """
    weights = small(findings.sparkSession, PERMISSION_WEIGHTS, "issue, weight, critical, counted")
    rows = findings.join(F.broadcast(weights), "issue").select("package_id", "issue", "in_dependencies", "weight", "critical", "counted").unionByName(packages.select("package_id"), allowMissingColumns=True)
    return rows.groupBy("package_id").agg(
        F.sum(F.coalesce("weight", F.lit(0))).cast("long").alias("risk_score"), F.count_if("counted").alias("issues"), F.count_if("critical").alias("critical_issues"),
        F.count_if((F.col("issue") == "secure_permissions") & ~F.col("in_dependencies")).alias("hardened"), F.count_if((F.col("issue") == "secure_permissions") & F.col("in_dependencies")).alias("hardened_dependencies"),
    ).withColumn("status", F.when(F.col("critical_issues") > 0, "fail").otherwise("pass"))


def permission_fix_plan(findings: DataFrame) -> DataFrame:
    """The mode that would mend each finding; a plan, applied by nobody here."""
    mode = F.col("mode")
    others, group, owner = mode % 10, F.floor(mode / 10) % 10, F.floor(mode / 100) % 10
    no_write = mode - F.when(others.bitwiseAND(F.lit(2)) > 0, 2).otherwise(0)
    odd = lambda d: d.cast("int") % 2
    no_exec = mode - odd(others) - 10 * odd(group) - 100 * odd(owner)
    proposed = (
        F.when(F.col("issue").isin("world_writable_file", "world_writable_dir"), no_write)
        .when(F.col("issue") == "sticky_missing", mode + 1000)
        .when(F.col("issue") == "sensitive_exposed", mode - mode % 100)
        .when(F.col("issue") == "unneeded_exec", no_exec)
    )
    return findings.withColumn("proposed", proposed.cast("int")).filter("proposed is not null").select("package_id", "path", "issue", "mode", "proposed")


def filescan_rollup(stats: DataFrame, permissions: DataFrame, content: DataFrame) -> DataFrame:
    """Per package: CLEAN, HIGH if anything is wrong, else ERROR if a scan is missing.

    stats (package_id, files), permissions (package_id, issues), content
    (package_id, total_issues), each with a row for every package that it scanned,
    clean ones too. So a missing row is a scan that didn't run or failed.
    """
    rows = stats.select("package_id", "files").join(permissions.select("package_id", "issues"), "package_id", "full").join(content.select("package_id", "total_issues"), "package_id", "full")
    wrong = (F.coalesce("issues", F.lit(0)) > 0) | (F.coalesce("total_issues", F.lit(0)) > 0)
    missing = F.col("files").isNull() | F.col("issues").isNull() | F.col("total_issues").isNull()
    return rows.withColumn("level", F.when(wrong, "HIGH").when(missing, "ERROR").otherwise("CLEAN"))
