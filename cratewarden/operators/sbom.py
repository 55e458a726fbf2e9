"""SBOM discovery, redaction and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packages import with_clean
from ..functions.text import basename
from ..refdata import CANDIDATE_PRIORITY, MANIFEST_TYPES, small
from ..sources.readers import CYCLONEDX, SPDX

HASH_VERSION = r"^([0-9a-fA-F]{32,}|(sha256|sha512|sha384|sha1|md5)[_:][0-9a-fA-F]{16,})$"


# --- discovery ---


def classify_manifest(files: DataFrame) -> DataFrame:
    name = basename(F.col("path"))
    known = small(files.sparkSession, list(MANIFEST_TYPES.items()), "base, known")
    rows = files.withColumn("base", name).join(F.broadcast(known), "base", "left")
    kind = F.coalesce("known", F.when(F.col("base").endswith(".podspec"), "cocoapods_podspec"), F.lit("unknown_manifest"))
    return rows.select(*files.columns, kind.alias("manifest_type"))


def find_sbom_candidates(files: DataFrame, max_depth: int = 8) -> DataFrame:
    """Adds candidate: `sbom` by name, else `manifest`; other files go. The name test for SBOMs comes first."""
    low = F.lower(basename(F.col("path")))
    rows = classify_manifest(files).filter(F.size(F.split("path", "/")) <= max_depth)
    kind = F.when(low.rlike("sbom|bom|spdx|cyclonedx|\\.cdx\\.json$"), "sbom").when(F.col("manifest_type") != "unknown_manifest", "manifest")
    return rows.withColumn("candidate", kind).filter("candidate is not null")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Adds rank within the package: shallow first, then by kind of name, then by path."""
    priority = F.lit(50)
    for ending, place in CANDIDATE_PRIORITY:
        priority = F.when(F.col("path").endswith(ending), place).otherwise(priority)
    rows = candidates.withColumns({"depth": F.size(F.split("path", "/")) - 1, "priority": priority})
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("package_id").orderBy("depth", "priority", "path")))


def validate_sboms(candidates: DataFrame) -> DataFrame:
    """candidates (package_id, path, content) -> valid, format, components and reason."""
    parsed = candidates.withColumns({"s": F.from_json("content", SPDX), "c": F.from_json("content", CYCLONEDX)})
    is_json = F.try_parse_json("content").isNotNull()
    form = F.when(F.col("s.spdxVersion").isNotNull(), "spdx").when(F.col("c.bomFormat") == "CycloneDX", "cyclonedx")
    count = F.when(form == "spdx", F.coalesce(F.array_size("s.packages"), F.lit(0))).when(form == "cyclonedx", F.coalesce(F.array_size("c.components"), F.lit(0)))
    reason = F.when(~is_json, "not JSON").when(form.isNull(), "neither SPDX nor CycloneDX")
    return parsed.select("package_id", "path", form.isNotNull().alias("valid"), form.alias("format"), count.alias("components"), reason.alias("reason"))


def discovery_status(candidates: DataFrame) -> DataFrame:
    """candidates (package_id, candidate, valid) -> one status for each package that has any row."""
    sbom = F.col("candidate") == "sbom"
    rows = candidates.groupBy("package_id").agg(F.count_if(sbom & F.col("valid")).alias("valid_sboms"), F.count_if(sbom & ~F.col("valid")).alias("invalid_sboms"), F.count_if(F.col("candidate") == "manifest").alias("manifests"))
    return rows.withColumn("status", F.when(F.col("valid_sboms") > 0, "sbom_found").when(F.col("invalid_sboms") > 0, "sbom_invalid").when(F.col("manifests") > 0, "manifests_only").otherwise("nothing_found"))


# --- redaction ---


def _path_name(c: Column) -> Column:
    return F.when(c.rlike(r"^(/|\./|\.\./)"), basename(c)).otherwise(c)


def _document_id(c: Column) -> Column:
    root = "SPDXRef-DocumentRoot-Directory-"
    return F.when(c.startswith(root), F.concat(F.lit(root), F.element_at(F.split(c, "-"), -1))).otherwise(c)


def redact_sbom_paths(sboms: DataFrame) -> DataFrame:
    """sboms (package_id, content) -> (package_id, document): JSON without the scanner's own paths.

    Only fields that hold paths change: names that begin as paths, file names,
    sourceInfo, document identifiers, all-zero hashes, bom-ref, locations of
    occurrences. Namespaced package names stay.
    """
    rows = sboms.withColumns({"s": F.from_json("content", SPDX), "c": F.from_json("content", CYCLONEDX)})
    info = lambda c: F.regexp_replace(c, r"""(?:/?\.\.?/|(?<=\s)/)[^\s"]+""", "[local cache]")
    package = lambda p: (
        p.withField("name", _path_name(p["name"])).withField("fileName", _path_name(p["fileName"])).withField("sourceInfo", info(p["sourceInfo"]))
        .withField("SPDXID", _document_id(p["SPDXID"])).withField("checksums", F.filter(p["checksums"], lambda h: ~F.coalesce(h["checksumValue"].rlike("^0+$"), F.lit(False))))
    )
    relation = lambda r: r.withField("spdxElementId", _document_id(r["spdxElementId"])).withField("relatedSpdxElement", _document_id(r["relatedSpdxElement"]))
    location = lambda o: o.withField("location", basename(o["location"]))
    component = lambda p: (
        p.withField("name", _path_name(p["name"])).withField("hashes", F.filter(p["hashes"], lambda h: ~F.coalesce(h["value"].rlike("^0+$"), F.lit(False))))
        .withField("evidence", F.when(p["evidence"].isNotNull(), p["evidence"].withField("occurrences", F.transform(p["evidence"]["occurrences"], location))))
    )
    s, c = F.col("s"), F.col("c")
    spdx = s.withField("name", _path_name(s["name"])).withField("packages", F.transform(s["packages"], package)).withField("relationships", F.transform(s["relationships"], relation))
    root = c["metadata"]["component"]
    reference = F.when(root["bom-ref"].rlike("^(dir|file):."), F.concat(F.lit("scanner:"), basename(F.regexp_replace(root["bom-ref"], "^(dir|file):", "")))).otherwise(root["bom-ref"])
    metadata = F.when(root.isNotNull(), c["metadata"].withField("component", root.withField("name", _path_name(root["name"])).withField("`bom-ref`", reference)))
    cyclone = c.withField("metadata", metadata).withField("components", F.transform(c["components"], component))
    return rows.select("package_id", F.when(s["spdxVersion"].isNotNull(), F.to_json(spdx)).when(c["bomFormat"].isNotNull(), F.to_json(cyclone)).alias("document"))


def resolve_root_version(sboms: DataFrame) -> DataFrame:
    """The root's version: CycloneDX metadata, else the first described SPDX package; digests are no versions."""
    rows = sboms.withColumns({"s": F.from_json("content", SPDX), "c": F.from_json("content", CYCLONEDX)})
    good = lambda v: F.when((v != "") & ~v.rlike(HASH_VERSION), v)
    root = F.get("s.documentDescribes", F.lit(0))
    described = F.get(F.filter("s.packages", lambda p: p["SPDXID"] == root), F.lit(0))["versionInfo"]
    return rows.select("package_id", F.coalesce(good(F.col("c.metadata.component.version")), good(described)).alias("version"))


# --- comparison ---


def _one_version(components: DataFrame, version: str) -> DataFrame:
    return components.groupBy("package_id", "name").agg(F.min("version").alias(version), F.max("is_root").alias(f"{version}_root"), F.min("purl").alias(f"{version}_purl"))


def diff_packages(a: DataFrame, b: DataFrame) -> DataFrame:
    """(package_id, name, version_a, version_b, change): only_a, only_b, changed or same; the smallest version of a name counts.

    One exchange for each side, on the join's own keys.
    """
    both = _one_version(a, "version_a").join(_one_version(b, "version_b"), ["package_id", "name"], "full")
    change = F.when(F.col("version_b").isNull(), "only_a").when(F.col("version_a").isNull(), "only_b").when(F.col("version_a") == F.col("version_b"), "same").otherwise("changed")
    is_root = F.coalesce("version_a_root", F.lit(False)) | F.coalesce("version_b_root", F.lit(False))
    return both.select("package_id", "name", "version_a", "version_b", change.alias("change"), is_root.alias("is_root"), F.coalesce("version_a_purl", "version_b_purl").alias("purl"))


def _names(df: DataFrame) -> DataFrame:
    return df.select("package_id", "name").distinct()


def sbom_added(a: DataFrame, b: DataFrame) -> DataFrame:
    return _names(a).join(_names(b), ["package_id", "name"], "left_anti")


def sbom_removed(a: DataFrame, b: DataFrame) -> DataFrame:
    return sbom_added(b, a)


def sbom_common(a: DataFrame, b: DataFrame) -> DataFrame:
    return _names(a).join(_names(b), ["package_id", "name"], "left_semi")


def label_diff(diff: DataFrame, mode: str = "sbom", manifest_only: bool = False) -> DataFrame:
    """Rows of a difference that count in a mode, with their label and note.

    sbom: the root is left out; added, removed, changed. manifest (b is the
    manifest): the root stays; sbom_only and changed, and manifest_only if asked.
    """
    change = F.col("change")
    if mode == "sbom":
        label = F.when(change == "only_a", "added").when(change == "only_b", "removed").when(change == "changed", "changed")
        return diff.filter("not is_root").withColumns({"label": label, "note": F.lit(None).cast("string")}).filter("label is not null")
    label = F.when(change == "only_a", "sbom_only").when(change == "changed", "changed")
    if manifest_only:
        label = label.when(change == "only_b", "manifest_only")
    note = F.when((change == "only_a") & F.col("purl").startswith("pkg:wordpress/"), "platform package, not expected in a manifest")
    return diff.withColumns({"label": label, "note": note}).filter("label is not null")


def diff_summary(labelled: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Per package: differences by label and in all; 0 for those of `packages` whose sides agree."""
    labels = ["added", "removed", "changed", "sbom_only", "manifest_only"]
    rows = with_clean(labelled.select("package_id", "label"), packages)
    return rows.groupBy("package_id").agg(*(F.count_if(F.col("label") == x).alias(x) for x in labels), F.count("label").alias("total"))


def risk_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b (package_id, risk) -> how a's risk differs from b's; null where either is absent."""
    rows = a.select("package_id", F.col("risk").alias("risk_a")).join(b.select("package_id", F.col("risk").alias("risk_b")), "package_id", "full")
    delta = F.round(F.col("risk_a") - F.col("risk_b"), 2)
    return rows.withColumn("delta", delta).withColumn("direction", F.when(delta > 0, "increased").when(delta < 0, "decreased").when(delta == 0, "unchanged"))
