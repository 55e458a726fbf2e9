"""The graph that an SBOM's relationships make, and several SBOMs of a package held against each other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import SPDX
from ..sources.shared import cut, new_path

#: Relationships that lead from what depends to what it depends on, and those that lead back.
FORWARD = ("DEPENDS_ON", "CONTAINS", "DESCRIBES", "HAS_PREREQUISITE")
BACKWARD = ("DEPENDENCY_OF", "CONTAINED_BY", "DESCRIBED_BY", "PREREQUISITE_FOR", "RUNTIME_DEPENDENCY_OF", "BUILD_DEPENDENCY_OF", "DEV_DEPENDENCY_OF")
KEY = ["package_id", "sbom_id"]
#: Components and edges of an SBOM that one task walks in one go.
MOST = 1 << 16


def read_relationships(df: DataFrame) -> DataFrame:
    """df (package_id, sbom_id, content) -> (package_id, sbom_id, source, target) of SPDX documents, each from what depends to what it depends on."""
    rows = df.select(*KEY, F.explode(F.from_json("content", SPDX)["relationships"]).alias("r"))
    one, other, kind = F.col("r.spdxElementId"), F.col("r.relatedSpdxElement"), F.col("r.relationshipType")
    back = kind.isin(*BACKWARD)
    return rows.filter(kind.isin(*FORWARD, *BACKWARD)).select(*KEY, F.when(back, other).otherwise(one).alias("source"), F.when(back, one).otherwise(other).alias("target")).filter("source is not null and target is not null").distinct()


def component_depths(components: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """components (package_id, sbom_id, spdxid, is_root), edges (package_id, sbom_id, source, target) -> (package_id, sbom_id, spdxid, depth, reach).

    depth is the length of the shortest way from any root of the SBOM; reach is
    root (0), direct (1), transitive (more) or unreachable (null). Cycles
    are no matter. Edges to nodes that aren't components lead on all the same.

    An SBOM of up to `most` components and edges is one row, walked by one task in one go, so that its
    rows are shuffled once. Larger ones are walked in rounds, by `_depths_in_rounds`.
    """
    nodes = components.select(*KEY, F.col("spdxid").alias("node"), "is_root").filter("node is not null")
    links = edges.select(*KEY, F.col("source").alias("node"), "target").filter("node is not null and target is not null")
    rows = nodes.withColumn("target", F.lit(None).cast(links.schema["target"].dataType)).unionByName(links, allowMissingColumns=True)
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most)
    large = cut(sizes.filter("package_id is not null and sbom_id is not null").select(*KEY), "sbom-large")
    if large.isEmpty():
        found = _depths_at_once(rows)
    else:
        found = _depths_at_once(rows.join(large.hint("merge"), KEY, "left_anti"))
        of = lambda df: df.join(large.hint("merge"), KEY, "left_semi")
        found = found.unionByName(_depths_in_rounds(of(nodes), of(links)))
    kind = F.when(F.col("depth").isNull(), "unreachable").when(F.col("depth") == 0, "root").when(F.col("depth") == 1, "direct").otherwise("transitive")
    return found.select(*KEY, F.col("node").alias("spdxid"), "depth", kind.alias("reach"))


def _walked(nodes: list[str], roots: list[str], links: list[dict]) -> list[int | None]:
    """The depth of each node of one SBOM."""
    ways: dict[str, list[str]] = {}
    for link in links:
        ways.setdefault(link["node"], []).append(link["target"])
    depth = dict.fromkeys(roots, 0)
    frontier = list(depth)
    while frontier:
        reached = {t: depth[n] + 1 for n in frontier for t in ways.get(n, ()) if t not in depth}
        depth |= reached
        frontier = list(reached)
    return [depth.get(n) for n in nodes]


def _depths_at_once(rows: DataFrame) -> DataFrame:
    """rows (package_id, sbom_id, node, is_root, target), of nodes without a target and of edges -> (package_id, sbom_id, node, depth). A null key links nothing, as in a join."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                package, sbom, nodes, roots, links = (c.to_pylist() for c in part.columns)
                keyed = [p is not None and s is not None for p, s in zip(package, sbom, strict=True)]
                depths = [_walked(n, r, e) if k else [None] * len(n) for n, r, e, k in zip(nodes, roots, links, keyed, strict=True)]
                own = pa.array([k for k, n in enumerate(nodes) for _ in n], pa.int32())
                flat = [pa.array([x for one in column for x in one], kind) for column, kind in ((nodes, pa.string()), (depths, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), *flat], [*KEY, "node", "depth"])

    is_node, link = F.col("target").isNull(), F.struct("node", "target")
    lists = rows.groupBy(*KEY).agg(F.collect_set(F.when(is_node, F.col("node"))).alias("nodes"), F.collect_set(F.when(is_node & F.col("is_root"), F.col("node"))).alias("roots"), F.collect_list(F.when(~is_node, link)).alias("links"))
    return lists.filter(F.size("nodes") > 0).mapInArrow(task, "package_id string, sbom_id string, node string, depth int")


def _depths_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (package_id, sbom_id, node, is_root), edges (package_id, sbom_id, node, target) -> (package_id, sbom_id, node, depth).

    One round for each depth: the frontier is joined with the edges, and what
    was reached before is left out. Every frontier is one more folder of one table, so the
    plan of a round doesn't grow, and a lost executor costs its tasks only. Files of few bytes
    hold very many nodes, so no join here is a broadcast.
    """
    spark, path = nodes.sparkSession, new_path(nodes.sparkSession, "sbom-depths")
    frontier, depth = nodes.filter("is_root").select(*KEY, "node").distinct(), 0
    links = cut(edges.distinct(), "sbom-edges")
    schema = frontier.schema
    while True:
        frontier.write.parquet(f"{path}/depth={depth}")
        last = spark.read.schema(schema).parquet(f"{path}/depth={depth}")
        if last.isEmpty():
            break
        reached = spark.read.schema(schema).parquet(*(f"{path}/depth={d}" for d in range(depth + 1)))
        frontier = last.hint("merge").join(links, [*KEY, "node"]).select(*KEY, F.col("target").alias("node")).distinct().join(reached.hint("merge"), [*KEY, "node"], "left_anti")
        depth += 1
    found = spark.read.option("basePath", path).schema(T.StructType([*schema.fields, T.StructField("depth", T.IntegerType())])).parquet(path)
    return nodes.select(*KEY, "node").distinct().join(found.hint("merge"), [*KEY, "node"], "left").select(*KEY, "node", "depth")


def reconcile_sboms(**sources: DataFrame) -> DataFrame:
    """Components (package_id, name, version) by up to 63 sources -> (package_id, name, version, sources, held, versions, verdict), a row for each name and version that any source lists.

    sources is a bit set, in the order given; held is how many of those
    sources that know the package at all list it; verdict is agreed if they all
    do, else majority, tied or minority. versions is how many versions of the name are listed in
    the package. A missing version is one of its own.
    """
    rows = None
    for k, part in enumerate(sources.values()):
        own = part.select("package_id", "name", "version", F.lit(1 << k).cast("long").alias("bit"))
        rows = own if rows is None else rows.unionByName(own)
    each = rows.groupBy("package_id", "name", "version").agg(F.bit_or("bit").alias("sources"))
    names = each.groupBy("package_id", "name").agg(F.count(F.lit(1)).alias("versions"))
    known = each.groupBy("package_id").agg(F.bit_count(F.bit_or("sources")).alias("known"))
    same = each.join(names.withColumnRenamed("package_id", "p").withColumnRenamed("name", "m"), F.col("package_id").eqNullSafe(F.col("p")) & F.col("name").eqNullSafe(F.col("m"))).drop("p", "m")
    both = same.join(known.withColumnRenamed("package_id", "p"), F.col("package_id").eqNullSafe(F.col("p"))).drop("p")
    held = F.bit_count("sources")
    verdict = F.when(held == F.col("known"), "agreed").when(2 * held > F.col("known"), "majority").when(2 * held == F.col("known"), "tied").otherwise("minority")
    return both.select("package_id", "name", "version", "sources", held.cast("int").alias("held"), "versions", verdict.alias("verdict"))
