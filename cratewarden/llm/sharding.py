"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Keys (texts) sit on a ring of 2 ** CELL_BITS cells; every shard owns
`virtual_nodes` points on it, at places that depend on the shard alone, and a
key belongs to the first point clockwise. A shard has room for the mean. What it
can't hold goes on clockwise to the next point of a shard with room, round by
round: in each round all that still wait are offered to the first open point,
shards take them in order of priority until they are full, and a full shard's
points leave the ring. When no more than `slack` times the room waits in all,
it stays where it arrives, so no shard exceeds (1 + slack) times the mean by more
than one key. Nothing else moves: a new shard takes its own arcs, and beside
them only keys that were or become overflow change places.

Priority. Large keys (over 1 / LARGE of all bytes) first, so that what a shard
takes last is small and it ends near its room; then by hash. A key that would
exceed the room by more than half of itself goes on. Where that closes every
shard, those that are under their room take the rest, each until it has reached
it; as the rooms hold all bytes together, nothing is left over.

Scale. The ring is planned on at most 2 ** CELL_BITS * (1 + 2 / heavy)
pre-aggregated buckets, whatever the input: a cell that holds over `heavy` times
the mean is salted by row into as many buckets as it needs, and the buckets of one
with over 1 / SPREAD of all have places of their own on the ring. A text that is
a third of all rows so becomes thousands of even buckets all around, also where
its rows share a doc_id. A round handles buckets alone, and most are placed in
the first. The plan is broadcast, being small by that bound. Rows are shuffled
once, without their text, to number the slots inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits of the ring position; 2 ** CELL_BITS cells.
CELL_BITS = 17
#: A bucket over 1 / LARGE of all bytes is placed before others; a cell over 1 / SPREAD of all is spread over the ring.
LARGE, SPREAD = 8192, 1024


def text_size(text):
    """UTF-8 bytes of a text, none for null, plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def cell_of(*key):
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - CELL_BITS).cast("int")


def ring_points(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """(shard, at): one row for each virtual node. More shards add points and move none."""
    node = spark.range(shards * virtual_nodes, numPartitions=1)
    shard, replica = (F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards)
    return node.select(shard.alias("shard"), cell_of(F.lit("node"), shard, replica).alias("at"))


def offer(waiting: DataFrame, points: DataFrame, loads: list[int], room: float, rule: str) -> DataFrame:
    """waiting (cell, sub, at, bytes, n, big, luck) -> also shard, that of the first point clockwise, and whether it is taken.

    rule: `half` takes what exceeds the room by half of itself at most, `under` what comes while the room isn't reached, `all` everything.
    """
    turned = points.unionByName(points.select("shard", (F.col("at") + (1 << CELL_BITS)).alias("at")))
    mixed = waiting.withColumns({"point": F.lit(0), "shard": F.lit(None).cast("int")}).unionByName(turned.withColumn("point", F.lit(1)), allowMissingColumns=True)
    # read against the clock, the last point seen is the first one clockwise
    back = Window.orderBy(F.col("at").desc(), F.col("point").desc(), F.col("shard").desc(), "cell", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = mixed.withColumn("shard", F.last("shard", ignorenulls=True).over(back)).filter("point = 0").drop("point")
    turn = Window.partitionBy("shard").orderBy(F.col("big").desc(), "luck", "cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    load = F.element_at(F.lit(loads), F.col("shard") + 1) + F.coalesce(F.sum("bytes").over(turn), F.lit(0))
    fits = {"half": (load + F.col("bytes") / 2 < room) | (load == 0), "under": load < room, "all": F.lit(True)}
    return met.withColumn("taken", fits[rule])


def plan_ring(buckets: DataFrame, shards: int, virtual_nodes: int, slack: float) -> DataFrame:
    """buckets (cell, sub, at, bytes, n) -> (cell, sub, shard, first): the shard of each bucket, and its first slot there."""
    spark = buckets.sparkSession
    total = buckets.agg(F.sum("bytes")).first()[0] or 0
    room = total / shards
    points = ring_points(spark, shards, virtual_nodes)
    large = F.when(F.col("bytes") * LARGE > total, F.col("bytes")).otherwise(F.lit(0))
    waiting = buckets.withColumns({"big": large, "luck": F.xxhash64(F.lit("luck"), "cell", "sub")})
    loads, ring, rule, placed = [0] * shards, set(range(shards)), "half", None
    while True:
        if total - sum(loads) <= slack * room:
            rule = "all"
        met = cut(offer(waiting, points.filter(F.col("shard").isin(sorted(ring))), loads, room, rule), "shard-round")
        taken = met.filter("taken").select("cell", "sub", "n", "shard")
        placed = taken if placed is None else placed.unionByName(taken)
        answers = met.groupBy("shard").agg(F.sum(F.when(F.col("taken"), F.col("bytes")).otherwise(0)), F.count_if(~F.col("taken"))).collect()  # a row for each shard
        for shard, held, refused in answers:
            loads[shard] += held
            if refused:
                ring.discard(shard)
        if not any(refused for *_, refused in answers):
            break
        waiting = met.filter("not taken").drop("shard", "taken")
        if not ring:
            ring, rule = {s for s in range(shards) if loads[s] < room}, "under"
    slots = Window.partitionBy("shard").orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("cell", "sub", "shard", F.coalesce(F.sum("n").over(slots), F.lit(0)).alias("first"))


def with_bucket(rows: DataFrame, heavy: int) -> DataFrame:
    """rows (cell, size, salt) with `sub` and the place `at` instead of the salt: rows of one cell and sub go to one shard together."""
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.greatest(F.col("n") / F.sum("n").over(every), F.col("bytes") / F.sum("bytes").over(every))
    fan = cells.select("cell", F.ceil(share * F.lit((1 << CELL_BITS) / heavy)).cast("long").alias("fan"), (share * SPREAD > 1).alias("hot"))
    rows = rows.join(F.broadcast(fan), "cell").withColumn("sub", F.pmod("salt", "fan"))
    return rows.withColumn("at", F.when(F.col("hot"), cell_of(F.lit("spread"), F.col("cell"), F.col("sub"))).otherwise(F.col("cell"))).drop("salt", "fan", "hot")


def shard_documents(docs: DataFrame, *, shards: int = 24, virtual_nodes: int = 512, slack: float = 0.005, heavy: int = 4) -> DataFrame:
    """Place every row of `docs` (doc_id, text): (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    Sizes are near equal between shards (law `bytes`); grown_shard is null
    under that law. Equal texts share a place on the ring, so they share a
    shard unless its bound parts them or they are a visible part of the table. Null texts are empty; null doc_ids and
    repeated rows are rows like any others, and rows that are equal in all are
    told apart by where they stand in the table; an empty table gives no rows;
    other columns are ignored.
    """
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    narrow = docs.select(
        doc_id.alias("doc_id"), text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), cell_of(F.lit("key"), text).alias("cell"),
        F.xxhash64(F.lit("salt"), doc_id, F.monotonically_increasing_id()).alias("salt"),
    )
    rows = with_bucket(cut(narrow, "shard-rows"), heavy)
    buckets = cut(rows.groupBy("cell", "sub", "at").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-buckets")
    plan = plan_ring(buckets, shards, virtual_nodes, slack)
    inside = Window.partitionBy("cell", "sub").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(plan), ["cell", "sub"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
