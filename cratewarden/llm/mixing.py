"""Mixing sources to target weights by a time-varying curriculum.

Targets. Sources in code point order, null last, weigh 1, 2, 3 in turn and
share all words; a source can give `max_epochs` times its own words at most,
and what is over goes to the others by weight. That fixed point is found in
one pass over the source table sorted by cap per weight.

Curriculum. The weight of a source at time t in [0, 1] is its target times
1 + ramp * (2t - 1). Its integral, t + ramp * (t^2 - t), is the share of the
source's words that are due by t. Inverting it turns a copy's place in its
source's stream of words into a training position, and the mix is range-sorted
by that position.

Scale. The stream of a source is in order of a hash of doc_id, source and text,
so its prefix sums are taken in two levels: sums per (source, cell of the hash),
at most sources * 4096 rows, and a window inside each cell. A source that holds a
third of all rows is spread over all cells, also where doc_ids are null or
repeated. Rows that are equal in all three and so many that they fill a cell
(over HOT of them, and 1 / 4096 of the table) stand at the head of their cell, in
parts by their place in the table. The table of sources, a row for each, is
ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch_name, word_count

#: Hex digits of the hash that name a cell: 4096 cells for each source.
CELL_DIGITS = 3
#: Equal rows beyond which they are parted.
HOT = 1000
#: Slope of the weight over time, by the source's weight class 1, 2, 3.
RAMPS = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, *, max_epochs: int = 3, classes: int = 3) -> DataFrame:
    """sizes (source, source_size) -> also weight and target (double). One row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % classes + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weights", F.sum("weight").over(every))
    )
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("rank", F.row_number().over(by_need))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("water", F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("rank"))).over(every))
    )
    return ranked.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def due_at(share: Column, ramp: Column) -> Column:
    """The time at which `share` of a source's words is due: the root of t + ramp * (t^2 - t) = share in [0, 1]."""
    linear = 1 - ramp
    return F.when(share <= 0, F.lit(0.0)).otherwise(2 * share / (linear + F.sqrt(linear * linear + 4 * ramp * share)))


def stream_hash() -> Column:
    """A row's place in the stream of its source."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), F.coalesce(F.col("source"), F.lit("")), F.lit("/"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))


def with_cell(rows: DataFrame, key: str, order: str, cell: str, size: str) -> tuple[DataFrame, DataFrame]:
    """`rows` with the cell, digits of the order and behind them `~` or, for one of very many equal rows, its order and part; and (key, cell, cell_size)."""
    digits = F.substring(order, 1, CELL_DIGITS)
    counts = cut(rows.groupBy(key, digits.alias(cell)).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("cell_size")), "mix-counts")
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(HOT, (total or 0) >> (4 * CELL_DIGITS))
    hot = []
    if (most or 0) > least:
        many = rows.groupBy(key, order).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
        hot = [(f"{r[0]}\n{r[1]}", -(-r[2] // least)) for r in many.collect()]  # 4096 rows at most
    if not hot:
        return rows.withColumn(cell, F.concat(digits, F.lit("~"))), counts.select(key, F.concat(cell, F.lit("~")).alias(cell), "cell_size")
    parts = F.element_at(F.map_from_arrays(F.lit([k for k, _ in hot]), F.lit([n for _, n in hot])), F.concat(F.col(key), F.lit("\n"), F.col(order)))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts)
    rows = rows.withColumn(cell, F.concat(digits, F.coalesce(F.concat(F.col(order), F.lit("/"), F.lpad(part.cast("string"), 10, "0")), F.lit("~"))))
    return rows, rows.groupBy(key, cell).agg(F.sum(size).alias("cell_size"))


def plan_mix(docs: DataFrame, *, size: str, hashed: str | None = None, max_epochs: int = 3, ramps: tuple[float, ...] = RAMPS) -> DataFrame:
    """`docs` with source_size, target, copies and offset (words of its source before it), under names that it doesn't have.

    Returns (frame, names). Rows need doc_id, source and `size`, and text or its
    stream hash in the column `hashed`, which is dropped. A document is
    taken once for each whole epoch that its source gives, and once more if the
    middle of it lies before the end of the last, begun epoch.
    """
    name = {k: scratch_name(docs, k) for k in ("key", "order", "cell", "source_size", "target", "weight", "offset", "copies", "cell_offset")}
    key, cell, order = name["key"], name["cell"], name["order"]
    # a source's key is never null and never one that a real source has
    rows = docs.withColumns({key: F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), order: F.col(hashed) if hashed else stream_hash()}).drop(*([hashed] if hashed else []))
    rows, cells = with_cell(rows, key, order, cell, size)
    up_to = Window.partitionBy(key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cut(cells.withColumn(name["cell_offset"], F.coalesce(F.sum("cell_size").over(up_to), F.lit(0))), "mix-cells")
    sources = cells.groupBy(key).agg(F.sum("cell_size").alias("source_size")).withColumn("source", F.when(F.col(key) != "", F.expr(f"substring(`{key}`, 2)")))
    targets = source_targets(sources, max_epochs=max_epochs).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias(key), F.col("source_size").alias(name["source_size"]), F.col("target").alias(name["target"]), F.col("weight").alias(name["weight"])
    )
    plan = cells.drop("cell_size").join(targets, key)
    inside = Window.partitionBy(key, cell).orderBy(name["order"], size).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name["offset"], F.coalesce(F.sum(size).over(inside), F.lit(0))).join(plan, [key, cell])
    rows = rows.withColumn(name["offset"], F.col(name["offset"]) + F.col(name["cell_offset"]))
    whole = F.when(F.col(name["source_size"]) > 0, F.floor(F.col(name["target"]) / F.col(name["source_size"]))).otherwise(F.lit(0))
    rest = F.col(name["target"]) - whole * F.col(name["source_size"])
    rows = rows.withColumn(name["copies"], (whole + F.when(F.col(name["offset"]) + F.col(size) / 2 < rest, 1).otherwise(0)).cast("int"))
    return rows.drop(key, cell, name["order"], name["cell_offset"]), name


def position(name: dict[str, str], epoch: Column, ramps: tuple[float, ...] = RAMPS) -> Column:
    """The training position in [0, 1] of the `epoch`-th copy (from 0) of a planned row."""
    share = F.when(F.col(name["target"]) > 0, (F.col(name["offset"]) + epoch * F.col(name["source_size"])) / F.col(name["target"])).otherwise(F.lit(0.0))
    return due_at(F.least(share, F.lit(1.0)), F.element_at(F.array(*map(F.lit, ramps)), F.col(name["weight"]).cast("int")))


def mix_documents(docs: DataFrame, *, max_epochs: int = 3) -> DataFrame:
    """The mix itself: every column of `docs`, a row for each copy, range-sorted by training position.

    Null texts have no words; documents without words are taken as often as
    any at their place; null sources are a source of their own, the last; an
    empty table gives an empty mix; rows that are equal in all are told apart
    only by the order in which they stand.
    """
    size, epoch, at = scratch_name(docs, "size"), scratch_name(docs, "epoch"), scratch_name(docs, "position")
    planned, name = plan_mix(docs.withColumn(size, word_count(F.col("text"))), size=size, max_epochs=max_epochs)
    copies = planned.filter(F.col(name["copies"]) > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(name["copies"]) - 1)))
    placed = copies.withColumn(at, position(name, F.col(epoch)))
    return placed.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").select(*docs.columns)


def mix_report(docs: DataFrame) -> DataFrame:
    """One row for each document, in training order: (doc_id, size, source_size, target, taken, copies, first_position)."""
    narrow = cut(docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), stream_hash().alias("hash")), "mix-rows")
    planned, name = plan_mix(narrow, size="size", hashed="hash")
    rows = planned.select(
        "doc_id", "size", F.col(name["source_size"]).alias("source_size"), F.col(name["target"]).alias("target"),
        (F.col("size") * F.col(name["copies"])).cast("long").alias("taken"), F.col(name["copies"]).alias("copies"),
        F.when(F.col(name["copies"]) > 0, F.round(position(name, F.lit(0)), 9)).alias("first_position"),
    )
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
