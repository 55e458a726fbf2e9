"""Leftmost, non-overlapping matches of patterns with their places, in built-in functions only.

Time is linear in the text, and with very many matches, some hundred thousand, a little
more, as blocks of them are folded one after the other.

Each step is a column of its own, since what a lambda looks into must be
computed once for a row, not once for an entry. The optimizer moves a column
that is named only once into the place where it is named, so such columns are
named a second time, in a test of their size that always holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points kept on either side of a match.
CONTEXT = 24
SPAN = "array<struct<start:int,stop:int,text:string,before:string,after:string>>"
#: Entries that a running fold passes over one by one.
BLOCK = 128


def indices(array: Column, step: int = 1) -> Column:
    """0 to the array's size less 1."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def with_running(rows: DataFrame, name: str, lists: str, zero: int, op: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds `name`: for each list of ints in the column `lists`, and each entry of it, the fold of all entries before.

    `op` is associative, with `zero` as its neutral element. Folds of whole
    blocks are folded first, so an entry costs at most BLOCK steps more, and
    nothing is copied.
    """
    blocks, base = f"{name}_blocks", f"{name}_base"

    def fold(array: Column, low: Column, high: Column) -> Column:
        return F.when(low >= high, F.lit(zero)).otherwise(F.aggregate(F.sequence(low, high - 1), F.lit(zero), lambda acc, i: op(acc, F.get(array, i))))

    rows = rows.withColumn(blocks, F.transform(lists, lambda a: F.transform(indices(a, BLOCK), lambda i: fold(a, i, F.least(i + BLOCK, F.size(a))))))
    rows = rows.withColumn(base, F.transform(blocks, lambda b: F.transform(indices(b), lambda i: fold(b, F.lit(0), i))))
    entry = lambda a, p, i: op(F.get(F.get(base, p), (i / BLOCK).cast("int")), fold(a, i - i % BLOCK, i))
    made = F.when(F.size(base) >= 0, F.transform(lists, lambda a, p: F.transform(indices(a), lambda i: entry(a, p, i))))
    return rows.withColumn(name, made).drop(blocks, base)


def with_spans(rows: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds a column of spans in `text` for each name -> (pattern, guard): code points, end exclusive, with the text around up to the next match.

    `guard` is a cheap test that every text with a match passes.
    """
    none = F.array().cast("array<string>")
    for k, (pattern, guard) in enumerate(patterns.values()):
        rows = rows.withColumn(f"found{k}", F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        # gap i lies before match i
        rows = rows.withColumn(f"gaps{k}", F.when(F.size(f"found{k}") > 0, F.split("text", pattern)).otherwise(none))
    every = range(len(patterns))
    lengths = lambda k: F.transform(f"found{k}", lambda f, i: F.length(f) + F.length(F.get(f"gaps{k}", i)))
    rows = rows.withColumn("lengths", F.array(*map(lengths, every)))
    rows = with_running(rows, "at", "lengths", 0, lambda a, b: a + b)

    def spans(k: int) -> Column:
        start = lambda i: F.get(F.get("at", F.lit(k)), i) + F.length(F.get(f"gaps{k}", i))
        span = lambda f, i: F.struct(
            start(i).cast("int").alias("start"), (start(i) + F.length(f)).cast("int").alias("stop"), f.alias("text"),
            F.right(F.get(f"gaps{k}", i), F.lit(CONTEXT)).alias("before"), F.substring(F.get(f"gaps{k}", i + 1), 1, CONTEXT).alias("after"),
        )
        return F.transform(f"found{k}", span)

    return rows.withColumns({name: spans(k) for k, name in enumerate(patterns)}).drop("at", "lengths", *(f"{c}{k}" for k in every for c in ("found", "gaps")))


def as_text(kind: str | Column, span: Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, span["start"].cast("string"), span["stop"].cast("string"))


def free_of(rows: DataFrame, wanted: str, others: str) -> DataFrame:
    """`rows` with, of the structs (start, stop, ...) in `wanted`, those alone that overlap none in `others`, by place.

    Both are merged in order of their starts: a span is free if no other one
    before it ends behind its start, and the next other one begins at its end
    or later.
    """
    line = F.concat(
        F.transform(wanted, lambda s, k: F.struct(s["start"].alias("start"), k.alias("own"), s["stop"].alias("stop"))),
        F.transform(others, lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("own"), s["stop"].alias("stop"))),
    )
    rows = rows.withColumn("line", F.when(F.size(wanted) > 0, F.array_sort(line)).otherwise(F.slice(line, 1, 0)))
    # the ends of others before, and, read from behind, how far before 0 the next ones begin
    ends, begins = F.transform("line", lambda x: F.when(x["own"] < 0, x["stop"]).otherwise(-(2**31) + 1)), F.reverse(F.transform("line", lambda x: F.when(x["own"] < 0, -x["start"]).otherwise(-(2**31) + 1)))
    rows = with_running(rows.withColumn("edges", F.array(ends, begins)), "met", "edges", -(2**31) + 1, F.greatest)
    free = lambda x, i: (x["own"] >= 0) & (F.get(F.get("met", F.lit(0)), i) <= x["start"]) & (-F.get(F.get("met", F.lit(1)), F.size("line") - 1 - i) >= x["stop"])
    rows = rows.withColumn("line", F.filter("line", free))
    return rows.withColumn(wanted, F.when(F.size("line") < F.size(wanted), F.transform("line", lambda x: F.get(wanted, x["own"]))).otherwise(F.col(wanted))).drop("line", "edges", "met")


def merged(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with structs (kind, start, stop, score) in `name` that overlap in a row made one: their whole place, kind and score of the best."""
    rows = rows.withColumn(name, F.array_sort(F.transform(name, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["score"].alias("score"), x["kind"].alias("kind")))))
    rows = with_running(rows.withColumn("ends", F.array(F.transform(name, lambda x: x["stop"]))), "met", "ends", -1, F.greatest)
    rows = rows.withColumn("firsts", F.when(F.size("met") == 1, F.filter(indices(F.col(name)), lambda i: F.get(F.get("met", F.lit(0)), i) <= F.get(name, i)["start"])))

    def one(low: Column, k: Column) -> Column:
        parts = F.transform(F.sequence(low, F.coalesce(F.get("firsts", k + 1), F.size(name)) - 1), lambda i: F.get(name, i))
        best = F.array_max(F.transform(parts, lambda x: F.struct(x["score"], x["kind"])))
        return F.struct(best["kind"].alias("kind"), F.get(name, low)["start"].alias("start"), F.array_max(F.transform(parts, lambda x: x["stop"])).alias("stop"), best["score"].alias("score"))

    return rows.withColumn(name, F.when(F.size("firsts") >= 0, F.transform("firsts", one))).drop("ends", "met", "firsts")
