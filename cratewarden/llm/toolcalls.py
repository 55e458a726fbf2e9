"""Tool-call linking: calls meet results by identifier, in dependency order, as canonical JSON.

Calls and results are hash-joined on (conversation, call id). A call's level is
its longest chain of dependencies. A conversation is put in topological order by the task that has it, in one go
whatever its depth; one of more than TASK_CALLS calls and dependencies, in rounds over
(conversation, call id): each round places the calls that wait for none, and an edge to a call that waits for
one other alone jumps over it, so chains halve. Arguments are validated against
the tool's schema, and each event is serialised as JSON with sorted keys and no
spaces.

Scale. Every other join and aggregate is keyed by (conversation, call id), so a
conversation that holds a third of all events is spread like any other; no
conversation beyond TASK_CALLS is gathered anywhere, and (level, turn, call_id) orders its rows.
Rounds touch only calls that wait, and are written to the shared folder; their
number grows with the logarithm of the longest chain, and with the depth of calls
that wait for several others at once, in such large conversations alone. There is no cap on rounds: they end when
nothing changes, which is also how cycles are found.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

KEY = ["conv_id", "call_id"]
#: Calls and dependencies of a conversation that a task holds, some tens of MB.
TASK_CALLS = 1 << 16

#: The tools that `derive_events` uses. Properties: name -> (JSON type, whether required).
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "calculate": {"expression": ("string", True), "precision": ("integer", False)},
    "fetch": {"url": ("string", True), "timeout": ("number", False)},
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "translate": {"text": ("string", True), "target": ("string", True), "formal": ("boolean", False)},
}

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


def _strict(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key occurs twice")
    return dict(pairs)


def _no_constant(text: str) -> float:
    raise ValueError(f"{text} is no JSON number")


def _number(text: str) -> float:
    if not math.isfinite(value := float(text)):
        raise ValueError("number out of range")
    return value


def validate(name: str | None, arguments: str | None, schemas: dict[str, dict[str, tuple[str, bool]]]) -> tuple[object, list[str]]:
    """(parsed arguments or None, what is wrong with them)."""
    try:
        parsed = json.loads(arguments or "", object_pairs_hook=_strict, parse_constant=_no_constant, parse_float=_number)
    except (ValueError, RecursionError):
        return None, ["arguments: not JSON"]
    if name not in schemas:
        return parsed, ["name: unknown tool"]
    if not isinstance(parsed, dict):
        return parsed, ["arguments: not an object"]
    wanted = schemas[name]
    errors = [f"{k}: missing" for k, (_, required) in sorted(wanted.items()) if required and k not in parsed]
    errors += [f"{k}: not in the schema" for k in sorted(parsed) if k not in wanted]
    errors += [f"{k}: not of type {wanted[k][0]}" for k in sorted(parsed) if k in wanted and not _TYPES[wanted[k][0]](parsed[k])]
    return parsed, errors


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def levels(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, depends_on), keys distinct and not null -> (conv_id, call_id, level); null in and behind cycles.

    A dependency that is no call of the conversation counts as met. A conversation of up to TASK_CALLS calls and
    dependencies is ordered in one go by the task that has it, however deep it is; larger ones, which
    no task should hold, in rounds over all of their calls at once.
    """
    nodes = cut(calls.select(*KEY, "depends_on"), "call-nodes")
    size = nodes.groupBy("conv_id").agg(F.sum(1 + F.size("depends_on")).alias("size"))
    large = size.filter(F.col("size") > TASK_CALLS).select("conv_id")
    if large.isEmpty():
        return _levels_in_tasks(nodes)
    large = cut(large, "large-conversations")
    return _levels_in_tasks(nodes.join(large, "conv_id", "left_anti")).unionByName(_levels_in_rounds(nodes.join(large, "conv_id", "left_semi")))


def _levels_in_tasks(nodes: DataFrame) -> DataFrame:
    """The calls of a conversation lie together, and are taken up when all that they wait for has been."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, {}
        for batch in batches:
            for conv_id, call_id, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv_id != conv:
                    yield ordered(conv, held)
                    held = {}
                conv = conv_id
                held[call_id] = needs
        if held:
            yield ordered(conv, held)

    def ordered(conv: int, held: dict[str, list[str | None]]) -> pa.RecordBatch:
        waits = {call: {n for n in needs if n in held} for call, needs in held.items()}
        open_, behind = {call: len(needs) for call, needs in waits.items()}, {}
        for call, needs in waits.items():
            for n in needs:
                behind.setdefault(n, []).append(call)
        level, wave = {}, [call for call, n in open_.items() if not n]
        for depth in itertools.count():
            if not wave:
                break
            level |= dict.fromkeys(wave, depth)
            after = []
            for call in wave:
                for next_ in behind.get(call, ()):
                    open_[next_] -= 1
                    if not open_[next_]:
                        after.append(next_)
            wave = after
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(held), pa.int64()), pa.array(list(held), pa.string()), pa.array([level.get(call) for call in held], pa.int32())], ["conv_id", "call_id", "level"])

    return nodes.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(task, "conv_id long, call_id string, level int")


def _levels_in_rounds(calls: DataFrame) -> DataFrame:
    """The same for conversations of any size: chains by path doubling, calls that wait for several at once one level a round.

    What is known of a call is a row for each call it waits for, whose level and
    `steps` are a lower bound of its own, and one without such a call, whose
    `steps` alone are. Calls that are placed are one more folder of one table, so
    the plan of a round doesn't grow.
    """
    nodes = cut(calls.select(*KEY, "depends_on"), "call-nodes")
    n, place, done = nodes.count(), f"{shared_dir(calls.sparkSession)}/calls-placed-{uuid.uuid4().hex}", []
    placed_calls = lambda: calls.sparkSession.read.schema("conv_id long, call_id string, level long").parquet(*done)
    edges = nodes.select(*KEY, F.explode("depends_on").alias("needs")).filter("needs is not null").distinct()
    edges = edges.join(nodes.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi")
    none = F.lit(None).cast("string")
    rows = nodes.select(*KEY, none.alias("needs"), F.lit(0).cast("long").alias("steps")).unionByName(edges.select(*KEY, "needs", F.lit(1).cast("long").alias("steps")))
    while True:
        rows = cut(rows, "call-rows")
        waits = F.col("needs").isNotNull()
        known = rows.groupBy(*KEY).agg(F.max(F.when(~waits, F.col("steps"))).alias("base"), F.count("needs").alias("open"), F.max("needs").alias("target"), F.max(F.when(waits, F.col("steps"))).alias("jump"))
        known = cut(known, "call-known")
        placed = known.filter("open = 0").select(*KEY, F.col("base").alias("level"))
        # a chain longer than there are calls runs in a circle, and is left where it is
        state = known.filter((F.col("open") == 0) | ((F.col("open") == 1) & (F.col("jump") <= n))).select("conv_id", F.col("call_id").alias("needs"), "base", "target", "jump")
        if done:
            # an edge may have jumped to a call that is placed already
            state = state.unionByName(placed_calls().select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("base")), allowMissingColumns=True)
        placed.write.parquet(f"{place}/{len(done)}")
        done = [*done, f"{place}/{len(done)}"]
        met = rows.filter(waits).join(state, ["conv_id", "needs"], "left")
        seen = F.col("base").isNotNull()
        step = lambda needs, steps: F.struct(needs.alias("needs"), steps.cast("long").alias("steps"))
        parts = F.when(~seen, F.array(step(F.col("needs"), F.col("steps")))).when(F.col("target").isNull(), F.array(step(none, F.col("steps") + F.col("base")))).otherwise(
            F.array(step(none, F.col("steps") + F.col("base")), step(F.col("target"), F.col("steps") + F.col("jump")))
        )
        moved = met.select(*KEY, F.explode(parts).alias("p"), seen.alias("moved")).select(*KEY, "p.*", "moved")
        own = rows.filter(~waits).join(known.filter("open > 0").select(*KEY), KEY, "left_semi").withColumn("moved", F.lit(False))
        after = cut(own.unionByName(moved).groupBy(*KEY, "needs").agg(F.max("steps").alias("steps"), F.max("moved").alias("moved")), "call-moved")
        if after.filter("moved").isEmpty():
            break
        rows = after.drop("moved")
    return nodes.select(*KEY).join(placed_calls(), KEY, "left").withColumn("level", F.col("level").cast("int"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """Every call with its result, and every result without a call.

    calls (conv_id, call_id, turn, name, arguments, depends_on), results
    (conv_id, call_id, turn, content) -> (conv_id, call_id, turn, name, level,
    status, n_errors, result_turn, json).

    status: linked, no_result, cycle (in or behind one), or orphan_result. Of
    calls, and of results, with one identifier the first counts (by turn, then
    text); null identifiers link to nothing and are dropped from the calls, and
    stay as orphans among the results. Arguments that are no JSON are kept as
    null with an error. Other columns are ignored; empty tables give no rows.
    """
    body = F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")
    first = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("int").alias("turn"), "name", "arguments", F.array_sort(F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>")))).alias("depends_on"))
    first = cut(first.filter("conv_id is not null and call_id is not null").groupBy(*KEY).agg(body).select(*KEY, "c.*"), "calls")
    answer = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("int").alias("result_turn"), "content")
    named = answer.filter("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min(F.struct("result_turn", "content")).alias("r")).select(*KEY, "r.*", F.lit(True).alias("answered"))
    linked = first.withColumn("called", F.lit(True)).join(named.hint("shuffle_hash"), KEY, "full").join(levels(first), KEY, "left")
    unnamed = answer.filter("conv_id is null or call_id is null").withColumn("answered", F.lit(True))
    events = linked.unionByName(unnamed, allowMissingColumns=True)
    status = F.when(F.col("called").isNull(), "orphan_result").when(F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "no_result").otherwise("linked")
    schema = "conv_id long, call_id string, turn int, name string, level int, status string, n_errors int, result_turn int, json string"

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts, texts = [], []
            for row in frame.to_dict("records"):
                call = row["status"] != "orphan_result"
                whole = lambda k, row=row: None if pd.isna(row[k]) else int(row[k])
                event = {"call_id": row["call_id"], "conv_id": whole("conv_id"), "status": row["status"]}
                errors: list[str] = []
                if call:
                    parsed, errors = validate(row["name"], row["arguments"], schemas)
                    event |= {"arguments": parsed, "depends_on": list(row["depends_on"]), "errors": errors, "level": whole("level"), "name": row["name"]}
                if row["answered"] is True:
                    event |= {"result": row["content"], "result_turn": whole("result_turn")}
                counts.append(len(errors))
                texts.append(canonical(event))
            yield frame.drop(columns=["arguments", "depends_on", "content", "answered"]).assign(n_errors=counts, json=texts)[["conv_id", "call_id", "turn", "name", "level", "status", "n_errors", "result_turn", "json"]]

    return events.select(*KEY, "turn", "name", "level", status.alias("status"), "result_turn", "arguments", "depends_on", "content", "answered").mapInPandas(task, schema)


def derive_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations, which have no tool calls of their own.

    Each assistant turn becomes a call whose tool follows from its text and whose
    arguments hold all of it, some of them wrong on purpose, one in three needing
    the call two turns before; the turn after it, if a user's, is its result. All
    other rows (system, opening turns, unknown roles) are results without an
    identifier, which link to nothing.
    """
    text = F.coalesce("text", F.lit(""))
    h = F.crc32(text)
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    whole = quoted(text)
    arguments = (
        F.when(h % 13 == 0, F.concat(F.lit('{"query":'), whole))
        .when(h % 4 == 0, F.concat(F.lit('{"limit":'), F.when(h % 7 == 0, F.lit('"ten"')).otherwise((h % 50).cast("string")), F.lit(',"query":'), whole, F.lit("}")))
        .when(h % 4 == 1, F.concat(F.lit('{"expression":'), quoted(F.concat_ws(" + ", F.length(text).cast("string"), F.col("turn").cast("string"), text)), F.when(h % 11 == 0, ',"precision":2.5').otherwise(',"precision":2'), F.lit("}")))
        .when(h % 4 == 2, F.concat(F.lit('{"timeout":2.50,"url":'), quoted(F.concat(F.lit("https://example.com/"), h.cast("string"), F.lit("?"), text)), F.lit("}")))
        .otherwise(F.concat(F.lit('{"text":'), whole, F.when(h % 7 == 0, "").otherwise(',"target":"de","formal":true'), F.lit("}")))
    )
    name = F.element_at(F.array(*map(F.lit, ("search", "calculate", "fetch", "translate"))), (h % 4 + 1).cast("int"))
    identifier = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    needs = F.when(h % 3 == 0, F.array(identifier(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = conversations.filter("role = 'assistant'").select("conv_id", identifier(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    results = conversations.filter("role is null or role <> 'assistant'").select("conv_id", F.when(F.expr("role = 'user' and turn > 0"), identifier(F.col("turn") - 1)).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def toolcall_report(conversations: DataFrame) -> DataFrame:
    return link_calls(*derive_events(conversations))
