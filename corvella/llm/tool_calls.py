"""Tool-call linking: calls and results joined by identifier, put in an order that respects dependencies,
checked against schemas and written as canonical JSON.

A call depends on the calls whose ids its arguments name as "$id". Level 0 has no dependency, level n only such of
lower levels; calls that wait on each other, or on such a call, have no level and no position. A conversation of at
most MOST calls (identifiers and dependencies only, no texts) is ordered by one task; a larger one by joins: calls with one
dependency point to it, and pointers jump to what their target points to, so that chains take as many rounds as the logarithm
of their length; then the calls with several dependencies take a round for each of these on a path. position is the place in
the order of level, turn and identifier.

Rows: of calls (or results) with one id in one conversation, the first by turn counts, ties by content, and the others
are counted; a null identifier joins nothing and is an orphan, and so does a null conversation; null or broken
arguments (also numbers beyond floating point, or nested too deeply to be written) are invalid, not an error; a lone
surrogate is kept as its escape; a schema's type that is not known is met by nothing; results without a call are kept
as orphans; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
MOST = 1_000_000  # calls of a conversation that one task orders
SERIAL = 1_000  # calls in a piece of a serialised conversation
_SURROGATE = re.compile("[\ud800-\udfff]")


def _escaped(text: str) -> str:
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """Sorted keys, no spaces, no escapes but those that JSON, or UTF-8, needs."""
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def is_kind(value, kind: str) -> bool:
    return isinstance(value, KINDS.get(kind, ())) and not (kind in ("integer", "number") and isinstance(value, bool))


def check(arguments, schema: dict | None) -> list[str]:
    """What is wrong with the arguments under {"properties": {name: {"type": ..., "enum": ...}}, "required": [...]}."""
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    known = schema.get("properties") or {}
    wrong = [f"missing {k}" for k in schema.get("required") or [] if k not in arguments]
    for k, v in sorted(arguments.items()):
        if k not in known:
            wrong.append(f"unexpected {_escaped(k)}")
            continue
        rule = known[k] or {}
        kinds = rule.get("type") or []
        if kinds and not any(is_kind(v, x) for x in ([kinds] if isinstance(kinds, str) else kinds)):
            wrong.append(f"{k} is no {kinds if isinstance(kinds, str) else ' or '.join(map(str, kinds))}")
        elif rule.get("enum") is not None and v not in rule["enum"]:
            wrong.append(f"{k} is not allowed")
    return wrong


def named(value) -> list[str]:
    """The identifiers that are named as "$id", each once."""
    found, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.startswith("$") and len(x) > 1 and not _SURROGATE.search(x):
                found.add(x[1:])
        elif isinstance(x, (list, dict)):
            todo += x.values() if isinstance(x, dict) else x
    return sorted(found)


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(text)
    return x


def read_arguments(text: str | None, schema: dict | None) -> tuple[list[str], list[str], str | None]:
    """(identifiers named, what is wrong, canonical JSON or None)."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        value = json.loads(text, parse_constant=refuse, parse_float=_finite)
        return named(value), check(value, schema), canonical(value)
    except (TypeError, ValueError, RecursionError):
        return [], ["broken JSON"], None


def order(calls: list[str], turns: list[int | None], deps: list[list[str]]) -> tuple[list[int | None], list[int | None]]:
    """Levels and positions of one conversation's calls; dependencies on other ids than its own do not count."""
    at = {c: k for k, c in enumerate(calls)}
    waits, leads = [0] * len(calls), [[] for _ in calls]
    for k, needs in enumerate(deps):
        for d in needs:
            if d in at:
                waits[k] += 1
                leads[at[d]].append(k)
    level: list[int | None] = [None] * len(calls)
    ready, n = [k for k, w in enumerate(waits) if not w], 0
    while ready:
        after = []
        for k in ready:
            level[k] = n
            for other in leads[k]:
                waits[other] -= 1
                if not waits[other]:
                    after.append(other)
        ready, n = after, n + 1
    position: list[int | None] = [None] * len(calls)
    placed = sorted((k for k, x in enumerate(level) if x is not None), key=lambda k: (level[k], turns[k] is not None, turns[k] or 0, calls[k]))
    for p, k in enumerate(placed):
        position[k] = p
    return level, position


def _first(df: DataFrame, *columns: str) -> DataFrame:
    """One row an identifier: the first by turn, and how many there were. Aggregated before the shuffle."""
    s = F.struct(*columns)
    return df.groupBy("conv_id", "call_id").agg(F.min(s).alias("s"), F.count("*").alias("n")).select("conv_id", "call_id", "s.*", "n")


LEVELS = "conv_id long, call_id string, level int, position long"


def levels(calls: DataFrame, most: int = MOST) -> DataFrame:
    """conv_id, call_id, level and position of calls with turn and deps (ids of other calls)."""
    calls = calls.select("conv_id", "call_id", "turn", "deps").where("conv_id is not null")
    large = stored(calls.groupBy("conv_id").agg(F.count("*").alias("m")).where(F.col("m") > most).select("conv_id"), "large")

    def sort(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            level, position = order(t["call_id"].to_pylist(), t["turn"].to_pylist(), t["deps"].to_pylist())
            yield pa.RecordBatch.from_arrays([t["conv_id"].combine_chunks(), t["call_id"].combine_chunks(), pa.array(level, pa.int32()), pa.array(position, pa.int64())], names=["conv_id", "call_id", "level", "position"])

        for b in batches:
            ids = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y == x:
                    continue
                if held and held[0].column(0)[0].as_py() != ids[x]:
                    yield from flush()
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield from flush()

    if large.isEmpty():
        return calls.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(sort, LEVELS)
    small = calls.join(large, "conv_id", "left_anti").repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(sort, LEVELS)
    return small.unionByName(rounds(stored(calls.join(large, "conv_id", "left_semi"), "large-calls")))


def _jumped(single: DataFrame, n: int) -> DataFrame:
    """conv_id, call_id, anchor, steps of calls with one dependency (dep): the first call on its way that has none or several.

    n: how many there are. Calls on a way into a cycle never get there and are left out."""
    ways = stored(single.select("conv_id", "call_id", F.col("dep").alias("anchor"), F.lit(1).cast("long").alias("steps")), "ways")
    k = 0
    while True:
        after = ways.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"))
        both = stored(ways.join(after, ["conv_id", "anchor"], "left"), "jumps")
        further = both.select("conv_id", "call_id", F.coalesce("next", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        k += 1
        if k > n.bit_length() + 1 or both.where("next IS NOT NULL").isEmpty():
            return both.where("next IS NULL").select("conv_id", "call_id", "anchor", "steps")
        new = stored(further, "ways")
        for old in (ways, both):
            discard(old)
        ways = new


def rounds(calls: DataFrame) -> DataFrame:
    """The same for conversations that no task should hold."""
    names = ["conv_id", "call_id"]
    edges = stored(calls.select(*names, F.explode("deps").alias("dep")).join(calls.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi"), "edges")
    several = edges.groupBy(*names).agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    several = stored(several, "needs")
    single = several.where("n = 1")
    ways = stored(_jumped(single, single.count()), "anchors")
    # The contracted graph: calls with several dependencies, and how far behind the anchor of each they are.
    joins = edges.join(several.where("n > 1").select(*names), names, "left_semi")
    far = joins.join(ways.select("conv_id", F.col("call_id").alias("dep"), "anchor", "steps"), ["conv_id", "dep"], "left").select(*names, F.coalesce("anchor", "dep").alias("anchor"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    wait = stored(far, "waits")
    new = stored(calls.select(*names).join(several.select(*names), names, "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    folder, best = [new.stored_at], None
    while not wait.isEmpty():
        met = wait.join(new.select("conv_id", F.col("call_id").alias("anchor"), "level"), ["conv_id", "anchor"], "left")
        met = stored(met, "met")
        reached = met.where("level IS NOT NULL").select(*names, (F.col("level") + F.col("steps")).alias("level"))
        reached = reached if best is None else best.unionByName(reached)
        left = stored(met.where("level IS NULL").select("conv_id", "call_id", "anchor", "steps"), "waits")
        best_now = stored(reached.groupBy(*names).agg(F.max("level").alias("level")), "best")
        new = stored(best_now.join(left.select(*names), names, "left_anti"), "levels")
        more = stored(best_now.join(left.select(*names), names, "left_semi"), "best")
        for old in (wait, met, best_now, *([best] if best is not None else [])):
            discard(old)
        folder.append(new.stored_at)
        wait, best = left, more
        if new.isEmpty():
            break
    known = calls.sparkSession.read.schema("conv_id long, call_id string, level long").parquet(*folder)
    behind = ways.join(known.withColumnsRenamed({"call_id": "anchor"}), ["conv_id", "anchor"]).select(*names, (F.col("level") + F.col("steps")).alias("level"))
    levels = known.unionByName(behind).withColumn("level", F.col("level").cast("int"))
    done = stored(levels.join(calls.select(*names, "turn"), names), "levelled")
    # Places by blocks of turns: within a block by a window, before it by the sum of the blocks' sizes.
    done = done.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / SERIAL))
    sizes = done.groupBy("conv_id", "level", "block").agg(F.count("*").alias("m"))
    before = sizes.select("conv_id", "level", "block", (F.sum("m").over(Window.partitionBy("conv_id").orderBy("level", "block")) - F.col("m")).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "level", "block").orderBy("turn", "call_id")) - 1
    return done.withColumn("within", within).join(before, ["conv_id", "level", "block"]).select("conv_id", "call_id", "level", (F.col("before") + F.col("within")).alias("position"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments; results: conv_id, turn, call_id, content.

    conv_id, call_id, call_turn, result_turn, status (linked, unanswered, orphan, early), level, position, n_calls,
    n_results, valid, errors, json. Order within a conversation: position.
    """

    def read(batches):
        for b in batches:
            out = [read_arguments(text, schemas.get(name)) for name, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            deps, errors, canon = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(deps, pa.list_(pa.string())), pa.array(errors, pa.list_(pa.string())), pa.array(canon, pa.string())], names=["conv_id", "call_id", "name", "arguments", "turn", "n", "deps", "errors", "canonical"])

    def write(batches):
        for b in batches:
            rows = [f'{{"arguments":{a or "null"},"id":{canonical(i)},"name":{canonical(n)},"result":{canonical(r)}}}' for i, n, a, r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[4:], b.column(0), pa.array(rows, pa.string())], names=[*b.schema.names[4:], "call_id", "json"])

    c = _first(calls.where("call_id is not null"), "turn", "name", "arguments").select("conv_id", "call_id", "name", "arguments", "turn", "n")
    c = stored(c.mapInArrow(read, "conv_id long, call_id string, name string, arguments string, turn long, n long, deps array<string>, errors array<string>, canonical string"), "calls")
    r = _first(results.where("call_id is not null"), "turn", "content").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.col("n").alias("n_results"))
    both = c.withColumnRenamed("turn", "call_turn").withColumnRenamed("n", "n_calls").join(r, ["conv_id", "call_id"], "full_outer").join(levels(c), ["conv_id", "call_id"], "left")
    nulls = calls.where("call_id is null").select("conv_id", F.col("turn").alias("call_turn"), "name").unionByName(results.where("call_id is null").select("conv_id", F.col("turn").alias("result_turn"), "content"), allowMissingColumns=True)
    both = both.unionByName(nulls, allowMissingColumns=True)
    status = F.when(F.col("call_turn").isNull() | F.col("call_id").isNull(), "orphan").when(F.col("result_turn").isNull(), "unanswered").when(F.col("result_turn") <= F.col("call_turn"), "early").otherwise("linked")
    shown = both.select(
        "call_id", "name", "canonical", "content", "conv_id", "call_turn", "result_turn", status.alias("status"), "level", "position", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        (F.coalesce(F.size("errors"), F.lit(1)) == 0).alias("valid"), F.array_join(F.coalesce("errors", F.array()), "; ").alias("errors"),
    )
    return shown.mapInArrow(write, "conv_id long, call_turn long, result_turn long, status string, level int, position long, n_calls long, n_results long, valid boolean, errors string, call_id string, json string")


def serialised(linked: DataFrame, size: int = SERIAL) -> DataFrame:
    """conv_id, piece, json: a conversation's calls in their order as canonical JSON arrays of at most size calls."""
    some = linked.where("position is not null").withColumn("piece", F.floor(F.col("position") / size))
    items = F.array_sort(F.collect_list(F.struct("position", "json")))
    return some.groupBy("conv_id", "piece").agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["json"]), ","), F.lit("]")).alias("json"))


SCHEMAS = {
    "search": {"properties": {"query": {"type": "string"}, "n": {"type": "integer"}, "after": {"type": "string"}}, "required": ["query", "n"]},
    "compute": {"properties": {"query": {"type": "string"}, "n": {"type": "integer"}}, "required": ["query"]},
    "store": {"properties": {"query": {"type": "string"}, "n": {"type": "string"}}, "required": ["query"]},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations read as tool use: what a user says is a call, the next turn by others is its result."""
    at = lambda back: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - back).cast("string"))
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    name = F.element_at(F.array(F.lit("search"), F.lit("compute"), F.lit("store")), F.length("text") % 3 + 1)
    arguments = F.to_json(F.struct(F.col("text").alias("query"), words.alias("n"), F.when(F.col("turn") >= 2, F.concat(F.lit("$"), at(2))).alias("after")))
    calls = t.where("role = 'user'").select("conv_id", "turn", at(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    return calls, t.where("role <> 'user'").select("conv_id", "turn", at(1).alias("call_id"), F.col("text").alias("content"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*conversation_calls(table(spark, sf_dir, "conversations")), SCHEMAS)
