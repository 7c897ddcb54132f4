"""Tool-call linking: calls meet their results, are ordered, validated and written as canonical JSON.

Calls and results are joined by (conversation, identifier), a hash join whose key
holds the identifier, so a long conversation is no hot key. A call may name calls
whose results it uses; levels come from a topological order of that graph, a
conversation at a time, or for conversations of over ``ONE_TASK`` uses in rounds that
each settle the calls whose sources are settled. Arguments are validated against the tool's JSON schema.
Each call and its result become one canonical JSON object: keys sorted, no spaces,
integral numbers without a fraction.

Defined cases: of calls that share an identifier in a conversation the one of the
least (turn, arguments) is the call, the others have status ``repeated``; of
results the one of the least (turn, content) is linked, further ones are counted in
``n_results``. A call without identifier or result has a null result; a result
without a call is left out of the rows and counted by ``orphans``. Sources that
don't exist are ignored; calls on a cycle, or behind one, have level -1. Arguments
that aren't a JSON object, a null text and unknown tools are invalid, with the
reason in ``errors``, and so are integers or nestings that Python's reader refuses;
half surrogate pairs stay escaped. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Calls of one conversation that one task orders; a longer conversation is ordered in rounds.
ONE_TASK = 100_000

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": (int, float)}
_NOTES = frozenset("title description default examples $schema $id $comment format deprecated readOnly writeOnly".split())
_SHAPES = {
    "properties": "named", "$defs": "named", "definitions": "named", "items": "one", "additionalProperties": "one", "not": "one",
    "anyOf": "many", "oneOf": "many", "allOf": "many",
}
_LIMITS = frozenset("minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength minItems maxItems minProperties maxProperties".split())


def check_schema(schema: object, path: str = "#", root: dict | None = None) -> None:
    """Raises ValueError for what ``validate`` doesn't know: other keywords, types or references, patterns that aren't any."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{path}: no schema")
    root = schema if root is None else root
    for k, v in schema.items():
        if k == "type":
            kinds = [v] if isinstance(v, str) else v
            if not isinstance(kinds, list) or not kinds or not all(isinstance(x, str) and x in _TYPES for x in kinds):
                raise ValueError(f"{path}: unknown type {v!r}")
        elif k == "pattern":
            try:
                re.compile(v)
            except (re.error, TypeError) as e:
                raise ValueError(f"{path}: bad pattern {v!r}") from e
        elif k == "$ref":
            _target(v, root, path)
        elif k in _LIMITS:
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise ValueError(f"{path}: {k} isn't a number")
        elif k == "required" and not (isinstance(v, list) and all(isinstance(x, str) for x in v)) or k == "enum" and not isinstance(v, list):
            raise ValueError(f"{path}: {k} isn't a list")
        elif k in _SHAPES:
            parts = v.items() if _SHAPES[k] == "named" and isinstance(v, dict) else enumerate(v) if _SHAPES[k] == "many" and isinstance(v, list) else [("", v)] if _SHAPES[k] == "one" else [("", None)]
            for name, part in parts:
                check_schema(part, f"{path}/{k}/{name}", root)
        elif k not in _NOTES and k not in ("required", "enum", "const", "uniqueItems"):
            raise ValueError(f"{path}: unknown keyword {k}")


def _target(ref: object, root: dict, path: str = "#") -> object:
    """What a local reference (# or #/a/b) names."""
    found: object = root
    if not isinstance(ref, str) or not ref.startswith("#"):
        raise ValueError(f"{path}: only local references are known, not {ref!r}")
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if not isinstance(found, dict) or part not in found:
            raise ValueError(f"{path}: {ref!r} names nothing")
        found = found[part]
    return found


def _is(value: object, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES[kind]) and (kind != "integer" or isinstance(value, int) or value.is_integer())


def validate(value: object, schema: object, path: str = "$", root: dict | None = None) -> list[str]:
    """What in ``value`` breaks ``schema``, a JSON Schema that ``check_schema`` lets pass. Equality is that of canonical JSON."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    root = schema if root is None else root
    out = []
    if "$ref" in schema:
        out += validate(value, _target(schema["$ref"], root), path, root)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [*out, f"{path}: not {' or '.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{path}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{path}: not the constant")
    failed = lambda name: [bool(validate(value, x, path, root)) for x in schema[name]]
    for x in schema.get("allOf", []):
        out += validate(value, x, path, root)
    if "anyOf" in schema and all(failed("anyOf")):
        out.append(f"{path}: none of anyOf")
    if "oneOf" in schema and (n := failed("oneOf").count(False)) != 1:
        out.append(f"{path}: {n} of oneOf")
    if "not" in schema and not validate(value, schema["not"], path, root):
        out.append(f"{path}: is what it must not be")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{path}: below minimum"] * (value < schema.get("minimum", value)) + [f"{path}: above maximum"] * (value > schema.get("maximum", value))
        out += [f"{path}: below minimum"] * ("exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]) + [f"{path}: above maximum"] * ("exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"])
        if schema.get("multipleOf") and Fraction(repr(value)) % Fraction(repr(schema["multipleOf"])):
            out.append(f"{path}: no multiple")
    if isinstance(value, str):
        out += [f"{path}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{path}: too long"] * (len(value) > schema.get("maxLength", len(value)))
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: no match")
    if isinstance(value, list):
        out += [f"{path}: too few items"] * (len(value) < schema.get("minItems", 0)) + [f"{path}: too many items"] * (len(value) > schema.get("maxItems", len(value)))
        if schema.get("uniqueItems") is True and len(set(map(canonical, value))) < len(value):
            out.append(f"{path}: repeated items")
        for i, x in enumerate(value if "items" in schema else []):
            out += validate(x, schema["items"], f"{path}[{i}]", root)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}: too few members"] * (len(value) < schema.get("minProperties", 0)) + [f"{path}: too many members"] * (len(value) > schema.get("maxProperties", len(value)))
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        more = schema.get("additionalProperties", True)
        for k in sorted(value):
            if k in known:
                out += validate(value[k], known[k], f"{path}.{k}", root)
            elif more is False:
                out.append(f"{path}.{k}: unknown")
            elif isinstance(more, dict):
                out += validate(value[k], more, f"{path}.{k}", root)
    return out


def _plain(x: object) -> object:
    if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
        return int(x)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


_HALVES = re.compile("[\ud800-\udfff]")


def _whole(text: str) -> str:
    """Half surrogate pairs have no UTF-8 form and stay escaped."""
    return _HALVES.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(x: object) -> str:
    return _whole(json.dumps(_plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _levels_of(arcs: list[tuple[str, str]]) -> dict[str, int]:
    """Levels of one conversation's calls that use others, by (call, used call); -1 on or behind a cycle."""
    uses: dict[str, set[str]] = {}
    users: dict[str, list[str]] = {}
    for call, use in arcs:
        if use not in uses.setdefault(call, set()):
            uses[call].add(use)
            users.setdefault(use, []).append(call)
    level = dict.fromkeys((u for u in users if u not in uses), 0)
    ready, left = list(level), {c: len(u) for c, u in uses.items()}
    for use in ready:
        for c in users.get(use, ()):
            left[c] -= 1
            if not left[c]:
                level[c] = 1 + max(level[u] for u in uses[c])
                ready.append(c)
    return {c: level.get(c, -1) for c in uses}


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of ``calls`` (conv_id, call_id, uses array<string>); -1 on or behind a cycle."""
    nodes = calls.select("conv_id", "call_id").distinct()
    arcs = calls.select("conv_id", "call_id", F.explode("uses").alias("use")).join(nodes.withColumnRenamed("call_id", "use"), ["conv_id", "use"], "left_semi").distinct()
    arcs = stored(arcs.select("conv_id", "call_id", "use"), "arcs")
    long = stored(arcs.groupBy("conv_id").count().filter(F.col("count") > ONE_TASK).select("conv_id"), "long")
    few = arcs if long.isEmpty() else arcs.join(long, "conv_id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(conv, held):
            found = _levels_of(held)
            return pa.RecordBatch.from_arrays([pa.array([conv] * len(found), pa.int64()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], names=["conv_id", "call_id", "level"])

        now, held = None, []
        for b in batches:
            for conv, call, use in zip(*(b.column(i).to_pylist() for i in range(3))):
                if held and conv != now:
                    yield done(now, held)
                    held = []
                now = conv
                held.append((call, use))
        if held:
            yield done(now, held)

    found = few.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(run, "conv_id long, call_id string, level int")
    if not long.isEmpty():
        found = found.unionByName(_levels_in_rounds(arcs.join(long, "conv_id", "left_semi")))
    return nodes.join(found, ["conv_id", "call_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))


def _levels_in_rounds(arcs: DataFrame) -> DataFrame:
    """The same for conversations of any length: every round settles the calls whose sources are settled."""
    open_ = stored(arcs, "open")
    last = open_.select("conv_id", "use").distinct().join(open_.select("conv_id", F.col("call_id").alias("use")), ["conv_id", "use"], "left_anti")
    found, level = [], 0
    while True:
        level += 1
        after = stored(open_.join(last, ["conv_id", "use"], "left_anti"), "open")
        waiting = after.select("conv_id", "call_id").distinct()
        ready = stored(open_.select("conv_id", "call_id").distinct().join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "level")
        if ready.isEmpty():
            rest = waiting.withColumn("level", F.lit(-1))
            return reduce(DataFrame.unionByName, found, rest)
        found.append(ready)
        open_, last = after, ready.select("conv_id", F.col("call_id").alias("use"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Rows of calls with level, status, errors and canonical JSON, in the order (conv_id, level, turn, call_id).

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), uses (array of call_ids).
    ``results``: conv_id, turn, call_id, content. A schema with keywords that aren't
    known here is refused at once (ValueError), never passed over.
    """
    for tool, schema in schemas.items():
        check_schema(schema, f"{tool}#")
    first = Window.partitionBy("conv_id", "call_id").orderBy("turn", "arguments", "name")
    marked = calls.withColumn("nth", F.when(F.col("call_id").isNull(), 1).otherwise(F.row_number().over(first)))
    found = results.filter(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    order = levels(calls.filter(F.col("call_id").isNotNull()).select("conv_id", "call_id", F.coalesce("uses", F.array().cast("array<string>")).alias("uses")))
    rows = marked.join(found, ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"], "left")
    rows = rows.select("conv_id", "call_id", "turn", "name", "arguments", F.coalesce("level", F.lit(0)).alias("level"), F.when(F.col("nth") > 1, "repeated").when(F.col("r").isNull(), "open").otherwise("linked").alias("status"), F.when(F.col("nth") == 1, F.col("r.content")).alias("content"), F.col("r.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).alias("n_results"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors, texts = [], []
            for call, name, arguments, content in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("call_id", "name", "arguments", "content"))):
                try:
                    given = json.loads(arguments) if arguments is not None else None
                    text = canonical({"id": call, "name": name, "arguments": given, "result": content})
                    bad = ["$: not object"] if not isinstance(given, dict) else validate(given, schemas[name]) if name in schemas else [f"unknown tool {name}"]
                except (ValueError, RecursionError):
                    text, bad = canonical({"id": call, "name": name, "arguments": arguments, "result": content}), ["not JSON"]
                errors.append(_whole("; ".join(bad)))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("conv_id", "call_id", "turn", "level", "status", "n_results")), pa.array([not e for e in errors]), pa.array(errors, pa.string()), pa.array(texts, pa.string())], names=["conv_id", "call_id", "turn", "level", "status", "n_results", "valid", "errors", "json"])

    return rows.mapInArrow(write, "conv_id long, call_id string, turn long, level int, status string, n_results long, valid boolean, errors string, json string")


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no call asked for."""
    return results.join(calls.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")


_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"


def embedded_calls(turns: DataFrame) -> DataFrame:
    """Calls written into texts as <tool_call>{"id", "name", "arguments", "uses"}</tool_call>."""
    part = turns.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(_CALL), 1)).alias("c"))
    get = lambda k: F.get_json_object("c", f"$.{k}")
    return part.select("conv_id", "turn", get("id").alias("call_id"), get("name").alias("name"), get("arguments").alias("arguments"), F.coalesce(F.from_json(get("uses"), "array<string>"), F.array().cast("array<string>")).alias("uses"))


SCHEMAS = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation without explicit calls: a user turn calls the tool ``reply`` and uses the call two turns before, if there is one; the assistant's next turn is its result."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    given = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    calls = rows.filter("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), given.alias("arguments"), F.array(name(F.col("turn") - 2)).alias("uses"))
    results = rows.filter("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def linked_turns(turns: DataFrame) -> DataFrame:
    return link(*turns_as_calls(turns), SCHEMAS)


SQL = """
WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS nth FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT c.conv_id, c.conv_id || ':' || c.turn AS call_id, c.turn, (row_number() OVER (PARTITION BY c.conv_id, c.turn - 2 * c.nth, c.turn % 2 ORDER BY c.turn) - 1)::INTEGER AS level,
       CASE WHEN r.n IS NULL THEN 'open' ELSE 'linked' END AS status, coalesce(r.n, 0)::BIGINT AS n_results,
       c.text <> '' AS valid, CASE WHEN c.text = '' THEN '$.text: too short' ELSE '' END AS errors,
       '{"arguments":{"text":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '},"id":"' || c.conv_id || ':' || c.turn || '","name":"reply","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS json
FROM c LEFT JOIN r USING (conv_id, turn)
"""
