"""Chat formatting with linked tool calls.

Calls and results are joined by (conversation, call id) with hash joins; of repeated ids
the first in message order counts, the others are marked. Calls may name calls that
they need; a call's level is the longest chain of needs below it, found for the whole corpus
at once by pointer doubling, so messages of a conversation are ordered by (level, turn)
without ever gathering a conversation in one task. Arguments are checked
against the tool's JSON schema, and every message is written as canonical JSON: sorted
keys, no white space, characters as they are.

Inputs
    calls    conv_id, turn, call_id, tool, arguments (JSON text), needs (array of call ids)
    results  conv_id, turn, call_id, content
    plain    conv_id, turn, role, content: messages that are neither

Defined cases: a null call id links to nothing; a result without a call is ``orphan``, a
call without a result ``open``; needs that name no call of the conversation are ignored;
calls on a cycle of needs get a null level and come last; arguments that are no JSON
object, are null or break the schema, and tools without a schema, are listed in
``problems``; repeated rows are marked ``repeated`` after the first; empty tables give an
empty result; other columns may have any name.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import stage

_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _reject(name):
    raise ValueError(name)


def parse(text: str | None):
    """(value, None) or (None, problem). A key given twice, NaN and Infinity are problems."""
    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    if text is None:
        return None, "no arguments"
    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=_reject)
        canonical(value)  # numbers beyond a double have no canonical form
    except (ValueError, RecursionError) as error:
        return None, f"no JSON: {error}" if isinstance(error, RecursionError) else "no JSON"
    return value, None


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where value breaks schema: type, enum, required, properties, additionalProperties,
    items, minItems, maxItems, minLength, maxLength, pattern, minimum, maximum."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and not any(canonical(value) == canonical(e) for e in schema["enum"]):
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}: no {k}" for k in schema.get("required", []) if k not in value]
        rest = schema.get("additionalProperties", True)
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif rest is False:
                found.append(f"{at}: unknown {k}")
            elif isinstance(rest, dict):
                found += violations(value[k], rest, f"{at}.{k}")
    elif isinstance(value, list):
        low, high = schema.get("minItems", 0), schema.get("maxItems", math.inf)
        found += [f"{at}: {len(value)} items"] if not low <= len(value) <= high else []
        if "items" in schema:
            for i, v in enumerate(value):
                found += violations(v, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        low, high = schema.get("minLength", 0), schema.get("maxLength", math.inf)
        found += [f"{at}: length {len(value)}"] if not low <= len(value) <= high else []
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: no match")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            found.append(f"{at}: out of range")
    return found


KEY = ["conv_id", "call_id"]


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of every distinct call; level is null on or behind a cycle.

    Calls with a single need form chains. Each of their pointers is doubled until it ends at
    a call with no need or several, so a chain of n calls takes log2(n) rounds, whatever the
    number of conversations. Only calls with several needs are then settled level by level.
    """
    nodes = stage(calls.where("call_id is not null").groupBy(*KEY)
                  .agg(F.min_by("needs", "turn").alias("needs")), "call-nodes")
    edges = stage(nodes.select(*KEY, F.explode("needs").alias("need")).distinct()
                  .join(nodes.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]), "call-edges")
    counted = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("need").alias("only"))
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    pointers = stage(nodes.select(*KEY).join(counted, KEY, "left").select(
        *KEY, F.coalesce("n", F.lit(0)).alias("n"), F.when(single, F.col("only")).otherwise(F.col("call_id")).alias("to"),
        single.cast("int").alias("steps"), (~single).alias("ends")), "call-pointers")

    # A pointer that has not ended after as many doublings as all calls would need is on a cycle.
    rounds = max(1, pointers.count()).bit_length() + 1
    while rounds and not pointers.where("not ends").isEmpty():
        ahead = pointers.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"),
                                F.col("steps").alias("more"), F.col("ends").alias("then"))
        moved = pointers.where("not ends").join(ahead, ["conv_id", "to"]).select(
            *KEY, "n", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("then").alias("ends"))
        pointers = stage(pointers.where("ends").unionByName(moved), "call-pointers")
        rounds -= 1

    settled = _several_needs(pointers, edges).select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("base"))
    return pointers.join(settled, ["conv_id", "to"], "left").select(
        *KEY, F.when(F.col("ends"), F.col("base") + F.col("steps")).alias("level"))


def _several_needs(pointers: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of the calls where chains end: 0 without needs; with several, one more than the
    highest of them. Each round settles the calls whose needs are settled."""
    newest = pointers.where("n = 0").select(*KEY, F.lit(0).alias("level"))
    settled = [newest]
    several = pointers.where("n > 1").select(*KEY)
    if several.isEmpty():
        return newest
    through = pointers.select("conv_id", F.col("call_id").alias("need"), "to", "steps", "ends")
    # Where a need's chain runs in a cycle there is nothing to wait for: it is never met.
    waiting = stage(edges.join(several, KEY, "left_semi").join(through, ["conv_id", "need"]).select(
        *KEY, F.when(F.col("ends"), F.col("to")).alias("to"), (F.col("steps") + 1).alias("steps"),
        F.lit(None).cast("int").alias("found")), "call-waiting")
    while not newest.isEmpty():
        met = newest.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("base"))
        waiting = stage(waiting.join(met, ["conv_id", "to"], "left").select(
            *KEY, "to", "steps", F.coalesce("found", F.col("base") + F.col("steps")).alias("found")), "call-waiting")
        newest = stage(waiting.groupBy(*KEY).agg(
            F.count("*").alias("all"), F.count("found").alias("met"), F.max("found").alias("level"))
            .where("all = met").select(*KEY, "level"), "call-levels")
        settled.append(newest)
        waiting = waiting.join(newest, KEY, "left_anti")
    everything = settled[0]
    for part in settled[1:]:
        everything = everything.unionByName(part)
    return everything


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict],
         plain: DataFrame | None = None) -> DataFrame:
    """One row per call, result and plain message: conv_id, turn, kind, call_id, level, status,
    problems, message.

    status: linked, open, orphan, repeated or plain. message: canonical JSON of the row.
    """
    def first(df, *order):
        # Rows without an id repeat nothing; their turn keeps them from meeting in one task.
        own = Window.partitionBy("conv_id", "call_id", F.when(F.col("call_id").isNull(), F.col("turn"))).orderBy(*order)
        return df.withColumn("n", F.when(F.col("call_id").isNull(), 1).otherwise(F.row_number().over(own)))

    calls = first(calls.select("conv_id", "turn", "call_id", "tool", "arguments", "needs"), "turn", "tool", "arguments")
    results = first(results.select("conv_id", "turn", "call_id", "content"), "turn", "content")
    asked = calls.where("n = 1 and call_id is not null").select("conv_id", "call_id", "tool")
    answered = results.where("n = 1 and call_id is not null").select("conv_id", "call_id", F.col("turn").alias("answer_turn"))
    depth = levels(calls.where("n = 1"))

    out_calls = (calls.join(answered, ["conv_id", "call_id"], "left").join(depth, ["conv_id", "call_id"], "left")
                 .withColumn("status", F.when(F.col("n") > 1, "repeated")
                             .when(F.col("answer_turn").isNull(), "open").otherwise("linked")))
    written = F.pandas_udf(lambda *columns: _write_calls(schemas, *columns), "message string, problems array<string>")
    out_calls = out_calls.withColumn("w", written("call_id", "tool", "arguments")).select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", "level", "status", "w.problems", "w.message")

    out_results = (results.join(asked, ["conv_id", "call_id"], "left").join(depth, ["conv_id", "call_id"], "left")
                   .withColumn("status", F.when(F.col("n") > 1, "repeated")
                               .when(F.col("tool").isNull(), "orphan").otherwise("linked")))
    answer = F.pandas_udf(_write_results, "string")
    out_results = out_results.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", "level", "status",
        F.array().cast("array<string>").alias("problems"), answer("call_id", "tool", "content").alias("message"))
    linked = out_calls.unionByName(out_results)
    if plain is None:
        return linked
    said = F.pandas_udf(_write_plain, "string")
    return linked.unionByName(plain.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("int").alias("level"), F.lit("plain").alias("status"),
        F.array().cast("array<string>").alias("problems"), said("role", "content").alias("message")))


def _plain(value):
    return None if value is None or value != value else value


def _write_calls(schemas: dict, ids: pd.Series, tools: pd.Series, arguments: pd.Series) -> pd.DataFrame:
    rows = []
    for call_id, tool, text in zip(ids, tools, arguments):
        value, problem = parse(_plain(text))
        if problem:
            problems = [problem]
        elif tool not in schemas:
            problems = ["no schema"]
        elif not isinstance(value, dict):
            problems = ["$: not object"]
        else:
            problems = violations(value, schemas[tool])
        body = value if not problem else {"unparsed": _plain(text)}
        rows.append((canonical({"role": "assistant", "tool_call": {
            "arguments": body, "id": _plain(call_id), "name": _plain(tool)}}), problems))
    return pd.DataFrame(rows, columns=["message", "problems"])


def _write_results(ids: pd.Series, tools: pd.Series, contents: pd.Series) -> pd.Series:
    return pd.Series([canonical({"content": _plain(c), "name": _plain(t), "role": "tool", "tool_call_id": _plain(i)})
                      for i, t, c in zip(ids, tools, contents)], dtype=object)


def _write_plain(roles: pd.Series, contents: pd.Series) -> pd.Series:
    return pd.Series([canonical({"content": _plain(c), "role": _plain(r)}) for r, c in zip(roles, contents)],
                     dtype=object)
