"""Tool calls: links, levels, schemas, canonical JSON, odd rows."""

import json

import pytest

from tapewright.llm import tool_links as L

SCHEMA = {"add": {"type": "object", "required": ["a"], "additionalProperties": False,
                  "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"], "maxLength": 3}}}}
CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>, level int, message string"
RESULTS = "conv_id long, turn long, call_id string, content string, tool string"


@pytest.mark.parametrize("value,schema,found", [
    (1, {"type": "string"}, ["$: not string"]), (True, {"type": "integer"}, ["$: not integer"]),
    (2.0, {"type": "integer"}, []), (None, {"type": ["string", "null"]}, []),
    ({"a": 1}, {"required": ["b"], "additionalProperties": False}, ["$: no b", "$: unknown a"]),
    ({"x": [1, "2"]}, {"properties": {"x": {"items": {"type": "number"}, "minItems": 3}}}, ["$.x: 2 items", "$.x[1]: not number"]),
    ("abcd", {"maxLength": 3, "pattern": "^b", "enum": ["a"]}, ["$: not in enum", "$: length 4", "$: no match"]),
    (7, {"maximum": 5}, ["$: out of range"]), ({"k": 5}, {"additionalProperties": {"type": "string"}}, ["$.k: not string"]),
])
def test_violations(value, schema, found):
    assert L.violations(value, schema) == found


def test_parse_and_canonical():
    assert L.parse('{"b": 1.50, "a": "é\\n"}') == ({"b": 1.5, "a": "é\n"}, None)
    assert L.canonical({"b": 1.5, "a": "é\n"}) == '{"a":"é\\n","b":1.5}'
    assert L.parse(None)[1] == "no arguments"
    for bad in ("", "{", '{"a":1,"a":2}', "NaN", '{"a":1e999}', "[" * 100_000):
        assert L.parse(bad)[0] is None and L.parse(bad)[1].startswith("no JSON")
    assert json.loads(L.canonical({"t": "x" * 10**6}))["t"] == "x" * 10**6


def test_links_and_levels(spark):
    calls = [
        (1, 0, "a", "add", '{"a": 1}', None), (1, 2, "b", "add", '{"a":2}', ["a"]), (1, 4, "c", "add", '{"a":-1}', ["a", "b"]),
        (1, 6, "b", "add", '{"a":3}', []), (1, 8, "x", "gone", "{}", ["y"]), (1, 9, "y", "add", "[]", ["x"]),
        (1, 10, "z", "add", None, ["y", "none"]), (2, 0, "a", "add", '{"b":"long"}', ["c"]), (2, 1, None, "add", "{}", ["a"]),
        (2, 2, None, None, "{}", None),
    ]
    results = [(1, 1, "a", "r"), (1, 3, "b", None), (1, 5, "b", "again"), (2, 5, "q", "?"), (2, 6, None, "?")]
    df = spark.createDataFrame([(*c, 5, "m") for c in calls], CALLS)
    plain = spark.createDataFrame([(3, 0, "user", "hi"), (3, 1, None, None)], "conv_id long, turn long, role string, content string")
    out = L.link(df, spark.createDataFrame([(*r, "t") for r in results], RESULTS), SCHEMA, plain).collect()
    got = {(r.conv_id, r.turn): (r.kind, r.level, r.status, list(r.problems)) for r in out}
    assert len(out) == len(calls) + len(results) + 2
    assert got == {
        (1, 0): ("call", 0, "linked", []), (1, 2): ("call", 1, "linked", []), (1, 4): ("call", 2, "open", ["$.a: out of range"]),
        (1, 6): ("call", 1, "repeated", []), (1, 8): ("call", None, "open", ["no schema"]),
        (1, 9): ("call", None, "open", ["$: not object"]), (1, 10): ("call", None, "open", ["no arguments"]),
        (2, 0): ("call", 0, "open", ["$: no a", "$.b: length 4"]), (2, 1): ("call", None, "open", ["$: no a"]),
        (2, 2): ("call", None, "open", ["no schema"]),
        (1, 1): ("result", 0, "linked", []), (1, 3): ("result", 1, "linked", []), (1, 5): ("result", 1, "repeated", []),
        (2, 5): ("result", None, "orphan", []), (2, 6): ("result", None, "orphan", []),
        (3, 0): ("message", None, "plain", []), (3, 1): ("message", None, "plain", []),
    }
    texts = {(r.conv_id, r.turn): r.message for r in out}
    assert texts[(1, 2)] == '{"role":"assistant","tool_call":{"arguments":{"a":2},"id":"b","name":"add"}}'
    assert texts[(1, 3)] == '{"content":null,"name":"add","role":"tool","tool_call_id":"b"}'
    assert texts[(3, 1)] == '{"content":null,"role":null}'


def test_levels_of_random_needs(spark):
    import random

    rng, calls, want = random.Random(8), [], {}
    for conv in range(30):
        n = rng.randrange(1, 25)
        needs = {k: rng.sample(range(k), min(k, rng.choice([0, 1, 1, 1, 2, 3]))) for k in range(n)}
        if conv % 5 == 0 and n > 4:
            needs[2] = [4]            # a cycle wherever 4 comes to need 2
            needs[4] = [2]
        level = {}

        def depth(k, open_=()):
            if k in open_:
                return None
            if k not in level:
                below = [depth(x, (*open_, k)) for x in needs[k]]
                level[k] = None if None in below else max([x + 1 for x in below], default=0)
            return level[k]

        for k in range(n):
            want[(conv, f"c{k}")] = depth(k)
            calls.append((conv, k, f"c{k}", "add", "{}", [f"c{x}" for x in needs[k]], 0, ""))
    got = {(r.conv_id, r.call_id): r.level for r in L.levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == want


def test_long_chain_and_empty(spark):
    chain = [(1, k, f"c{k}", "add", '{"a":1}', [f"c{k - 1}"]) for k in range(12)]
    df = spark.createDataFrame([(*c, 0, "") for c in chain], CALLS)
    assert {r.call_id: r.level for r in L.levels(df).collect()} == {f"c{k}": k for k in range(12)}
    assert L.link(df.limit(0), spark.createDataFrame([], RESULTS), SCHEMA).count() == 0
