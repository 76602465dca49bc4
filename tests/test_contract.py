"""Contracts of JSON answers, and the decoding of a provider's answer."""

import json

import pytest
from pyspark.sql import functions as F

from citewell.operators import contract as C
from citewell.operators import rules

OUTPUT = "content string, source_refs array<string>, sections array<struct<title:string>>, requires_review boolean"


def column(spark, texts, made):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    return [r["x"] for r in rows.select("i", made(F.col("raw")).alias("x")).orderBy("i").collect()]


def test_only_one_whole_json_value_counts(spark):
    good = ["{}", "[]", '"x"', "1", "null", " true ", '{"a":[1,{"b":null}]}']
    bad = ["", " ", "{", '{"a":1} x', '{"a":1},', '{"a":1}, 2', '{"a":1}], [2', '{"a":1}} ,{', "1 2", '1}, "y":2', "'x'", None, '{"a":1,"a":2}', "}", "]"]
    assert column(spark, good + bad, lambda raw: C.json_value(raw).isNotNull()) == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize(
    ("schema", "value", "found"),
    [
        ({"type": "string"}, "x", []), ({"type": "string"}, 1, ["$: expected string, got integer"]), ({"type": "integer"}, 1.0, []), ({"type": "integer"}, 1.5, ["$: expected integer, got number"]),
        ({"type": "number"}, 3, []), ({"type": "boolean"}, None, ["$: expected boolean, got null"]), ({"type": "boolean", "nullable": True}, None, []), ({"type": ["string", "null"]}, None, []),
        ({"enum": ["a", "b"]}, "c", ["$: not one of the values, c"]), ({"type": "integer", "minimum": 1, "maximum": 5}, 0, ["$: below 1"]), ({"type": "integer", "minimum": 1, "maximum": 5}, 6, ["$: above 5"]),
        ({"type": "string", "minLength": 1}, "", ["$: shorter than 1"]), ({"type": "string", "pattern": "^a+$"}, "ab", ["$: does not match ^a+$"]), ({"type": "array", "minItems": 1}, [], ["$: fewer than 1 items"]),
        ({"type": "array", "items": {"type": "integer"}}, [1, "x", 2, None], ["$[1]: expected integer, got string", "$[3]: expected integer, got null"]),
        ({"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string"}}}, {"a": 1}, ["$.b: missing", "$.a: expected string, got integer"]),
        ({"type": "object", "properties": {"a": {}}, "additionalProperties": False}, {"a": 1, "z": 2}, ["$.z: not allowed"]), ({"type": "object", "additionalProperties": {"type": "string"}}, {"q": 1}, ["$.q: expected string, got integer"]),
        ({"type": "object", "properties": {"s": {"type": "array", "items": {"type": "object", "required": ["t"], "properties": {"t": {"type": "string", "minLength": 1}}, "additionalProperties": False}}}}, {"s": [{"t": "x"}, {"t": ""}, {"u": 1}, 5]}, ["$.s[1].t: shorter than 1", "$.s[2].t: missing", "$.s[2].u: not allowed", "$.s[3]: expected object, got integer"]),
        ({"oneOf": [{"type": "string"}, {"type": "integer"}]}, 1.5, ["$: fits not exactly one of 2 schemas"]), ({"anyOf": [{"type": "string"}, {"minimum": 0}]}, -1, ["$: fits not any of 2 schemas"]), ({"allOf": [{"type": "integer"}, {"minimum": 3}]}, 1, ["$: below 3"]),
        ({"$ref": "#/defs/x", "defs": {"x": {"type": "string"}}}, 1, ["$: expected string, got integer"]), ({"type": "object", "properties": {"it's": {"type": "string"}}}, {"it's": 1}, ["$.it's: expected string, got integer"]),
    ],
)
def test_violations(spark, schema, value, found):
    assert column(spark, [json.dumps(value)], lambda raw: C.violations(C.json_value(raw), schema)) == [found]


def test_references_to_themselves_are_refused(spark):
    with pytest.raises(ValueError, match="itself"):
        C.violations(F.parse_json(F.lit("{}")), {"$ref": "#/a", "a": {"properties": {"b": {"$ref": "#/a"}}}})


def test_answers_by_operation_and_status(spark):
    ok = {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Item"}}}}
    document = {
        "paths": {"/x": {"get": {"operationId": "getX", "responses": {"200": ok, "404": {"$ref": "#/components/responses/Missing"}}}}},
        "components": {
            "schemas": {"Item": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "minimum": 1}}, "additionalProperties": False}},
            "responses": {"Missing": {"content": {"application/json": {"schema": {"type": "object", "required": ["error"]}}}}},
        },
    }
    rows = [("getX", 200, '{"id":1}'), ("getX", 200, '{"id":0,"secret":1}'), ("getX", 404, "{}"), ("getX", 500, "{}"), ("getY", 200, "{}"), ("getX", 200, "oops"), (None, None, None)]
    df = spark.createDataFrame(rows, "operation string, status int, body string").coalesce(1)
    got = [r["problems"] for r in C.check_answers(df, C.from_openapi(document), document).collect()]
    assert got == [[], ["$.id: below 1", "$.secret: not allowed"], ["$.error: missing"], ["no contract for getX 500"], ["no contract for getY 200"], ["$: not valid JSON"], ["no contract for ? ?"]]


def wrapped(inner, **more):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": inner}]}, "finishReason": "STOP"}]} | more)


def test_provider_answers(spark):
    cases = [
        (wrapped('{"content":"a","source_refs":["1"]}'), None), (wrapped('{"content":"","sections":[{"title":"t"}]}'), None), ("{bad", "malformed"), ("[]", "malformed"), (None, "malformed"), ("null", "no_candidates"), ("{}", "no_candidates"),
        ('{"error":{"message":"quota"}}', "error: quota"), ('{"promptFeedback":{"blockReason":"SAFETY"}}', "blocked: SAFETY"), ('{"candidates":[]}', "no_candidates"), ('{"candidates":[{"content":{"parts":[]},"finishReason":"MAX_TOKENS"}]}', "no_parts"),
        (wrapped("[]"), "malformed_output"), (wrapped('"x"'), "malformed_output"), (wrapped('{"content":"a"} trailing'), "malformed_output"), (wrapped('{"content":1}'), "malformed_output"), (wrapped('{"content":"a","source_refs":"1"}'), "malformed_output"), (wrapped(""), "malformed_output"),
        (wrapped("{}"), "empty_content"), (wrapped('{"content":"","sections":[]}'), "empty_content"), (wrapped('{"content":"a"}', error={"message": ""}), None),
    ]
    got = column(spark, [c[0] for c in cases], lambda raw: rules.decode_answer(raw, OUTPUT))
    assert [x["error"] for x in got] == [c[1] for c in cases]
    assert got[0]["value"]["source_refs"] == ["1"] and got[2]["value"] is None and got[10]["finish"] == "MAX_TOKENS"


def test_outputs_on_their_own(spark):
    cases = [('{"content":"a"}', None), ("[]", "malformed"), ('"x"', "malformed"), ('{"content":"a"} trailing', "malformed"), ("", "empty"), (None, "empty"), ('{"promptFeedback":{"blockReason":"X"}}', "blocked"), ('{"content":5}', "malformed")]
    assert [x["error"] for x in column(spark, [c[0] for c in cases], lambda raw: rules.decode_output(raw, "content string"))] == [c[1] for c in cases]
