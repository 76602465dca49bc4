"""Contracts of JSON answers: schemas by operation and status, compiled into column expressions over VARIANT.

A schema becomes one expression that gives the violations of a value as `path: what`, so a table of answers of any
size is held against its contract in one pass, without Python and without a shuffle. Understood: type, nullable,
required, properties, additionalProperties, items, enum, const, minimum, maximum, minLength, maxLength, pattern,
minItems, maxItems, allOf, anyOf, oneOf and $ref (not recursive); other words do not constrain.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, StringType, StructType

from citewell.functions.overlap import bound

NONE = "array<string>"


def json_value(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else; null for any other text.

    The parser takes a value and leaves what follows, so the text is read inside of brackets and inside of braces: what
    follows a value can end only one of the two.
    """
    def whole(t: Column) -> Column:
        named = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        return bound(listed, lambda v: F.when((F.size(F.try_variant_get(v, "$", "array<variant>")) == 1) & named.isNotNull(), F.try_variant_get(v, "$[0]", "variant")))

    return bound(text, whole)


def kind_of(v: Column) -> Column:
    """object, array, string, boolean, integer, number or null."""
    whole = F.try_variant_get(v, "$", "double")
    return bound(F.schema_of_variant(v), lambda s: (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        .when((s == "BIGINT") | (whole == F.floor(whole)), "integer").otherwise("number")
    ))


def field(v: Column, name: str) -> Column:
    quote = "'" if "'" not in name else '"'
    if quote in name or "\\" in name:  # no path can name it
        return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))
    return F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant")


def _none() -> Column:
    return F.array().cast(NONE)


def _if(condition: Column, path: Column, what: str | Column) -> Column:
    told = F.concat(path, F.lit(": "), F.lit(what) if isinstance(what, str) else what)
    return F.when(F.coalesce(condition, F.lit(False)), F.array(told)).otherwise(_none())


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


def violations(v: Column, schema: dict, path: Column | str = "$", root: dict | None = None, _open: tuple[str, ...] = ()) -> Column:
    """array<string> of what a VARIANT value breaks, outermost first; empty for a good value."""
    root = schema if root is None else root
    at = F.lit(path) if isinstance(path, str) else path
    return bound(v, lambda x: bound(kind_of(x), lambda kind: _violations(x, kind, schema, at, root, _open)))


def _violations(v: Column, kind: Column, schema: dict, at: Column, root: dict, _open: tuple[str, ...]) -> Column:
    if "$ref" in schema:
        ref = schema["$ref"]
        if ref in _open:
            raise ValueError(f"{ref} refers to itself")
        target = reduce(lambda d, k: d[k.replace("~1", "/").replace("~0", "~")], ref.removeprefix("#/").split("/"), root)
        return _violations(v, kind, target, at, root, (*_open, ref))
    deeper = lambda value, s, p: violations(value, s, p, root, _open)
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or [])
    allowed = set(kinds) | ({"null"} if schema.get("nullable") else set()) | ({"integer"} if "number" in kinds else set())
    parts: list[Column] = []
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    if "enum" in schema or "const" in schema:
        words = [x if isinstance(x, str) else json.dumps(x) for x in schema.get("enum", [schema.get("const")])]
        parts.append(_if((kind != "null") & ~text.isin(*words), at, F.concat(F.lit("not one of the values, "), F.coalesce(text, F.lit("")))))
    for word, bad, what in (
        ("minimum", lambda x: number < x, "below"), ("maximum", lambda x: number > x, "above"),
    ):
        if word in schema:
            parts.append(_if(kind.isin("integer", "number") & bad(float(schema[word])), at, f"{what} {schema[word]}"))
    for word, bad, what in (
        ("minLength", lambda x: F.length(text) < x, "shorter than"), ("maxLength", lambda x: F.length(text) > x, "longer than"), ("pattern", lambda x: ~text.rlike(x), "does not match"),
    ):
        if word in schema:
            parts.append(_if((kind == "string") & bad(schema[word]), at, f"{what} {schema[word]}"))
    if {"properties", "required", "additionalProperties"} & set(schema):
        own, named = [], schema.get("properties", {})
        for name in schema.get("required", []):
            own.append(_if(field(v, name).isNull(), F.concat(at, F.lit(f".{name}")), "missing"))
        for name, s in named.items():
            child = field(v, name)
            own.append(F.when(child.isNotNull(), deeper(child, s, F.concat(at, F.lit(f".{name}")))).otherwise(_none()))
        more = schema.get("additionalProperties", True)
        others = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: ~e["key"].isin(*named) if named else F.lit(True))
        if more is False:
            own.append(F.transform(others, lambda e: F.concat(at, F.lit("."), e["key"], F.lit(": not allowed"))))
        elif isinstance(more, dict) and more:
            own.append(F.flatten(F.transform(others, lambda e: deeper(e["value"], more, F.concat(at, F.lit("."), e["key"])))))
        parts.append(F.when(kind == "object", _all(own)).otherwise(_none()))
    if {"items", "minItems", "maxItems"} & set(schema):
        each, own = F.try_variant_get(v, "$", "array<variant>"), []
        if "minItems" in schema:
            own.append(_if(F.size(each) < schema["minItems"], at, f"fewer than {schema['minItems']} items"))
        if "maxItems" in schema:
            own.append(_if(F.size(each) > schema["maxItems"], at, f"more than {schema['maxItems']} items"))
        if schema.get("items"):
            own.append(F.flatten(F.transform(each, lambda x, i: deeper(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
        parts.append(F.when(kind == "array", _all(own)).otherwise(_none()))
    parts += [deeper(v, s, at) for s in schema.get("allOf", [])]
    for word, good in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if word in schema:
            fits = reduce(lambda a, b: a + b, [(F.size(deeper(v, s, at)) == 0).cast("int") for s in schema[word]])
            parts.append(_if(~good(fits), at, f"fits not {'any' if word == 'anyOf' else 'exactly one'} of {len(schema[word])} schemas"))
    rest = _all(parts)
    if not allowed:
        return rest
    wrong = ~kind.isin(*allowed)
    told = F.array(F.concat(at, F.lit(f": expected {' or '.join(sorted(set(kinds) | ({'null'} if schema.get('nullable') else set())))}, got "), kind))
    return F.when(wrong, told).otherwise(rest)


def from_openapi(document: dict) -> dict[tuple[str, int], dict]:
    """(operation, status) -> schema of its JSON answer, from an OpenAPI document; answers by $ref are followed."""
    out = {}
    for item in document.get("paths", {}).values():
        for operation in item.values():
            if not isinstance(operation, dict) or "operationId" not in operation:
                continue
            for status, answer in operation.get("responses", {}).items():
                if "$ref" in answer:
                    answer = reduce(lambda d, k: d[k], answer["$ref"].removeprefix("#/").split("/"), document)
                schema = answer.get("content", {}).get("application/json", {}).get("schema")
                if schema is not None:
                    out[operation["operationId"], int(status)] = schema
    return out


def answer_problems(body: Column, operation: Column, status: Column, contracts: dict[tuple[str, int], dict], root: dict | None = None) -> Column:
    """array<string>: what is wrong with an answer. Unknown operation or status, text that is not JSON, violations."""
    return bound(json_value(body), lambda value: _answer_problems(value, operation, status, contracts, root))


def _answer_problems(value: Column, operation: Column, status: Column, contracts: dict, root: dict | None) -> Column:
    known = F.lit(False)
    out = None
    for (name, code), schema in contracts.items():
        here = (operation == name) & (status == code)
        known = known | here
        found = violations(value, schema, "$", root or schema)
        out = F.when(here, found) if out is None else out.when(here, found)
    out = _none() if out is None else out.otherwise(_none())
    unknown = ~F.coalesce(known, F.lit(False))
    told = F.concat(F.lit("no contract for "), F.coalesce(operation, F.lit("?")), F.lit(" "), F.coalesce(status.cast("string"), F.lit("?")))
    return F.when(unknown, F.array(told)).when(value.isNull(), F.array(F.lit("$: not valid JSON"))).otherwise(out)


def check_answers(answers: DataFrame, contracts: dict[tuple[str, int], dict], root: dict | None = None, body="body", operation="operation", status="status") -> DataFrame:
    """answers with column problems."""
    return answers.withColumn("problems", answer_problems(F.col(body), F.col(operation), F.col(status), contracts, root))


def schema_of(kind: DataType | str) -> dict:
    """The JSON schema that a Spark type reads: fields of a struct may be absent or null."""
    kind = StructType.fromDDL(kind) if isinstance(kind, str) else kind
    if isinstance(kind, StructType):
        return {"type": "object", "nullable": True, "properties": {f.name: schema_of(f.dataType) for f in kind}}
    if isinstance(kind, ArrayType):
        return {"type": "array", "nullable": True, "items": schema_of(kind.elementType)}
    name = "string" if isinstance(kind, StringType) else "boolean" if isinstance(kind, BooleanType) else "integer" if isinstance(kind, IntegralType) else "number" if isinstance(kind, FractionalType) else None
    return {"type": name, "nullable": True} if name else {}
