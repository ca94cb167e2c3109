"""Strict validation of JSON records: types, ranges, enums, cross-field rules, no unknown fields.

``from_json`` ignores unknown keys and nulls wrong types, so keys and the raw
values' types are checked on a parsed variant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructField, StructType

from maskwright.functions.actions import ACTIONS, BLOCK_REASONS, RISKS

VERSIONS = ("1.0", "1.1")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _keys_within(json: Column, allowed: list[str], path: str = "$") -> Column:
    part = json if path == "$" else F.get_json_object(json, path)
    keys = F.json_object_keys(part)
    return keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0)


def _kind(v: Column, path: str) -> Column:
    """The JSON type at a path: string, number, object, array, boolean, null or missing."""
    part = F.try_variant_get(v, path, "variant")
    name = F.schema_of_variant(part)
    return (
        F.when(part.isNull(), "missing")
        .when(name == "STRING", "string")
        .when(name.rlike("^(?:BIGINT|DOUBLE|DECIMAL.*)$"), "number")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "BOOLEAN", "boolean")
        .otherwise("null")
    )


def _text(v: Column, path: str, low: int = 0, high: int | None = None) -> Column:
    n = F.length(_get(v, path, "string"))
    ok = (_kind(v, path) == "string") & (n >= low)
    return ok & (n <= high) if high else ok


def valid_action(json: Column) -> Column:
    """A complete action record."""
    v = F.try_parse_json(json)
    action, target = _get(v, "$.action", "string"), _get(v, "$.target_id", "string")
    confidence = _get(v, "$.confidence", "double")
    ok = (
        _keys_within(json, ["action", "target_id", "params", "confidence", "risk", "explanation", "reasoning_trace_id"])
        & action.isin(*ACTIONS)
        & _kind(v, "$.target_id").isin("string", "null", "missing")
        & _kind(v, "$.params").isin("object", "missing")
        & (_kind(v, "$.confidence") == "number")
        & confidence.between(0, 1)
        & _get(v, "$.risk", "string").isin(*RISKS)
        & _text(v, "$.explanation", 1)
        & _text(v, "$.reasoning_trace_id", 1)
        & (~action.isin("click", "type") | (F.coalesce(target, F.lit("")) != ""))
        & ((action != "blocked") | F.coalesce(_get(v, "$.params.reason", "string").isin(*BLOCK_REASONS), F.lit(False)))
    )
    return F.coalesce(ok, F.lit(False))


ELEMENT = "array<struct<mark_id:string,role:string,text:string,bbox:array<int>>>"


def valid_context(json: Column) -> Column:
    """A sanitized context: version, task, elements, and the optional step, history and title."""
    v = F.try_parse_json(json)
    elements = F.from_json(F.get_json_object(json, "$.elements"), ELEMENT)
    each = F.forall(elements, lambda e: e["mark_id"].rlike(r"^M[0-9]+$") & (F.length(e["role"]) > 0) & e["text"].isNotNull() & (F.size(e["bbox"]) == 4) & F.forall(e["bbox"], lambda b: b.isNotNull()))
    step = lambda f: _get(v, f"$.step.{f}", "int").between(1, 50)
    history = F.from_json(F.get_json_object(json, "$.history"), "array<struct<action:string,target_role:string,outcome:string,page_ident:string>>")
    past = F.forall(history, lambda h: h["action"].isin(*ACTIONS) & F.length(h["outcome"]).between(1, 120) & (F.length(h["page_ident"]) <= 120))
    ok = (
        _keys_within(json, ["schema_version", "task", "elements", "step", "history", "page_ident"])
        & _get(v, "$.schema_version", "string").isin(*VERSIONS)
        & _text(v, "$.task", 1, 500)
        & (_kind(v, "$.elements") == "array")
        & F.coalesce(each, F.lit(False))
        & (_kind(v, "$.step").isin("missing", "null") | (step("n") & step("limit")))
        & (_kind(v, "$.history").isin("missing") | (F.coalesce(past, F.lit(False)) & (F.size(history) <= 15)))
        & (_kind(v, "$.page_ident").isin("missing", "null") | _text(v, "$.page_ident", 0, 120))
    )
    return F.coalesce(ok, F.lit(False))


#: The JSON schema of an action, as far as its fields' types go.
ACTION_SCHEMA = {
    "properties": {"action": {"type": "string"}, "target_id": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "params": {"type": "object", "additionalProperties": {"type": "string"}}, "confidence": {"type": "number"}, "risk": {"type": "string"}, "explanation": {"type": "string"}, "reasoning_trace_id": {"type": "string"}},
    "required": ["action", "confidence", "risk", "explanation", "reasoning_trace_id"],
}


def spark_schema(schema: dict, definitions: dict | None = None) -> StructType:
    """The struct that an object's JSON schema asks for: required fields aren't nullable."""
    definitions = definitions if definitions is not None else schema.get("$defs", {})
    required = set(schema.get("required", ()))
    return StructType([StructField(k, *_typed(v, definitions, k not in required)) for k, v in schema["properties"].items()])


def _typed(schema: dict, definitions: dict, nullable: bool) -> tuple[DataType, bool]:
    if "$ref" in schema:
        return _typed(definitions[schema["$ref"].rsplit("/", 1)[-1]], definitions, nullable)
    if "anyOf" in schema:
        some = [x for x in schema["anyOf"] if x.get("type") != "null"]
        if len(some) != 1:
            raise ValueError("a field can't have several types")
        return _typed(some[0], definitions, True)
    kind = schema.get("type", "string" if "enum" in schema else None)
    plain = {"string": StringType(), "number": DoubleType(), "integer": LongType(), "boolean": BooleanType()}
    if kind in plain:
        return plain[kind], nullable
    if kind == "array":
        return ArrayType(*_typed(schema["items"], definitions, False)), nullable
    if kind == "object" and "properties" in schema:
        return spark_schema(schema, definitions), nullable
    if kind == "object":
        extra = schema.get("additionalProperties")
        return MapType(StringType(), *_typed(extra if isinstance(extra, dict) else {"type": "string"}, definitions, False)), nullable
    raise ValueError(f"no type for {schema}")
