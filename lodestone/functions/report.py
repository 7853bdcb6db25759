"""What is wrong with a model's answer: every violation of a declared shape, with its path, and every broken rule."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

VIOLATION = "array<struct<path:string,problem:string>>"


@dataclass(frozen=True)
class Field:
    """A key of an object: its kind (string, integer, array, object), whether it may be null or missing, and its bounds.

    Bounds are characters of a string and elements of an array; ``allowed`` are a string's values; ``each`` is the shape of an
    array's elements, ``keys`` are those of an object, which has no others.
    """

    name: str
    kind: str
    optional: bool = False
    least: int | None = None
    most: int | None = None
    allowed: tuple[str, ...] = ()
    each: Field | None = None
    keys: tuple[Field, ...] = field(default=())


#: The shape of a brief.
_TEXT = Field("", "string")
BRIEF = Field(
    "",
    "object",
    keys=(
        Field("title", "string", least=1, most=80),
        Field("content_type", "string", allowed=("video", "article", "social_post", "recipe", "product", "tutorial", "ai_tool", "image", "pdf", "news", "list", "how_to", "other")),
        Field("instant_brief", "string", least=1),
        Field("key_points", "array", each=Field("", "object", keys=(Field("point", "string", least=1), Field("source_ref", "string", optional=True), Field("segment_ids", "array", optional=True, each=Field("", "integer"))))),
        Field("best_takeaway", "string", optional=True),
        Field("entities", "object", keys=(Field("tools_products", "array", each=_TEXT), Field("people_orgs", "array", each=_TEXT), Field("numbers", "array", each=_TEXT))),
        Field("topics", "array", each=_TEXT),
        Field("tags", "array", least=15, most=30, each=_TEXT),
        Field("search_phrases", "array", least=5, most=8, each=_TEXT),
        Field("likely_intent", "string", optional=True),
        Field("suggested_action", "string", optional=True),
        Field("confidence", "string", allowed=("high", "medium", "low")),
        Field("evidence_used", "array", each=Field("", "string", allowed=("transcript", "caption", "ocr", "metadata"))),
        Field("missing_info", "string", optional=True),
    ),
)


def kind_of(value: Column) -> Column:
    """string, integer, number, boolean, array, object, null or other (a date, say), of a variant."""
    first = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    kinds = {"STRING": "string", "BIGINT": "integer", "ARRAY": "array", "OBJECT": "object", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number", "FLOAT": "number", "DECIMAL": "number"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), first), F.when(value.isNotNull(), "other"), F.lit("null"))


def _none() -> Column:
    return F.array().cast(VIOLATION)


def _one(path: Column, problem: str | Column) -> Column:
    return F.array(F.struct(path.alias("path"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem")))


def _bounds(path: Column, size: Column, shape: Field) -> Column:
    out = F.lit(None)
    if shape.least is not None:
        out = F.when(size < shape.least, "too_short")
    if shape.most is not None:
        out = F.when(size > shape.most, "too_long") if shape.least is None else out.when(size > shape.most, "too_long")
    return F.when(out.isNotNull(), _one(path, out)).otherwise(_none()) if shape.least is not None or shape.most is not None else _none()


def violations(value: Column, shape: Field, path: Column | None = None) -> Column:
    """Every violation of a shape by a variant, in the order of its keys: missing, type, too_short, too_long, not_allowed, unknown.

    A value of the wrong kind has one violation, and nothing within it is looked at. Numbers stand for no text.
    """
    path = F.lit("$") if path is None else path
    kind = kind_of(value)
    if shape.kind == "string":
        text = F.try_variant_get(value, "$", "string")
        rules = [_bounds(path, F.char_length(text), shape)]
        if shape.allowed:
            rules.append(F.when(~text.isin(*shape.allowed), _one(path, "not_allowed")).otherwise(_none()))
        inner = F.concat(*rules)
    elif shape.kind == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        numbered = F.transform(items, lambda x, i: violations(x, shape.each, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        inner = F.concat(_bounds(path, F.size(items), shape), F.coalesce(F.flatten(numbered), _none()))
    elif shape.kind == "object":
        known = [violations(F.try_variant_get(value, f"$.{k.name}", "variant"), k, F.concat(path, F.lit(f".{k.name}"))) for k in shape.keys]
        there = F.array_sort(F.array_except(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array(*(F.lit(k.name) for k in shape.keys))))
        inner = F.concat(*known, F.coalesce(F.transform(there, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown").alias("problem"))), _none()))
    else:
        inner = _none()
    absent = _none() if shape.optional else _one(path, "missing")
    return F.when(kind == "null", absent).when(kind != shape.kind, _one(path, "type")).otherwise(inner)


def reason(found: Column, broken: Column) -> Column:
    """The one reason that is counted: tag_count or schema for a shape, else the first broken rule; null for an accepted answer."""
    counted = F.exists(found, lambda v: (v["path"] == "$.tags") & v["problem"].isin("too_short", "too_long"))
    return F.when(counted, "tag_count").when(F.size(found) > 0, "schema").otherwise(F.get(broken, F.lit(0)))


def string_list(value: Column, limit: int) -> Column:
    """A model's value as a bounded list of plain strings: a string is split at commas and semicolons, an element that is an
    object stands for the first of its values (by key), blank and null ones are left out, anything else is no list."""
    kind = kind_of(value)
    parts = F.split(F.try_variant_get(value, "$", "string"), "[;,]")
    first = lambda x: F.get(F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), F.lit(0))
    plain = lambda x: F.when(kind_of(x) == "boolean", F.initcap(F.try_variant_get(x, "$", "string"))).otherwise(F.try_variant_get(x, "$", "string"))
    items = F.transform(F.slice(F.try_variant_get(value, "$", "array<variant>"), 1, limit), lambda x: F.when(kind_of(x) == "object", plain(first(x))).otherwise(plain(x)))
    chosen = F.when(kind == "string", F.slice(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), 1, limit)).when(kind == "array", items)
    return F.coalesce(F.filter(F.transform(chosen, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
