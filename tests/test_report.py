"""The report of violations against a plain walk over JSON, and a model's lists as plain strings."""

import json
import random

from pyspark.sql import functions as F

from lodestone.functions import briefs, report

KINDS = {str: "string", bool: "boolean", int: "integer", float: "number", list: "array", dict: "object", type(None): "null"}


def plain_violations(value, shape, path="$"):
    kind = KINDS[type(value)]
    if kind == "null":
        return [] if shape.optional else [(path, "missing")]
    if kind != shape.kind:
        return [(path, "type")]
    out = []
    if kind in ("string", "array"):
        if shape.least is not None and len(value) < shape.least:
            out.append((path, "too_short"))
        elif shape.most is not None and len(value) > shape.most:
            out.append((path, "too_long"))
    if kind == "string" and shape.allowed and value not in shape.allowed:
        out.append((path, "not_allowed"))
    if kind == "array":
        out += [v for i, x in enumerate(value) for v in plain_violations(x, shape.each, f"{path}[{i}]")]
    if kind == "object":
        out += [v for k in shape.keys for v in plain_violations(value.get(k.name), k, f"{path}.{k.name}")]
        out += [(f"{path}.{k}", "unknown") for k in sorted(set(value) - {k.name for k in shape.keys})]
    return out


def good():
    return {
        "title": "A title", "content_type": "recipe", "instant_brief": "b", "key_points": [{"point": "p", "source_ref": None, "segment_ids": [1, 2]}, {"point": "q"}], "best_takeaway": None,
        "entities": {"tools_products": ["t"], "people_orgs": [], "numbers": ["1"]}, "topics": [], "tags": [f"t{i}" for i in range(15)], "search_phrases": ["p"] * 5,
        "likely_intent": None, "suggested_action": "s", "confidence": "low", "evidence_used": ["ocr"], "missing_info": "m",
    }


def broken(rng):
    brief = good()
    odd = [None, 3, 2.5, True, "x" * 90, "", [], ["a", 1, None], {}, {"point": 1}, [{"point": ""}, {"segment_ids": [1, "2"]}, {"extra": 1, "point": "p"}]]
    for _ in range(rng.randrange(1, 6)):
        where = rng.choice([brief, brief, brief["entities"] if isinstance(brief["entities"], dict) else brief])
        key = rng.choice([*where, "invented", "another"])
        if rng.random() < 0.2:
            where.pop(key, None)
        else:
            where[key] = rng.choice(odd)
        brief.setdefault("entities", None)
    return brief


def test_report_equals_a_plain_walk(spark):
    rng = random.Random(1)
    cases = [good(), {}, [], "x", None, *(broken(rng) for _ in range(80))]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(999, None), (998, "{broken")], "i long, t string")
    found = {r.i: [tuple(v) for v in r.v] for r in rows.select("i", report.violations(F.try_parse_json("t"), report.BRIEF).alias("v")).collect()}
    assert found.pop(999) == found.pop(998) == [("$", "missing")]
    assert found == {i: plain_violations(c, report.BRIEF) for i, c in enumerate(cases)} and found[0] == []


def test_reasons(spark):
    of = lambda brief, *rules: spark.range(1).select(report.reason(report.violations(F.try_parse_json(F.lit(json.dumps(brief))), report.BRIEF), F.array(*map(F.lit, rules)).cast("array<string>"))).first()[0]
    assert of(good() | {"tags": ["a"], "title": ""}) == "tag_count" and of(good() | {"tags": "a"}, "timestamp") == "schema"
    assert of(good(), "timestamp", "grounding") == "timestamp" and of(good()) is None


def test_all_broken_rules_are_told(spark):
    text = lambda x: F.lit(x)
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    points = F.array(F.struct(F.lit("one two three").alias("point"), F.array(F.lit(9)).alias("segment_ids")))
    segments = F.array(F.struct(F.lit(1).alias("id"), F.lit("One, two three! More.").alias("text")))
    args = [strings("a"), strings("b"), points, strings("Nobody"), segments, text("written"), text("partial"), text("high"), text(None).cast("string"), text("to read"), text("prose")]
    row = spark.range(1).select(briefs.broken_rules(*args).alias("all"), briefs.rejection(*args).alias("first")).first()
    assert row["all"] == ["tag_count", "schema", "timestamp", "unsupported_name", "copied_transcript", "grounding"] and row["first"] == "tag_count"


def test_lists_of_strings(spark):
    cases = {"null": [], '"a; b,, c"': ["a", "b", "c"], "[1, true, null, \" x \", {\"point\": \"p\"}, {}, \"\"]": ["1", "True", "x", "p"], "3": [], "{}": [], '["a","b","c","d"]': ["a", "b", "c", "d"]}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.v for r in rows.select("t", report.string_list(F.try_parse_json("t"), 7).alias("v")).collect()} == cases
    assert spark.range(1).select(report.string_list(F.try_parse_json(F.lit('["a","b","c"]')), 2)).first()[0] == ["a", "b"]
