"""Literal cases of brief validation, tolerant JSON, flattening and groups."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import briefs


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ('{"a": 1}', '{"a": 1}'),
        ('Here: ```json\n{"a": [1, 2]}\n``` done', '{"a": [1, 2]}'),
        ('"{\\"a\\": 1}"', '{"a": 1}'),
        ('{"a": {"b": "cut o', '{"a": {"b": "cut o"}}'),
        ('{"a": [1, 2', '{"a": [1, 2]}'),
        ('say {x} then {"a": 1}', '{"a": 1}'),
        ('say {x then {"a": 1}', '{"a": 1}'),
        ('fill {} with {"a": 1}', '{"a": 1}'),
        ("only {}", "{}"),
        ('{"a": {"b": 1}, "c": "cut', '{"a": {"b": 1}, "c": "cut"}'),
        ('{"a": 1, "b": tru', '{"a": 1}'),
        ('{"a": {"b', '{"a": {}}'),
        ('{"a": "x\\\\', '{"a": "x\\\\"}'),
        ('{"a": "say \\"hi\\"", "b": [{"c": "d}"}, {"e": 1', '{"a": "say \\"hi\\"", "b": [{"c": "d}"}, {"e": 1}]}'),
        ('{"a": "' + "x" * 100_000, '{"a": "' + "x" * 100_000 + '"}'),
        ('{"a": 1} ' + "tail } " * 10_000, '{"a": 1}'),
        ("no json", None),
        ("", None),
        (None, None),
    ],
)
def test_tolerant_object(answer, expected):
    assert briefs.tolerant_object(answer) == expected


def test_flatten_keeps_order_and_paths():
    assert briefs.flatten_json('{"b": {"c": ["x", {"d": 2}]}, "a": null, "e": true}') == "b.c x b.c.d 2 e True"
    assert briefs.flatten_json("broken{") == "" and briefs.flatten_json(None) == ""


def value(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_title_is_cut_between_words(spark):
    assert value(spark, briefs.repaired_title(F.col("t")), t="  a   b ") == "a b"
    assert value(spark, briefs.repaired_title(F.col("t")), t="word " * 30) == ("word " * 16).strip()
    assert value(spark, briefs.repaired_title(F.col("t")), t="x" * 90) == "x" * 80


def test_array_text(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["a", None],)], "v array<string>")
    assert [r.x for r in rows.select(briefs.array_text(F.col("v"), "-").alias("x")).collect()] == ["a-b", "", None, None]


def test_segments_fill_groups_in_order(spark):
    assert value(spark, briefs.segment_groups(F.col("s"), 10), s=["aaaa", "bb", "cccccccccccc", "d"]) == [0, 0, 1, 2]


def test_rejections(spark):
    schema = "tags array<string>, phrases array<string>, points array<struct<point:string,segment_ids:array<int>>>, names array<string>, segments array<struct<id:int,text:string>>, written string, level string, confidence string, missing string, intent string, prose string"
    good = [[f"t{i}" for i in range(15)], ["p"] * 5, [("a new point", [1])], ["Acme"], [(1, "They said so. Plain words here now.")], "by ACME, inc", "full_transcript", "high", None, "You may have saved this to read", "title"]
    cases = {None: {}, "tag_count": {0: ["t"]}, "schema": {1: ["p"]}, "timestamp": {2: [("a new point", [7])]}, "unsupported_name": {3: ["Acm"]}, "copied_transcript": {2: [("plain words HERE now", [1])]}, "grounding": {9: "to read"}}
    rows = [tuple(change.get(i, v) for i, v in enumerate(good)) for change in cases.values()]
    found = spark.createDataFrame(rows, schema).select(briefs.rejection(*map(F.col, ("tags", "phrases", "points", "names", "segments", "written", "level", "confidence", "missing", "intent", "prose"))).alias("x"))
    assert [r.x for r in found.collect()] == list(cases)
