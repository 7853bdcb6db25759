"""Evaluation fixtures: nested JSON with supplied schemas, whose free-form parts are read as VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of an evaluation's documents and queries, and of the small golden set, as their files have them.
DOCUMENTS = (
    "key string, kind string, source_type string, title string, body string, tags array<string>, brief struct<title:string,overview:string,highlights:array<string>,"
    "structured_data:variant,entities:array<string>,topics:array<string>,intent:array<string>,actions:array<string>,timestamps:array<string>>"
)
QUERIES = "text string, gold array<string>, difficulty string, note string, tags array<string>"
GOLDEN = "items array<struct<id:string,title:string,summary:string,category:string,tags:array<string>>>, queries array<struct<q:string,expect:string>>, metric string"


def read(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """A fixture's rows under its schema. Keys that a record lacks are null, those that the schema lacks are ignored.

    One object a line, or with ``multi_line`` one object or array of them a file. A record that is no JSON is a row of nulls.
    """
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def golden_items(golden: DataFrame) -> DataFrame:
    """(id, title, summary, category, tags) of a golden set."""
    return golden.select(F.inline("items"))


def golden_queries(golden: DataFrame) -> DataFrame:
    """(query_id, query, gold) of a golden set, numbered from 1 in its order; several files are numbered each by itself."""
    return golden.select(F.posexplode("queries").alias("at", "q")).select((F.col("at") + 1).alias("query_id"), F.col("q.q").alias("query"), F.array("q.expect").alias("gold"))


def write_queries(queries: DataFrame, path: str) -> None:
    """Writes (text, gold, difficulty, note, tags) as a fixture, one object a line."""
    queries.select("text", "gold", "difficulty", "note", "tags").write.mode("overwrite").option("ignoreNullFields", True).json(path)
