"""Binders from the raw tables to the engine's tables (items, memories, chunks, captures, jobs, ...).

Each has a DataFrame form and, for the checks against DuckDB, an equivalent common table expression in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

#: Stored categories and topic labels.
CATEGORIES = ("article", "recipe", "video", "product", "tool", "tutorial", "other")
TOPIC_LABELS = (
    "AI", "Programming", "Gym", "Food", "Electronics", "Design", "Business", "Education", "Science", "History", "Travel", "Health",
    "Finance", "Entertainment", "Lifestyle", "Culture",
)
#: The clock of bound tables: the first save, the seconds between saves, and the moment that queries run at.
EPOCH, STEP, NOW = 1_767_225_600, 2_220, 1_768_435_200
OWNERS = 40


def at(seconds: Column | str) -> Column:
    return F.timestamp_seconds(F.col(seconds) if isinstance(seconds, str) else seconds)


def now() -> Column:
    return F.timestamp_seconds(F.lit(NOW))


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's saves, from ``documents``."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    title = F.substring(F.element_at(F.split("text", "\n"), 1), 1, 120)
    created = F.lit(EPOCH) + i * STEP
    return d.select(
        i.alias("id"),
        (i % OWNERS).alias("user_id"),
        F.when(i % 29 != 0, F.md5("text")).alias("content_id"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), "lang", F.lit("/"), i % 500, F.lit("?utm_source=feed&b=2&a="), i % 3).alias("url"),
        title.alias("title"),
        F.when(i % 17 == 0, F.concat(F.lit("Edited "), title)).alias("edited_title"),
        F.substring("text", 1, 300).alias("summary"),
        F.when(i % 19 == 0, F.concat(F.lit("my words on "), "source")).alias("edited_summary"),
        (i % 23 == 0).alias("link_only"),
        F.concat("source", F.lit(".example.com")).alias("source_domain"),
        _pick(CATEGORIES, i).alias("category"),
        F.array_distinct(F.array(_pick(TOPIC_LABELS, i), _pick(TOPIC_LABELS, F.floor(i / 16)))).alias("topics"),
        F.array(F.concat(F.lit("Tool "), i % 9)).alias("tools"),
        F.array(F.concat(F.lit("Person "), i % 5)).alias("people"),
        F.when(i % 6 == 0, "research").when(i % 6 == 1, "project").alias("intent"),
        F.when(i % 11 == 0, "failed").when(i % 13 == 0, "pending").otherwise("ready").alias("status"),
        (i % 14 == 0).alias("needs_retry"),
        F.when(i % 31 == 0, "fallback").otherwise("model").alias("brief_source"),
        F.col("text").alias("search_text"),
        created.alias("created_s"),
        F.when(i % 3 == 0, created + 86_400).alias("opened_s"),
        F.when(i % 37 == 0, created + 172_800).alias("deleted_s"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's private relation to a content, from ``documents``: note and intent."""
    return items(spark, sf_dir).where("content_id is not null and id % 4 = 0").select("user_id", "content_id", F.concat(F.lit("note for "), "source_domain", F.lit(" "), "category").alias("user_note"), F.col("intent").alias("user_intent"), F.col("id").alias("memory_of"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with its time as UTC seconds."""
    return table(spark, sf_dir, "events").withColumn("at_s", F.unix_seconds(F.col("ts").cast("timestamp")))


_PICK = "({0})[({1} % {2} + 1)::INT]"
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"

#: The same tables for DuckDB.
SQL = {
    "items": f"""items AS (SELECT doc_id AS id, doc_id % {OWNERS} AS user_id, CASE WHEN doc_id % 29 <> 0 THEN md5(text) END AS content_id,
  'https://www.' || source || '.example.com/' || lang || '/' || (doc_id % 500) || '?utm_source=feed&b=2&a=' || (doc_id % 3) AS url,
  substr(string_split(text, chr(10))[1], 1, 120) AS title,
  CASE WHEN doc_id % 17 = 0 THEN 'Edited ' || substr(string_split(text, chr(10))[1], 1, 120) END AS edited_title, substr(text, 1, 300) AS summary,
  CASE WHEN doc_id % 19 = 0 THEN 'my words on ' || source END AS edited_summary, doc_id % 23 = 0 AS link_only, source || '.example.com' AS source_domain,
  {_PICK.format(_LIST(CATEGORIES), "doc_id", 7)} AS category,
  CASE WHEN doc_id % 16 = (doc_id // 16) % 16 THEN [{_PICK.format(_LIST(TOPIC_LABELS), "doc_id", 16)}] ELSE [{_PICK.format(_LIST(TOPIC_LABELS), "doc_id", 16)}, {_PICK.format(_LIST(TOPIC_LABELS), "(doc_id // 16)", 16)}] END AS topics,
  ['Tool ' || (doc_id % 9)] AS tools, ['Person ' || (doc_id % 5)] AS people,
  CASE doc_id % 6 WHEN 0 THEN 'research' WHEN 1 THEN 'project' END AS intent,
  CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'ready' END AS status, doc_id % 14 = 0 AS needs_retry,
  CASE WHEN doc_id % 31 = 0 THEN 'fallback' ELSE 'model' END AS brief_source, text AS search_text, {EPOCH} + doc_id * {STEP} AS created_s,
  CASE WHEN doc_id % 3 = 0 THEN {EPOCH} + doc_id * {STEP} + 86400 END AS opened_s, CASE WHEN doc_id % 37 = 0 THEN {EPOCH} + doc_id * {STEP} + 172800 END AS deleted_s FROM documents)""",
    "memories": "memories AS (SELECT user_id, content_id, 'note for ' || source_domain || ' ' || category AS user_note, intent AS user_intent, id AS memory_of FROM items WHERE content_id IS NOT NULL AND id % 4 = 0)",
    "log": "log AS (SELECT *, floor(epoch(ts))::BIGINT AS at_s FROM events)",
}


def with_tables(*names: str) -> str:
    """The WITH clause for some bound tables, in order."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
