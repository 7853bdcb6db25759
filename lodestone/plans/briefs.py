"""Queries over briefs, evidence and the remaining transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import briefs, report
from lodestone.operators import filters
from lodestone.plans import search
from lodestone.session import table
from lodestone.sources.binders import NOW, items, memories, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def brief_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each save's brief, made from its own text with planted faults, and why it is rejected."""
    i, words = F.col("id"), F.filter(F.split("search_text", r"\s+"), lambda w: w != "")
    base = items(spark, sf_dir).select("id", "title", "summary", words.alias("w"), "tools", "search_text")
    segments = F.transform(F.split("search_text", r"\n"), lambda t, n: F.struct((n + 1).alias("id"), t.alias("text")))
    copied = F.element_at(F.split("search_text", r"[.!?\n]+"), 1)
    point = F.struct(F.when(i % 7 == 0, copied).otherwise(F.concat(F.lit("point about "), F.get("w", F.lit(0)))).alias("point"), F.when(i % 5 == 0, F.array(F.lit(99))).otherwise(F.array(F.lit(1))).alias("segment_ids"))
    columns = [F.slice("w", 1, F.when(i % 11 == 0, 3).otherwise(20).cast("int")), F.slice("w", 1, 6), F.array(point), F.when(i % 3 == 0, F.col("tools")).otherwise(F.array().cast("array<string>")), segments, F.concat_ws(" ", "title", "summary")]
    intent = F.when(i % 13 == 0, "to read").otherwise("You may have saved this to read")
    code = briefs.rejection(*columns, F.lit("full_transcript"), F.lit("high"), F.lit(None).cast("string"), intent, F.col("title"))
    return base.select("id", code.alias("code"), briefs.repaired_title(F.col("title")).alias("title"))


_BRIEFED = r"""w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w, string_split(coalesce(text, ''), chr(10))[1] AS head, source, n_chars FROM documents)"""


@query(f"""WITH {_BRIEFED}, t AS (SELECT doc_id, substr(head, 1, 120) AS title, len(w) AS n, least(len(w), 40) AS tags, len(list_filter(w, lambda x: len(x) > 11)) AS phrases, source FROM w)
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN len(title) < 1 THEN '$.title too_short' WHEN len(title) > 80 THEN '$.title too_long' END, CASE WHEN source IS NULL THEN '$.content_type missing' ELSE '$.content_type not_allowed' END,
  CASE WHEN n >= 2 THEN '$.instant_brief type' WHEN n = 0 THEN '$.instant_brief missing' END, CASE WHEN n > 0 THEN '$.key_points[0].source_ref type' END,
  '$.entities.people_orgs missing', '$.entities.places unknown', CASE WHEN tags < 15 THEN '$.tags too_short' WHEN tags > 30 THEN '$.tags too_long' END,
  CASE WHEN phrases < 5 THEN '$.search_phrases too_short' WHEN phrases > 8 THEN '$.search_phrases too_long' END, '$.evidence_used[1] not_allowed', '$.mood unknown'], lambda x: x IS NOT NULL), '; ') AS problems,
  CASE WHEN tags < 15 OR tags > 30 THEN 'tag_count' ELSE 'schema' END AS reason FROM t""")
def brief_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every violation of the briefs' shape by briefs made of each document's own words, as JSON, with the reason that is counted."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = docs.select("doc_id", "source", F.substring(F.split(F.coalesce("text", F.lit("")), "\n")[0], 1, 120).alias("title"), words.alias("w"))
    n, some = F.size("w"), lambda name: F.array().cast("array<string>").alias(name)
    points = F.when(n > 0, F.array(F.struct(F.get("w", F.lit(0)).alias("point"), F.lit(7).alias("source_ref")))).otherwise(F.array().cast("array<struct<point:string,source_ref:int>>"))
    brief = F.struct(
        "title",
        F.col("source").alias("content_type"),
        F.when(n >= 2, F.parse_json(F.to_json(F.array(n)))).when(n == 1, F.parse_json(F.lit('"one"'))).alias("instant_brief"),
        points.alias("key_points"),
        F.struct(some("tools_products"), some("numbers"), some("places")).alias("entities"),
        some("topics"),
        F.slice("w", 1, 40).alias("tags"),
        F.filter("w", lambda x: F.char_length(x) > 11).alias("search_phrases"),
        F.lit("low").alias("confidence"),
        F.array(F.lit("caption"), F.lit("hearsay")).alias("evidence_used"),
        F.lit(True).alias("mood"),
    )
    # a column of its own, so that a brief is written and parsed once rather than for each of its keys
    answers = rows.select("doc_id", F.try_parse_json(F.to_json(brief)).alias("answer"))
    judged = answers.select("doc_id", report.violations(F.col("answer"), report.BRIEF).alias("found"))
    listed = F.array_join(F.transform("found", lambda v: F.concat(v["path"], F.lit(" "), v["problem"])), "; ")
    return judged.select("doc_id", listed.alias("problems"), report.reason(F.col("found"), F.array().cast("array<string>")).alias("reason"))


@query()
def structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured data flattened to paths and values; broken JSON is repaired first."""
    body = F.concat(F.lit('{"a": {"b": ["'), F.col("event_type"), F.lit('", 2]}, "id": '), F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure: ```json\n"), body, F.lit("}\n```"))).otherwise(body).alias("answer"))
    return rows.select("event_id", briefs.flattened(briefs.json_object("answer")).alias("document"))


@query(f"{with_tables('items')} SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN '' ELSE array_to_string(topics, ', ') END AS joined FROM items")
def array_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null element makes the result null, an empty array an empty string."""
    values = F.when(F.col("id") % 4 == 0, F.concat("topics", F.array(F.lit(None).cast("string")))).when(F.col("id") % 4 == 1, F.array().cast("array<string>")).otherwise(F.col("topics"))
    return items(spark, sf_dir).select("id", briefs.array_text(values, ", ").alias("joined"))


@query()
def segment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as segments, filled greedily into groups; ``packed_segments`` also splits."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("s"))
    return rows.select("doc_id", briefs.segment_groups(F.col("s"), 1_000).alias("groups"))


_T = f"({NOW} + event_id * 4003)"


@query(f"""WITH t AS (SELECT event_id, {_T}::BIGINT AS s FROM events), d AS (SELECT *, s // 86400 * 86400 AS day, (s // 86400 + 3) % 7 AS wd FROM t)
SELECT event_id, CASE WHEN day + 68400 - s > 3600 THEN 'This evening@' || (day + 68400) || ',' ELSE '' END || CASE WHEN s - day < 18000 THEN 'Today@' || (day + 32400) ELSE 'Tomorrow@' || (day + 118800) END || ',' ||
CASE WHEN wd = 5 THEN 'Next Saturday@' || (day + 7 * 86400 + 36000) ELSE 'Saturday@' || (day + ((5 - wd + 7) % 7) * 86400 + 36000) END AS slots FROM d""")
def reminder_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X50."""
    rows = table(spark, sf_dir, "events").select("event_id", (NOW + F.col("event_id") * 4003).alias("s"))
    listed = F.transform(briefs.reminder_slots(F.col("s")), lambda x: F.concat(x["label"], F.lit("@"), x["at"].cast("string")))
    return rows.select("event_id", F.array_join(listed, ",").alias("slots"))


@query(r"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), df AS (SELECT w, 1.0::DOUBLE / (1 + count(*)) AS weight FROM w GROUP BY w),
n AS (SELECT item_id, sqrt(sum(weight * weight)) AS size, count(*) AS n FROM w JOIN df USING (w) GROUP BY item_id) SELECT item_id, w.w AS word, round(weight / size, 6) AS value, n FROM w JOIN df ON w.w = df.w JOIN n USING (item_id)""")
def rarity_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse presence vector weighted by rarity, of length one; what tests use for a provider."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("word"))
    weights = words.groupBy("word").agg((1.0 / (1 + F.count("*"))).alias("weight"))
    own = words.join(weights, "word")
    sizes = own.groupBy("item_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"), F.count("*").alias("n"))
    return own.join(sizes, "item_id").select("item_id", "word", F.round(F.col("weight") / F.col("size"), 6).alias("value"), "n")


@query()
def channel_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's rank and raw score in each of the five lists."""
    queries = search.query_table(spark)
    lists, _ = search.candidates(spark, sf_dir, queries)
    return lists.groupBy("query_id", "id", "list").agg(F.min("rank").alias("rank"), F.round(F.max("raw"), 6).alias("raw"))


@query(f"""{with_tables('items')}, c AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'Log in to continue' ELSE title END AS shown, CASE WHEN id % 7 = 0 THEN 'none' ELSE 'page' END AS provenance FROM items)
SELECT id, provenance <> 'none' AND len(trim(search_text)) >= 40 AND NOT coalesce(regexp_matches(shown, '(?i)(log\\s?in|sign in) (to|with)'), false) AND NOT regexp_matches(substr(search_text, 1, 2000), '(?i)(log\\s?in|sign in) (to|with)') AS usable FROM c""")
def anonymous_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """proven, long enough, and behind no wall."""
    wall, i = r"(?i)(log\s?in|sign in) (to|with)", F.col("id")
    shown, provenance = F.when(i % 9 == 0, "Log in to continue").otherwise(F.col("title")), F.when(i % 7 == 0, "none").otherwise("page")
    usable = (provenance != "none") & (F.char_length(F.trim("search_text")) >= 40) & ~F.coalesce(shown.rlike(wall), F.lit(False)) & ~F.substring("search_text", 1, 2000).rlike(wall)
    return items(spark, sf_dir).select("id", usable.alias("usable"))


@query(f"{with_tables('items')} SELECT id, url, coalesce(edited_title, title) AS title, array_to_string(list_filter(['01:15 start', '1:2 bad', '12:00 end'], lambda p: regexp_matches(p, '^\\d{{1,2}}:\\d{{2}} ')), '|') AS points, category AS kind FROM items WHERE deleted_s IS NULL")
def share_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the whitelisted fields leave; points need a valid time."""
    points = F.filter(F.array(F.lit("01:15 start"), F.lit("1:2 bad"), F.lit("12:00 end")), lambda p: p.rlike(r"^\d{1,2}:\d{2} "))
    return items(spark, sf_dir).where("deleted_s is null").select("id", "url", filters.display_title().alias("title"), F.array_join(points, "|").alias("points"), F.col("category").alias("kind"))


@query(f"""{with_tables('items')} SELECT id, left(summary, 300) AS summary, CASE WHEN intent IN ('research', 'project') THEN intent ELSE 'other' END AS intent, array_to_string(list_transform(topics, lambda t: lower(t))[1:15], '|') AS tags,
left(coalesce(title, 'Saved'), 120) AS title_clean, CASE WHEN link_only THEN edited_summary ELSE coalesce(edited_summary, summary) END AS shown FROM items""")
def memory_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brief as stored columns; a link-only save shows only what its owner wrote."""
    tags = F.slice(F.transform("topics", lambda t: F.lower(t)), 1, 15)
    return items(spark, sf_dir).select("id", F.substring("summary", 1, 300).alias("summary"), F.when(F.col("intent").isin("research", "project"), F.col("intent")).otherwise("other").alias("intent"), F.array_join(tags, "|").alias("tags"), F.substring(F.coalesce("title", F.lit("Saved")), 1, 120).alias("title_clean"), filters.display_summary().alias("shown"))


@query(f"""{with_tables('items')}, old AS (SELECT id, title, summary FROM items WHERE id % 2 = 0), new AS (SELECT id, 'New ' || title AS title, NULL AS summary, id % 3 = 0 AS failed FROM items WHERE id % 4 = 0)
SELECT o.id, CASE WHEN n.id IS NULL OR n.failed THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NULL THEN 'kept' WHEN n.failed THEN 'restored' ELSE 'replaced' END AS outcome FROM old o LEFT JOIN new n ON o.id = n.id""")
def reprocess_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U16: a failed reprocessing restores the saved fields."""
    own = items(spark, sf_dir)
    old = own.where("id % 2 = 0").select("id", "title")
    new = own.where("id % 4 = 0").select("id", F.concat(F.lit("New "), "title").alias("new_title"), (F.col("id") % 3 == 0).alias("failed"))
    joined, keep = old.join(new, "id", "left"), F.coalesce("failed", F.lit(True))
    return joined.select("id", F.when(keep, F.col("title")).otherwise(F.col("new_title")).alias("title"), F.when(F.col("failed").isNull(), "kept").when(F.col("failed"), "restored").otherwise("replaced").alias("outcome"))


@query(f"""{with_tables('items')}, dead AS (SELECT DISTINCT url FROM items WHERE deleted_s IS NOT NULL), c AS (SELECT user_id, category, url FROM items)
SELECT user_id, category, count(DISTINCT url) AS kept FROM c WHERE url NOT IN (SELECT url FROM dead) GROUP BY ALL""")
def collection_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted links leave every collection."""
    own = items(spark, sf_dir)
    dead = own.where("deleted_s is not null").select("url").distinct()
    return own.join(dead, "url", "left_anti").groupBy("user_id", "category").agg(F.countDistinct("url").alias("kept"))


@query(f"""{with_tables('items')} SELECT id, CASE WHEN regexp_matches(title, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'ar' ELSE 'en' END AS language, 'pending' AS state, array_to_string(list_filter(regexp_extract_all(title, '[A-Z][a-z]+'), lambda w, i: i <= 5), ', ') AS hint FROM items""")
def offline_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pending brief in the text's language, and words that help recognition."""
    hint = F.array_join(F.slice(F.regexp_extract_all("title", F.lit("[A-Z][a-z]+"), 0), 1, 5), ", ")
    return items(spark, sf_dir).select("id", F.when(F.col("title").rlike(r"[؀-ۿ]"), "ar").otherwise("en").alias("language"), F.lit("pending").alias("state"), hint.alias("hint"))


@query(f"""{with_tables('items', 'memories')} SELECT count(*) AS n, count(DISTINCT user_id) AS owners, count(*) FILTER (user_intent IS NULL) AS without_intent FROM memories WHERE user_id IN (SELECT user_id FROM items WHERE user_id % 4 <> 1)""")
def guest_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sweep keeps, counted; ``guest_leavings`` is the sweep."""
    keep = items(spark, sf_dir).where("user_id % 4 <> 1").select("user_id").distinct()
    return memories(spark, sf_dir).join(keep, "user_id", "left_semi").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("owners"), F.count_if(F.col("user_intent").isNull()).alias("without_intent"))


@query(f"""{with_tables('items')} SELECT id, regexp_extract(search_text, '^[^.!?]*[.!?]?') AS head FROM (SELECT id, substr(search_text, 1, 180) AS search_text FROM items)""")
def heuristic_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence stands in for a brief when no model answers."""
    return items(spark, sf_dir).select("id", F.regexp_extract(F.substring("search_text", 1, 180), r"^[^.!?]*[.!?]?", 0).alias("head"))


@query(f"""{with_tables('items')} SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id, content_id ORDER BY created_s, id) AS place FROM items WHERE content_id IS NOT NULL) WHERE place = 1""")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each content, in order."""
    own = items(spark, sf_dir).where("content_id is not null")
    return own.withColumn("place", F.row_number().over(W.partitionBy("user_id", "content_id").orderBy("created_s", "id"))).where("place = 1").select("user_id", "id", "place")
