"""Queries on what happens to saves and jobs, on masked values and on what a reason claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import clock, identity, text
from lodestone.operators import lifecycle
from lodestone.plans.content import SQL as CONTENT
from lodestone.session import table
from lodestone.sources.binders import NOW, events, items, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_STAGES = "[" + ", ".join(f"'{s}'" for s in lifecycle.STAGES) + "]"
_REACHED = {"signup": "FETCH", "view": "NORMALIZE", "click": "BRIEF", "purchase": "EMBED"}
_WORK = {"view": "fetch", "click": "ai", "purchase": "embedding"}


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query(f"""{with_tables('log')}, last AS (SELECT user_id, {_case("arg_max(event_type, (at_s, event_id))", _REACHED)} AS stage FROM log WHERE user_id IS NOT NULL GROUP BY user_id),
done AS (SELECT user_id, coalesce(list_position({_STAGES}, stage), 0) AS n FROM last)
SELECT user_id, i::INT AS stage_idx, ({_STAGES})[i + 1] AS stage FROM (SELECT user_id, unnest(range(n, {len(lifecycle.STAGES)})) AS i FROM done)""")
def stage_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner's newest event as the last committed stage of a job; errors are no stage, so all is to be done again."""
    reached = F.create_map(*(F.lit(x) for pair in _REACHED.items() for x in pair))
    last = events(spark, sf_dir).where("user_id is not null").groupBy("user_id").agg(F.max_by("event_type", F.struct("at_s", "event_id")).alias("kind"))
    return lifecycle.remaining_stages(last.select("user_id", F.try_element_at(reached, F.col("kind")).alias("last_stage")), "user_id", "last_stage")


@query(f"""{with_tables('items')}, held AS (SELECT content_id, bool_or(status = 'pending') AS held FROM items WHERE content_id IS NOT NULL GROUP BY content_id),
judged AS (SELECT i.id, i.content_id, i.status, h.held, CASE WHEN opened_s IS NULL THEN NULL WHEN link_only THEN 'unchanged' WHEN status <> 'failed' AND NOT needs_retry THEN 'refused' WHEN h.held THEN 'busy' ELSE 'kept' END AS outcome
  FROM items i LEFT JOIN held h ON i.content_id = h.content_id),
waits AS (SELECT DISTINCT content_id FROM judged WHERE status IN ('pending', 'failed') AND coalesce(outcome, '') <> 'kept' AND content_id IS NOT NULL)
SELECT id, outcome, outcome = 'kept' AND held IS NOT NULL AND content_id NOT IN (SELECT content_id FROM waits) AS closes_job FROM judged WHERE outcome IS NOT NULL""")
def keep_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opened save asked to stay as a link; a content's job is held while one of its saves is pending."""
    own = items(spark, sf_dir)
    jobs = own.where("content_id is not null").groupBy("content_id").agg(F.bool_or(F.col("status") == "pending").alias("held"))
    return lifecycle.keep_links(own, jobs, own.where("opened_s is not null"))


@query(f"""{with_tables('items')}, chunks AS ({CONTENT['word_chunks']}), copies AS (SELECT id AS target, min(id) OVER (PARTITION BY user_id, url) AS source FROM items),
chosen AS (SELECT * FROM copies WHERE target <> source)
SELECT doc_id AS item_id, chunk_idx, substr(sha256(chunk_text), 1, 12) AS chunk FROM chunks WHERE doc_id NOT IN (SELECT target FROM chosen)
UNION ALL SELECT target, chunk_idx, substr(sha256(chunk_text), 1, 12) FROM chunks JOIN chosen ON doc_id = source""")
def chunk_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later saves of a link take the chunks of their owner's first one."""
    chunks = text.word_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "item_id")
    own = items(spark, sf_dir).select("id", "user_id", "url")
    first = own.groupBy("user_id", "url").agg(F.min("id").alias("source"))
    after = lifecycle.copy_chunks(chunks, own.join(first, ["user_id", "url"]).select(F.col("id").alias("target"), "source"))
    return after.select("item_id", "chunk_idx", identity.short_hash(F.col("chunk_text")).alias("chunk"))


@query(f"""{with_tables('log')}, holds AS (SELECT {_case('event_type', _WORK)} AS stage, at_s, at_s + 60 + floor(value)::BIGINT AS ended FROM log WHERE value >= 0),
edges AS (SELECT stage, at_s AS t, 1 AS d FROM holds WHERE stage IS NOT NULL UNION ALL SELECT stage, ended, -1 FROM holds WHERE stage IS NOT NULL),
net AS (SELECT stage, t, sum(d) AS d, count(*) FILTER (d > 0) AS starts FROM edges GROUP BY ALL),
run AS (SELECT stage, starts, sum(d) OVER (PARTITION BY stage ORDER BY t) AS busy FROM net)
SELECT stage, sum(starts)::BIGINT AS total, max(busy)::BIGINT AS peak, max(busy) <= CASE stage WHEN 'embedding' THEN 2 ELSE 4 END AS within FROM run GROUP BY stage""")
def work_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as work of a minute and their value in seconds; the peak of each kind against its limit."""
    kinds = F.create_map(*(F.lit(x) for pair in _WORK.items() for x in pair))
    log = events(spark, sf_dir).where("value >= 0")
    return lifecycle.busiest(log.select(F.try_element_at(kinds, F.col("event_type")).alias("stage"), F.col("at_s").alias("started_s"), (F.col("at_s") + 60 + F.floor("value")).alias("ended_s")))


@query(f"""{with_tables('log')} SELECT event_id, round(CASE event_type WHEN 'purchase' THEN round(abs(value), 2) WHEN 'click' THEN greatest(0, at_s - {NOW}) ELSE least(8.0, 0.5 * pow(2, event_id % 7)) * (0.8 + 0.4 * (event_id % 100) / 100.0) END, 6)::DOUBLE AS delay FROM log""")
def provider_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry-After in seconds, as a date, or broken; without one that can be read the delay doubles up to a cap."""
    log = events(spark, sf_dir)
    dated = F.concat(F.date_format(F.timestamp_seconds("at_s"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    header = F.when(F.col("event_type") == "purchase", F.round(F.abs("value"), 2).cast("string")).when(F.col("event_type") == "click", dated).when(F.col("event_type") == "view", "soon")
    delay = clock.retry_delay(header, F.col("event_id") % 7 + 1, F.lit(NOW), (F.col("event_id") % 100) / 100)
    return log.select("event_id", F.round(delay, 6).alias("delay"))


@query(f"""{with_tables('items')}, said AS (SELECT id, search_text, CASE WHEN intent IS NULL THEN 'Similar meaning' ELSE topics[1] || ' + ' || category || ' (in the content), ' || source_domain END AS reason FROM items),
cut AS (SELECT id, reason, lower(search_text) AS body, list_filter(list_transform(regexp_split_to_array(regexp_replace(reason, '\\([^)]*\\)', ' ', 'g'), '[+,]'), lambda x: trim(x)), lambda x: x <> '') AS terms FROM said)
SELECT id, array_to_string(terms, '|') AS terms, starts_with(lower(reason), 'similar meaning') AS vacuous, array_to_string(list_filter(terms, lambda t: NOT contains(body, lower(t))), '|') AS unfounded FROM cut""")
def reason_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms a reason claims, which of them the text lacks, and whether it explains anything."""
    named = F.concat(F.element_at("topics", 1), F.lit(" + "), "category", F.lit(" (in the content), "), "source_domain")
    rows = items(spark, sf_dir).select("id", F.when(F.col("intent").isNull(), "Similar meaning").otherwise(named).alias("reason"), F.lower("search_text").alias("body"))
    terms = rows.select("id", "reason", "body", text.reason_terms(F.col("reason")).alias("terms"))
    lacking = F.filter("terms", lambda t: ~F.contains(F.col("body"), F.lower(t)))
    return terms.select("id", F.array_join("terms", "|").alias("terms"), text.vacuous_reason(F.col("reason")).alias("vacuous"), F.array_join(lacking, "|").alias("unfounded"))


@query(r"""SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN '/' || regexp_extract(url, '^https?://([^/?#:]*)', 1) || '/{page_id}' END, 'unmatched') AS route, 'page-' || page_id AS request_id, NULL::VARCHAR AS forged FROM pages""")
def logged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route templates may be logged, addresses may not; a request id of more than one line is none."""
    host = F.regexp_extract("url", r"^https?://([^/?#:]*)", 1)
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/"), host, F.lit("/{page_id}"))).otherwise(F.col("url"))
    request = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", text.safe_route(path).alias("route"), text.safe_request_id(request).alias("request_id"), text.safe_request_id(F.concat(request, F.lit("\n"), "url")).alias("forged"))


@query(r"""SELECT page_id, regexp_replace('/s/' || sha256(url) || '/view?page=' || page_id || ' /api/v1/shares/' || page_id, '(/(?:s|api/v1/shares)/)[^/?#\s]+', '\1<share-token>', 'g') AS masked FROM pages""")
def masked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share tokens never stand in a logged path."""
    page = F.col("page_id").cast("string")
    path = F.concat(F.lit("/s/"), F.sha2("url", 256), F.lit("/view?page="), page, F.lit(" /api/v1/shares/"), page)
    return table(spark, sf_dir, "pages").select("page_id", text.mask_share_paths(path).alias("masked"))


@query(f"""{with_tables('items')} SELECT id, replace(replace('read ' || title || ' of ' || source_domain || ' as ' || source_domain || '/' || category, source_domain || '/' || category, '<' || substr(sha256(source_domain || '/' || category), 1, 12) || '>'),
source_domain, '<' || substr(sha256(source_domain), 1, 12) || '>') AS masked FROM items WHERE title IS NOT NULL""")
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private values go from a message, the longest first, so none leaves a part of itself."""
    path = F.concat("source_domain", F.lit("/"), "category")
    message = F.concat(F.lit("read "), "title", F.lit(" of "), "source_domain", F.lit(" as "), path)
    return items(spark, sf_dir).where("title is not null").select("id", text.redact_known(message, F.array("source_domain", path)).alias("masked"))


@query()
def timed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts with a marker a turn, in chunks of 40 words numbered through the whole text."""
    line = F.concat(F.lit("["), clock.stamp(F.col("turn") * 75), F.lit("] "), F.col("text"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("s"))
    scripts = turns.select("conv_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("script"))
    return text.timed_chunks(scripts, "conv_id", "script", size=40, step=32)
