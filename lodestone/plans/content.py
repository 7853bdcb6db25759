"""Identity, text, time and evaluation queries, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import clock, identity, text
from lodestone.operators import captures, evaluate
from lodestone.session import table
from lodestone.sources.binders import NOW, TOPIC_LABELS, events, items, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# -- identity ----------------------------------------------------------------


@query()
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Arrow UDF gives all that needs a parsed URL."""
    return table(spark, sf_dir, "pages").select("page_id", "url", identity.url_parts("url").alias("p")).select("page_id", "url", "p.*")


@query(r"""SELECT page_id, replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), 'www.', '') AS domain,
CASE WHEN contains(domain, 'youtube.com') OR contains(domain, 'youtu.be') THEN 'youtube' WHEN contains(domain, 'tiktok.com') THEN 'tiktok' WHEN contains(domain, 'instagram.com') THEN 'instagram' WHEN contains(domain, 'amazon.') THEN 'product' ELSE 'article' END AS kind,
substr(sha256(url), 1, 12) AS short_hash FROM pages""")
def source_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2, X3, X12."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", identity.source_domain(F.col("url")).alias("domain"))
    return rows.select("page_id", "domain", identity.source_type(F.col("domain")).alias("kind"), identity.short_hash(F.col("url")).alias("short_hash"))


@query()
def dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures by their identity: how many share a key, and the first of them."""
    rows = table(spark, sf_dir, "pages").select("page_id", identity.url_parts("url").alias("parts"), identity.normalized_content("html").alias("plain"))
    keyed = rows.select("page_id", identity.dedupe_key(F.col("parts"), F.col("plain")).alias("key"))
    return keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(r"""SELECT doc_id, CASE WHEN norm <> '' THEN 'sha256:' || sha256(norm) END AS key FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7F]'))""")
def content_hash_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On ASCII texts, where normalization is lower case without punctuation."""
    rows = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return rows.select("doc_id", identity.content_hash(identity.normalized_content("text")).alias("key"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)\.html$') THEN 'page' END AS kind, list_distinct([regexp_replace(u, '[.,;:!?)\]}]+$', '') FOR u IN regexp_extract_all('see ' || url || ', and ' || url || '.', 'https?://[^\s<>"]+')])[1] AS link FROM pages""")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a text, once each, without the punctuation after them."""
    said = F.concat(F.lit("see "), F.col("url"), F.lit(", and "), F.col("url"), F.lit("."))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").rlike(r"(?i)\.html$"), "page").alias("kind"), F.element_at(identity.extract_urls(said), 1).alias("link"))


@query()
def media_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform and id of video links."""
    urls = F.concat(F.lit("https://www.youtube.com/watch?v=abcdefg"), F.format_string("%04d", F.col("page_id") % 10000), F.lit("&t=4"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, urls).otherwise(F.col("url")).alias("url"))
    return rows.select("page_id", identity.video_source(F.col("url")).alias("video"), identity.url_parts("url")["platform_id"].alias("platform_id"))


# -- text --------------------------------------------------------------------


@query(rf"""SELECT item_id, array_to_string(list_filter(list_distinct_ordered, lambda w: NOT list_contains({quoted(text.STOPWORDS)}, w)), ' ') AS terms FROM (
SELECT item_id, list_filter(l, lambda w, i: list_position(l, w) = i) AS list_distinct_ordered FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w)) AS l FROM benchmark))""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here on passages without inner punctuation marks."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain, regexp_matches(trim(text), '(?i)^(?:link:\s*)?https?://\S+\s*$') AS url_only FROM documents")
def whitespace_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X22, X23."""
    return table(spark, sf_dir, "documents").select("doc_id", text.whitespace(F.col("text")).alias("plain"), F.trim("text").rlike(r"(?i)^(?:link:\s*)?https?://\S+\s*$").alias("url_only"))


def _case(hay: str, families: dict[str, list[str]]) -> str:
    return " ".join(f"WHEN {' OR '.join(f'contains({hay}, {quoted([w])[1:-1]})' for w in words)} THEN '{name}'" for name, words in families.items())


@query(rf"""{with_tables("items")} SELECT id, CASE WHEN regexp_matches(coalesce(title, ''), '^\s*\d{{1,3}}\s+\S') THEN 'list' {_case("lower(coalesce(title, '') || chr(10) || substr(search_text, 1, 4000))", text.PROFILE_MARKERS)} WHEN len(regexp_extract_all(search_text, '(?:^|\s)\d+[.)]\s+')) >= 2 THEN 'list' ELSE 'general' END AS profile,
CASE {_case("lower(coalesce(title, '') || ' ' || search_text)", text.CATEGORY_WORDS)} ELSE 'article' END AS category, CASE {_case("lower(search_text)", text.INTENT_PHRASES)} END AS intent FROM items""")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X24, X25, X27, Q8."""
    return text.classified(items(spark, sf_dir), "id", "title", "search_text")


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
n AS (SELECT doc_id, text, words, CASE WHEN len(words) <= 800 THEN 1 ELSE ceil((len(words) - 800) / 640.0)::INT + 1 END AS n FROM w)
SELECT doc_id, i AS chunk_idx, CASE WHEN len(words) <= 800 THEN text ELSE array_to_string(words[i * 640 + 1 : i * 640 + 800], ' ') END AS chunk_text FROM (SELECT *, unnest(range(n)) AS i FROM n)""")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows; a text that fits one is kept verbatim."""
    return text.word_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def timed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts with a marker a turn."""
    turns = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("["), clock.stamp(F.col("turn") * 75), F.lit("] "), F.col("text"))
    scripts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("script"))
    return text.timed_sections(scripts, "conv_id", "script")


@query("SELECT conv_id, string_agg(turn || ': ' || role, ' > ' ORDER BY turn, role, text) AS outline, count(*) AS n FROM conversations GROUP BY conv_id")
def numbered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns in order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("s"), F.count("*").alias("n"))
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: F.concat(x["turn"].cast("string"), F.lit(": "), x["role"])), " > ").alias("outline"), "n")


@query(r"""WITH d AS (SELECT doc_id, source, regexp_replace(regexp_replace(coalesce(text, ''), '!\[[^\[\]\n]*\]\([^()\s]*\)', '', 'g'), '\[([^\[\]\n]*)\]\([^()\s]*\)', '\1', 'g') AS text FROM documents),
l AS (SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[ *#\t\r]+|[ *\t\r]+$', '', 'g'), '^(?:Title|URL Source|Published Time|Markdown Content):.*$', '')) AS lines FROM d),
s AS (SELECT DISTINCT doc_id, source, lower(x) AS line FROM (SELECT doc_id, source, unnest(lines) AS x FROM l) WHERE x <> '' AND len(regexp_extract_all(x, '\S+')) <= 4),
n AS (SELECT source, count(*) AS captures FROM documents GROUP BY source), c AS (SELECT source, line, count(*) AS k FROM s GROUP BY ALL),
known AS (SELECT c.source, list(line) AS known FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE k >= 5 AND k > 0.02 * captures GROUP BY c.source)
SELECT doc_id, array_to_string(list_filter(lines, lambda x: x <> '' AND NOT coalesce(list_contains(known, lower(x)), false) AND NOT regexp_matches(x, '^[\d.,]+\s?[KMB]?\s?\p{L}{0,12}(?:\s*[·|,]\s*[\d.,]+\s?[KMB]?\s?\p{L}{0,12})*$')), chr(10)) AS prose FROM l LEFT JOIN known k ON l.source IS NOT DISTINCT FROM k.source""")
def cleaned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose of captured texts, a source's interface lines told by how often they recur there."""
    return captures.prose(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


@query(r"""WITH d AS (SELECT page_id, html, regexp_extract(html, '(?i)target url returned error\s+(\d{3})', 1) AS code, len(regexp_extract_all(html, '\S+')) AS words FROM pages)
SELECT page_id, CASE WHEN coalesce(html, '') = '' THEN 'empty' WHEN code >= '500' THEN 'retry' WHEN code <> '' THEN 'empty' WHEN regexp_matches(trim(html), '(?i)^(?:link:\s*)?https?://\S+$') THEN 'empty'
  WHEN words < 60 AND regexp_matches(html, '(?i)captcha|verify you are human|video (?:currently )?unavailable') THEN 'empty' ELSE 'usable' END AS outcome FROM d""")
def capture_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which captures hold something, hold nothing, or are to be fetched again."""
    return table(spark, sf_dir, "pages").select("page_id", captures.outcome(F.col("html")).alias("outcome"))


@query(r"""WITH r AS (SELECT doc_id, text, string_split_regex(text, '[\p{L}\p{N} ''.,;:!?\-_()\[\]]+') AS between, regexp_extract_all(text, '[\p{L}\p{N} ''.,;:!?\-_()\[\]]+') AS found FROM documents)
SELECT doc_id, array_to_string(list_transform(list_zip(between, list_transform(found, lambda x: CASE WHEN len(x) >= 200 AND contains(x, ' ') THEN 'content=[private ' || substr(sha256(x), 1, 12) || ' ' || len(x) || ' chars]' ELSE x END)), lambda p: coalesce(p[1], '') || coalesce(p[2], '')), '') AS redacted FROM r""")
def redacted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long runs of prose become their digest, everything else stays."""
    return table(spark, sf_dir, "documents").select("doc_id", text.redact_long_runs(F.col("text")).alias("redacted"))


@query(rf"""{with_tables("items")} SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(topics, tools, ['saved', 'The ' || category]), lambda t: lower(t)), lambda t: t <> 'saved' AND NOT starts_with(t, 'the ')))), '|') AS tags FROM items""")
def clean_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X28."""
    raw = F.concat("topics", "tools", F.array(F.lit("saved"), F.concat(F.lit("The "), "category")))
    return items(spark, sf_dir).select("id", F.array_join(F.array_sort(text.clean_tags(raw)), "|").alias("tags"))


@query(f"{with_tables('items')} SELECT id, array_to_string(topics, '|') AS topics, NULL::VARCHAR AS unknown FROM items")
def semantic_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue labels in any case; a label that it lacks rejects the list."""
    lower = F.transform("topics", lambda t: F.concat(F.lit(" "), F.lower(t)))
    return items(spark, sf_dir).select("id", F.array_join(text.semantic_topics(lower, list(TOPIC_LABELS)), "|").alias("topics"), F.array_join(text.semantic_topics(F.array(F.lit("Other")), list(TOPIC_LABELS)), "|").alias("unknown"))


_STEM = " ".join(f"WHEN ends_with(w, '{s}') AND len(w) >= {len(s) + 4} THEN left(w, len(w) - {len(s)})" for s in text.SUFFIXES)


@query(f"SELECT w, CASE {_STEM} ELSE w END AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)")
def light_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("w")).distinct()
    return words.select("w", text.light_stem(F.col("w")).alias("stem"))


@query()
def typo_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's misspelt terms widened by the owner's own tags."""
    own = items(spark, sf_dir)
    tags = own.select(F.col("user_id").alias("owner"), F.explode("topics").alias("tag")).withColumn("tag", F.lower("tag"))
    queries = own.select(F.col("user_id").alias("owner"), F.col("id").alias("query_id"), F.array(F.regexp_replace(F.lower(F.element_at("topics", 1)), "e", "ee"), F.lit("the")).alias("terms"))
    return text.typo_expand(queries, tags)


@query(r"SELECT doc_id, len(text) - len(regexp_replace(text, '[0-9]{4,}', '#', 'g')) > 0 AS has_long_number, sha256(source)[1:12] AS source_hash, 'Text(' || len(text) || ' chars)' AS described FROM documents")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions without content."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("[0-9]{4,}").alias("has_long_number"), identity.short_hash(F.col("source")).alias("source_hash"), F.format_string("Text(%d chars)", F.char_length("text")).alias("described"))


@query(f"{with_tables('items')} SELECT id, CASE WHEN len(list_filter(regexp_split_to_array(search_text, '\\s+'), lambda x: x <> '')) >= 4 AND id % 3 = 0 THEN 'full_transcript' WHEN trim(coalesce(summary, '')) <> '' AND id % 3 = 1 THEN 'partial' ELSE 'metadata_only' END AS level FROM items")
def evidence_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript of four words or more, any other evidence, else metadata only; ``talk_evidence`` reads given evidence."""
    words = F.size(F.filter(F.split("search_text", r"\s+"), lambda w: w != ""))
    level = F.when((words >= 4) & (F.col("id") % 3 == 0), "full_transcript").when((F.trim(F.coalesce("summary", F.lit(""))) != "") & (F.col("id") % 3 == 1), "partial").otherwise("metadata_only")
    return items(spark, sf_dir).select("id", level.alias("level"))


# -- time --------------------------------------------------------------------

_PREF = "SELECT c_custkey AS owner, (c_custkey % 7)::INT AS weekday, (c_custkey % 24)::INT AS hour, (c_custkey % 4 * 15)::INT AS minute, CASE c_custkey % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Etc/GMT-3' ELSE 'Etc/GMT+8' END AS zone, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 10800 ELSE -28800 END AS shift FROM customer"


@query(f"""WITH pref AS ({_PREF}), loc AS (SELECT *, {NOW} + shift AS local_s FROM pref),
s AS (SELECT *, (local_s // 86400 - ((((local_s // 86400 + 3) % 7) - weekday + 7) % 7)) * 86400 + hour * 3600 + minute * 60 AS scheduled_s FROM loc)
SELECT owner, scheduled_s, local_s - scheduled_s BETWEEN 0 AND 899 AS due, strftime(make_timestamp(scheduled_s::BIGINT * 1000000), '%G-W%V') AS week FROM s""")
def weekly_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local wall clock within fifteen minutes after the preferred time; the scheduled day names the week."""
    k = F.col("c_custkey")
    zone = F.when(k % 3 == 0, "UTC").when(k % 3 == 1, "Etc/GMT-3").otherwise("Etc/GMT+8")
    pref = table(spark, sf_dir, "customer").select(k.alias("owner"), (k % 7).alias("weekday"), (k % 24).alias("hour"), (k % 4 * 15).alias("minute"), clock.local_seconds(F.lit(NOW), zone).alias("local_s"))
    args = [F.col(c) for c in ("local_s", "weekday", "hour", "minute")]
    scheduled = clock.scheduled(*args)
    return pref.select("owner", scheduled.alias("scheduled_s"), clock.weekly_due(*args).alias("due"), clock.iso_week(scheduled).alias("week"))


@query("SELECT event_id, least(2 * pow(2, least(greatest(event_id % 12 - 1, 0), 20)), 300)::BIGINT AS delay, least(30 * pow(2, least(greatest(event_id % 12 - 1, 0), 20)), 3600)::BIGINT AS media_delay FROM events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X51, X52, T16."""
    n = F.col("event_id") % 12
    return table(spark, sf_dir, "events").select("event_id", clock.backoff(n).alias("delay"), clock.media_delay(n).alias("media_delay"))


@query("SELECT l_orderkey, l_linenumber, printf('%02d:%02d', (l_partkey * 7) // 60, (l_partkey * 7) % 60) AS stamp, round((l_quantity * 3 + l_discount * 5) / 1000000.0, 9) AS cost FROM lineitem")
def stamps_and_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X38, X39, X59."""
    seconds = F.col("l_partkey") * 7
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clock.stamp(seconds).alias("stamp"), F.round(clock.provider_cost(F.col("l_quantity"), F.col("l_discount"), F.lit(3), F.lit(5)), 9).alias("cost"))


@query(f"""{with_tables('log')} SELECT user_id, count(*) FILTER (at_s > (SELECT max(at_s) FROM log) - 86400) > 0 AS alive, count(*) FILTER (at_s > (SELECT max(at_s) FROM log) - 86400) AS beats FROM log GROUP BY user_id""")
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners with a sign of life within the window."""
    log = events(spark, sf_dir)
    newest = log.agg(F.max("at_s").alias("newest"))
    recent = F.col("at_s") > F.col("newest") - 86_400
    return log.crossJoin(F.broadcast(newest)).groupBy("user_id").agg((F.count_if(recent) > 0).alias("alive"), F.count_if(recent).alias("beats"))


@query(f"""{with_tables('items')}, taken AS (SELECT DISTINCT user_id FROM items WHERE id % 5 = 0 AND user_id % 2 = 0)
SELECT user_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY created_s DESC, id DESC) AS ids FROM items WHERE created_s < {NOW} - 604800 AND opened_s IS NULL AND deleted_s IS NULL AND user_id NOT IN (SELECT user_id FROM taken) GROUP BY user_id""")
def weekly_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """forgotten saves of owners that have no snapshot of this week, newest first; all owners in one plan."""
    from lodestone.operators import filters

    own = items(spark, sf_dir)
    taken = own.where("id % 5 = 0 and user_id % 2 = 0").select("user_id").distinct()
    due = own.where(filters.forgotten(NOW)).join(taken, "user_id", "left_anti")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("created_s", "id")), asc=False), lambda x: x["id"].cast("string"))
    return due.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(listed, ",").alias("ids"))


# -- evaluation --------------------------------------------------------------


@query(r"""{0}, said AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(summary), '[a-z]{{4,}}'))) AS w, lower(search_text) AS body FROM items),
checked AS (SELECT id, count(*) AS n, count(*) FILTER (contains(body, w)) AS found FROM said GROUP BY id) SELECT id, n, round(found / n, 6) AS share, found / n >= 0.6 AS grounded FROM checked""".format(with_tables("items")))
def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a brief's longer words that its source has; ``grounded_answers`` is the measure with stems."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("summary"), F.lit("[a-z]{4,}"), 0))
    rows = items(spark, sf_dir).select("id", words.alias("words"), F.lower("search_text").alias("body")).where(F.size("words") > 0)
    found = F.size(F.filter("words", lambda w: F.contains(F.col("body"), w)))
    return rows.select("id", F.size("words").alias("n"), F.round(found / F.size("words"), 6).alias("share"), (found / F.size("words") >= 0.6).alias("grounded"))


_PAGE = r"""p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)', 1) AS title, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages)"""


@query(rf"""WITH {_PAGE}, k AS (SELECT *, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.')) AS pairs FROM p)
SELECT page_id, NOT regexp_matches(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*@') AND len(list_filter(pairs, lambda x: regexp_matches(string_split(x, '=')[1], '(?i){captures.SECRET_KEYS}'))) = 0 AND len(body) >= 40
  AND NOT regexp_matches(title, '(?i){captures.WALL_WORDS}') AND NOT regexp_matches(substr(body, 1, 2000), '(?i){captures.WALL_WORDS}') AS usable FROM k""")
def public_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """which fetched pages may be shared: no secret in the URL, long enough, behind no wall."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), r"\s+", " "))
    usable = captures.anonymous_usable(F.col("url"), F.lit("page"), F.regexp_extract("html", "<title>([^<]*)", 1), body, F.lit(False), F.lit(False))
    return table(spark, sf_dir, "pages").select("page_id", usable.alias("usable"))


@query(r"""WITH t AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN text END, ' ') AS said, string_agg(CASE WHEN role = 'user' THEN text END, ' ') AS asked, string_agg(CASE WHEN role NOT IN ('user', 'assistant') THEN text END, ' ') AS more FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(regexp_extract_all(coalesce(said, ''), '\S+')) >= 4 THEN 'full_transcript' WHEN trim(coalesce(asked, '')) <> '' OR trim(coalesce(more, '')) <> '' THEN 'partial' ELSE 'metadata_only' END AS level FROM t""")
def talk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a transcript, questions and anything else as other evidence."""
    said = lambda c: F.array_join(F.collect_list(F.when(c, F.col("text"))), " ")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said(F.col("role") == "assistant").alias("said"), said(F.col("role") == "user").alias("asked"), said(~F.col("role").isin("user", "assistant")).alias("more"))
    return talks.select("conv_id", captures.evidence_level(F.col("said"), [F.col("asked"), F.col("more")]).alias("level"))


@query()
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's answers as statements, held against all that was asked in it."""
    turns = table(spark, sf_dir, "conversations")
    listed = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    talks = turns.groupBy("conv_id").agg(listed("assistant").alias("said"), F.array_join(listed("user"), "\n").alias("body"))
    return evaluate.groundedness(talks, "conv_id", "said", "body").select("conv_id", "checked", "supported", F.size("unsupported").alias("unsupported"), "score")


@query(f"""{with_tables('items')} SELECT id, round(((len(title) > 0)::INT + (len(summary) >= 100)::INT + (len(topics) >= 2)::INT + (intent IS NOT NULL)::INT) / 4.0, 4) AS usefulness, brief_source = 'model' AND category IS NOT NULL AS extracted FROM items""")
def brief_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of named checks."""
    checks = [F.char_length("title") > 0, F.char_length("summary") >= 100, F.size("topics") >= 2, F.col("intent").isNotNull()]
    return items(spark, sf_dir).select("id", F.round(sum(c.cast("int") for c in checks) / 4, 4).alias("usefulness"), ((F.col("brief_source") == "model") & F.col("category").isNotNull()).alias("extracted"))


@query(f"""{with_tables('items')} SELECT id, contains(lower(search_text), 'the') AND contains(lower(search_text), 'and') AS right_reason FROM items""")
def explanation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term that a reason claims must be in what it was matched on."""
    claimed = F.split(F.regexp_replace(F.lit("the + and (in the content)"), r"\s*\([^)]*\)", ""), r"\s*[+,]\s*")
    return items(spark, sf_dir).select("id", F.forall(claimed, lambda t: F.contains(F.lower("search_text"), t)).alias("right_reason"))
