"""Library reads, joins and aggregates over the bound tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import clock, text
from lodestone.operators import filters, merges
from lodestone.session import table
from lodestone.sources import binders, sinks
from lodestone.sources.binders import NOW, TOPIC_LABELS, events, items, memories, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


ITEMS = with_tables("items")
SEARCHABLE = "status = 'ready' AND deleted_s IS NULL AND (link_only OR coalesce(brief_source, '') <> 'fallback')"

# -- reads -------------------------------------------------------------------


@query(f"{ITEMS} SELECT id, created_s, coalesce(edited_title, title) AS title, coalesce(edited_summary, CASE WHEN NOT link_only THEN summary END) AS summary, edited_title IS NOT NULL OR edited_summary IS NOT NULL AS edited FROM items WHERE {SEARCHABLE}")
def searchable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search may return, as it is displayed."""
    edited = F.col("edited_title").isNotNull() | F.col("edited_summary").isNotNull()
    return items(spark, sf_dir).where(filters.searchable()).select("id", "created_s", filters.display_title().alias("title"), filters.display_summary().alias("summary"), edited.alias("edited"))


CURSOR = (binders.EPOCH + 150 * binders.STEP, 150)


@query(f"{ITEMS} SELECT id, created_s, category FROM items WHERE deleted_s IS NULL AND (created_s, id) < ({CURSOR[0]}, {CURSOR[1]}) ORDER BY created_s DESC, id DESC LIMIT 21")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a cursor, one row more than shown so the next cursor is known."""
    rows = items(spark, sf_dir).where(F.col("deleted_s").isNull() & filters.before_cursor(*CURSOR))
    return rows.select("id", "created_s", "category").orderBy(F.col("created_s").desc(), F.col("id").desc()).limit(21)


@query(f"{ITEMS} SELECT id, created_s FROM items WHERE category = 'video' ORDER BY created_s DESC, id DESC LIMIT 10 OFFSET 5")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline mirror's page."""
    return items(spark, sf_dir).where("category = 'video'").select("id", "created_s").orderBy(F.col("created_s").desc(), F.col("id").desc()).offset(5).limit(10)


@query(f"{ITEMS} SELECT id FROM items WHERE list_contains(list_transform(topics, lambda x: lower(x)), 'science')")
def facet_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, J13."""
    return items(spark, sf_dir).where(filters.has_topic(" Science ")).select("id")


@query(f"{ITEMS} SELECT id FROM items WHERE list_contains(tools, 'Tool 3') OR list_contains(people, 'Tool 3')")
def facet_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole words only, so ``tool`` alone would match every tool and ``too`` none."""
    return items(spark, sf_dir).where(filters.has_entity("tool 3")).select("id")


@query(f"{ITEMS} SELECT id, created_s FROM items WHERE created_s >= {binders.EPOCH + 86400} AND created_s < {binders.EPOCH + 172800}")
def facet_saved_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    return items(spark, sf_dir).where(filters.saved_on(binders.EPOCH + 86_400)).select("id", "created_s")


@query(f"{ITEMS} SELECT id FROM items WHERE lower(category) = 'recipe' AND lower(intent) = 'project' AND lower(source_domain) LIKE 'src1%'")
def facet_type_intent_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    return items(spark, sf_dir).where((F.lower("category") == "recipe") & (F.lower("intent") == "project") & F.startswith(F.lower("source_domain"), F.lit("src1"))).select("id")


@query(f"{ITEMS} SELECT id, category FROM items WHERE {SEARCHABLE} AND category = 'tool' AND id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def category_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality and an id list; the list is a semi join, and an empty one allows nothing."""
    ids = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return filters.allow_list(items(spark, sf_dir).where(filters.searchable() & (F.col("category") == "tool")).select("id", "category"), ids)


@query(f"{ITEMS} SELECT id FROM items WHERE created_s >= {binders.EPOCH + 100 * binders.STEP} AND created_s <= {binders.EPOCH + 300 * binders.STEP}")
def saved_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """both ends count."""
    return items(spark, sf_dir).where(F.col("created_s").between(binders.EPOCH + 100 * binders.STEP, binders.EPOCH + 300 * binders.STEP)).select("id")


@query(f"{ITEMS} SELECT id FROM items WHERE contains(lower(search_text), 'tion the') OR contains(lower(coalesce(title, '')), 'tion the')")
def substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a literal, so LIKE's wildcards need no escape."""
    found = F.contains(F.lower("search_text"), F.lit("tion the")) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("tion the"))
    return items(spark, sf_dir).where(found).select("id")


@query(f"{ITEMS} SELECT user_id, id, created_s FROM items WHERE created_s < {NOW} - 604800 AND opened_s IS NULL AND deleted_s IS NULL")
def forgotten_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15."""
    return items(spark, sf_dir).where(filters.forgotten(NOW)).select("user_id", "id", "created_s")


@query(f"{ITEMS} SELECT id, brief_source, needs_retry FROM items WHERE edited_title IS NULL AND edited_summary IS NULL AND (brief_source = 'fallback' OR needs_retry)")
def retry_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fallback briefs and rows marked for retry, never edited ones."""
    unedited = F.col("edited_title").isNull() & F.col("edited_summary").isNull()
    return items(spark, sf_dir).where(unedited & ((F.col("brief_source") == "fallback") | F.col("needs_retry"))).select("id", "brief_source", "needs_retry")


@query("""SELECT event_id, sha256(user_id::VARCHAR || ':' || event_id) AS token_hash FROM events WHERE event_type = 'purchase' AND event_id % 3 <> 0 AND floor(epoch(ts))::BIGINT + 604800 > (SELECT round(median(floor(epoch(ts))::BIGINT))::BIGINT FROM events WHERE event_id < 100)""")
def active_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares neither revoked nor expired, by the hash of their token."""
    log = events(spark, sf_dir)
    now = log.where("event_id < 100").agg(F.round(F.median("at_s")).cast("long").alias("now_s"))
    live = log.where("event_type = 'purchase' and event_id % 3 <> 0").crossJoin(F.broadcast(now)).where(F.col("at_s") + 604_800 > F.col("now_s"))
    return live.select("event_id", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string")), 256).alias("token_hash"))


# -- joins -------------------------------------------------------------------


@query("SELECT c_custkey, c_name, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
def left_join_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every owner, with what belongs to it or nulls."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that nothing refers to, by anti joins."""
    poor = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    owners = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return owners.join(poor, "c_nationkey", "left_anti").select("c_custkey")


@query(f"{with_tables('items', 'memories')} SELECT i.id, i.user_id, m.user_note FROM items i JOIN memories m ON i.content_id = m.content_id AND i.user_id = m.user_id AND i.id = m.memory_of")
def memory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite key keeps notes with their author."""
    notes = memories(spark, sf_dir).select("content_id", "user_id", F.col("memory_of").alias("id"), "user_note")
    return items(spark, sf_dir).select("id", "user_id", "content_id").join(notes, ["content_id", "user_id", "id"]).select("id", "user_id", "user_note")


@query(f"""{ITEMS}, copies AS (SELECT content_id, count(*) AS n, min(created_s) AS first_s FROM items WHERE content_id IS NOT NULL GROUP BY content_id)
SELECT i.id, c.n FROM items i JOIN copies c ON i.content_id = c.content_id WHERE c.n > 1 AND i.created_s > c.first_s""")
def later_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A self join on time, as one aggregation joined back."""
    own = items(spark, sf_dir).where("content_id is not null").select("id", "content_id", "created_s")
    copies = own.groupBy("content_id").agg(F.count("*").alias("n"), F.min("created_s").alias("first_s")).where("n > 1")
    return own.join(copies, "content_id").where("created_s > first_s").select("id", "n")


@query(f"""{ITEMS}, kept AS (SELECT content_id, min(id) AS id, count(*) AS n_merged, arg_min(edited_title, id) FILTER (edited_title IS NOT NULL) AS edited_title, arg_min(intent, id) FILTER (intent IS NOT NULL) AS intent FROM items WHERE content_id IS NOT NULL GROUP BY content_id)
SELECT content_id, id, edited_title, intent, n_merged FROM kept""")
def asset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest copy survives and takes missing fields from the others."""
    return merges.survivors(items(spark, sf_dir).where("content_id is not null"), "content_id", ["id"], ["edited_title", "intent"])


@query(f"""{ITEMS}, members AS (SELECT DISTINCT content_id, user_id FROM items WHERE content_id IS NOT NULL), assets AS (SELECT DISTINCT content_id FROM items WHERE content_id IS NOT NULL AND id % 2 = 0)
SELECT a.content_id, m.user_id, md5(a.content_id || '|' || m.user_id) AS copy_id FROM assets a JOIN members m ON a.content_id = m.content_id""")
def split_per_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy for each distinct member; ``split_assets`` moves their rows too."""
    own = items(spark, sf_dir).where("content_id is not null")
    return merges.split_per_owner(own.where("id % 2 = 0").select("content_id").distinct(), own, "content_id", "user_id").select("content_id", "user_id", "copy_id")


@query("""SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row wins."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return merges.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n <= 10""")
def newest_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten of each owner; Spark's group limit cuts before the shuffle."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return merges.within_group(rows, ["l_suppkey"], [F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber")], 10).drop("l_shipdate")


@query("""WITH local AS (SELECT event_id AS id, value AS v, event_id % 5 = 0 AS dirty FROM events WHERE event_id % 2 = 0), remote AS (SELECT event_id AS id, value + 1 AS v FROM events WHERE event_id % 3 = 0)
SELECT coalesce(l.id, r.id) AS id, round(CASE WHEN coalesce(l.dirty, false) THEN l.v ELSE r.v END, 6) AS v, coalesce(l.dirty, false) AS dirty FROM local l FULL JOIN remote r ON l.id = r.id WHERE coalesce(l.dirty, false) OR r.id IS NOT NULL""")
def reconcile_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty local rows win, clean ones missing remotely go; ``reminder_sync`` is the merge of reminders."""
    log = table(spark, sf_dir, "events")
    local = log.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("value").alias("v"), (F.col("event_id") % 5 == 0).alias("dirty"))
    remote = log.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), (F.col("value") + 1).alias("v"))
    return merges.reconcile(local, remote, "id", "v", "dirty").withColumn("v", F.round("v", 6))


@query("""WITH stored AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND event_id % 4 = 0)
SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM stored) GROUP BY user_id""")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows whose key isn't stored, the first of each."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    stored = log.where("event_type = 'view' and event_id % 4 = 0")
    fresh = log.where("event_type = 'click'").join(stored.select("user_id").distinct(), "user_id", "left_anti")
    return fresh.groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("""WITH t AS (SELECT user_id AS token_owner, event_id % 97 AS token, at_s, event_id FROM (SELECT *, floor(epoch(ts))::BIGINT AS at_s FROM events))
SELECT token, arg_max(token_owner, (at_s, event_id)) AS owner, min(at_s) AS created_s, max(at_s) AS updated_s FROM t GROUP BY token""")
def device_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last registrant owns a token; its first time stays."""
    rows = events(spark, sf_dir).select((F.col("event_id") % 97).alias("token"), "user_id", "at_s", "event_id")
    return rows.groupBy("token").agg(F.max_by("user_id", F.struct("at_s", "event_id")).alias("owner"), F.min("at_s").alias("created_s"), F.max("at_s").alias("updated_s"))


@query("""WITH coll AS (SELECT o_custkey AS collection, o_orderkey AS item FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT collection, count(*) AS n_items, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM coll GROUP BY collection""")
def collection_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered list per collection."""
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("collection"), F.col("o_orderkey").alias("item"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x.cast("string")), ",")
    return rows.groupBy("collection").agg(F.count("*").alias("n_items"), listed.alias("items"))


@query("""WITH snap AS (SELECT o_custkey AS snapshot, o_orderkey, o_orderstatus FROM orders) SELECT snapshot, count(*) AS original, count(*) FILTER (o_orderstatus <> 'F') AS available FROM snap GROUP BY snapshot""")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot held and what is still there."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("snapshot")).agg(F.count("*").alias("original"), F.count_if(F.col("o_orderstatus") != "F").alias("available"))


@query(f"""{ITEMS}, wanted AS (SELECT id % 8 AS collection, id % 3 AS part, count(*) AS n, count(*) FILTER ({SEARCHABLE}) AS resolved FROM items GROUP BY 1, 2)
SELECT collection, part, CASE WHEN n = resolved THEN 'replaced' ELSE 'rejected' END AS outcome FROM wanted""")
def membership_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members must resolve, or nothing changes."""
    own = items(spark, sf_dir).groupBy((F.col("id") % 8).alias("collection"), (F.col("id") % 3).alias("part")).agg(F.count("*").alias("n"), F.count_if(filters.searchable()).alias("resolved"))
    return own.select("collection", "part", F.when(F.col("n") == F.col("resolved"), "replaced").otherwise("rejected").alias("outcome"))


# -- aggregates --------------------------------------------------------------


@query("SELECT user_id, event_type AS content, count(*) AS save_count, min(floor(epoch(ts))::BIGINT) AS first_s, max(floor(epoch(ts))::BIGINT) AS last_s FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type")
def save_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, Q7: accepted saves, first and last time; rows without a content are skipped."""
    rows = events(spark, sf_dir).where("event_type is not null")
    return rows.groupBy("user_id", F.col("event_type").alias("content")).agg(F.count("*").alias("save_count"), F.min("at_s").alias("first_s"), F.max("at_s").alias("last_s"))


@query(f"{ITEMS} SELECT user_id, count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM items GROUP BY user_id")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts in one pass."""
    return items(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("total"), *(F.count_if(F.lower("status") == s).alias(s) for s in ("ready", "failed", "pending")))


BOUNDS = [1000.0, 5000.0, 20000.0, 50000.0]


@query("SELECT l_returnflag, " + ", ".join(f"count(*) FILTER (l_extendedprice <= {b}) AS le_{str(b).replace('.', '_')}" for b in BOUNDS) + ", count(l_extendedprice) AS le_inf, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag")
def histogram_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bucket up to its bound, in one pass."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*clock.cumulative_buckets(F.col("l_extendedprice"), BOUNDS)).withColumn("total", F.round("total", 2))


@query("SELECT l_shipmode_group, " + ", ".join(f"quantile_disc(l_quantity, {p}) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_group, l_quantity FROM lineitem) GROUP BY 1")
def quantiles_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode_group"), "l_quantity")
    return rows.groupBy("l_shipmode_group").agg(*clock.nearest_rank("l_quantity", 0.5, 0.95, 0.99))


@query(f"{ITEMS} SELECT DISTINCT user_id, lower(t) AS tag FROM (SELECT user_id, unnest(topics) AS t FROM items)")
def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return items(spark, sf_dir).select("user_id", F.explode("topics").alias("t")).select("user_id", F.lower("t").alias("tag")).distinct()


@query(f"{ITEMS} SELECT content_id, count(DISTINCT user_id) AS n_users, bool_or(status = 'pending') AS has_pending FROM items WHERE content_id IS NOT NULL GROUP BY content_id")
def users_per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8, U12."""
    return items(spark, sf_dir).where("content_id is not null").groupBy("content_id").agg(F.countDistinct("user_id").alias("n_users"), F.bool_or(F.col("status") == "pending").alias("has_pending"))


_ORDINAL = "list_position([" + ", ".join(f"'{x}'" for x in TOPIC_LABELS) + "], topic)"


@query(f"""{ITEMS}, counted AS (SELECT user_id, topic, count(DISTINCT id) AS n FROM (SELECT user_id, id, unnest(topics) AS topic FROM items WHERE deleted_s IS NULL) GROUP BY user_id, topic)
SELECT user_id, topic, n, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, {_ORDINAL}) AS place FROM counted) WHERE place <= 2""")
def topic_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most frequent topics, ties in catalogue order."""
    counted = items(spark, sf_dir).where("deleted_s is null").select("user_id", "id", F.explode("topics").alias("topic")).groupBy("user_id", "topic").agg(F.countDistinct("id").alias("n"))
    ordinal = F.array_position(F.array(*map(F.lit, TOPIC_LABELS)), F.col("topic"))
    return counted.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("n").desc(), ordinal))).where("place <= 2")


@query(f"""{ITEMS} SELECT user_id, label, count(DISTINCT url) AS size FROM (SELECT user_id, url, CASE WHEN regexp_matches(x, '(?i)^claude(?:\\s|$)') THEN 'Claude' ELSE trim(x) END AS label FROM (SELECT user_id, url, unnest(list_concat(topics, tools)) AS x FROM items WHERE deleted_s IS NULL))
WHERE len(label) BETWEEN 1 AND 80 GROUP BY user_id, label HAVING count(DISTINCT url) >= 2""")
def auto_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by topic and tool of two distinct links or more; tools of one family share a label."""
    raw = items(spark, sf_dir).where("deleted_s is null").select("user_id", "url", F.explode(F.array_union("topics", "tools")).alias("x"))
    rows = raw.select("user_id", "url", F.when(F.col("x").rlike(r"(?i)^claude(?:\s|$)"), "Claude").otherwise(F.trim("x")).alias("label")).where("char_length(label) between 1 and 80")
    return rows.groupBy("user_id", "label").agg(F.countDistinct("url").alias("size")).where("size >= 2")


@query(f"{with_tables('log')} SELECT user_id, at_s // 86400 AS day, count(*) AS n, count(*) >= 3 AS over FROM log WHERE event_type = 'click' GROUP BY 1, 2")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of a UTC day against a limit."""
    rows = events(spark, sf_dir).where("event_type = 'click'")
    return rows.groupBy("user_id", F.floor(F.col("at_s") / 86_400).alias("day")).agg(F.count("*").alias("n"), (F.count("*") >= 3).alias("over"))


@query(f"{with_tables('log')} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS trailing FROM log WHERE event_type IN ('click', 'view')")
def trailing_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses in the trailing day, by a range frame over each user's own events."""
    frame = W.partitionBy("user_id").orderBy("at_s").rangeBetween(-86_400, 0)
    return events(spark, sf_dir).where("event_type in ('click', 'view')").select("event_id", F.count("*").over(frame).alias("trailing"))


@query(f"{ITEMS} SELECT id, coalesce(min(deleted_s) OVER (PARTITION BY content_id), {NOW}) AS stamp FROM items WHERE content_id IS NOT NULL")
def min_delete_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias group shares its earliest deletion, else now; aggregated, then joined back."""
    own = items(spark, sf_dir).where("content_id is not null").select("id", "content_id", "deleted_s")
    first = own.groupBy("content_id").agg(F.min("deleted_s").alias("first_s"))
    return own.join(first, "content_id").select("id", F.coalesce("first_s", F.lit(NOW)).alias("stamp"))


@query(f"{ITEMS} SELECT id FROM items WHERE deleted_s IS NOT NULL AND deleted_s <= {NOW} - 2592000 + 1900800 ORDER BY deleted_s, id LIMIT 50")
def purge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest fifty deletions past the undo window (here shortened); exactly at its end counts."""
    return items(spark, sf_dir).where(F.col("deleted_s") <= NOW - 2_592_000 + 1_900_800).orderBy("deleted_s", "id").limit(50).select("id")


@query(f"{ITEMS} SELECT id, CASE WHEN status = 'failed' AND id % 2 = 0 THEN NULL ELSE search_text END IS NULL AS purged FROM items")
def raw_text_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text overwritten by null where it is due."""
    due = (F.col("status") == "failed") & (F.col("id") % 2 == 0)
    return items(spark, sf_dir).select("id", F.when(~due, F.col("search_text")).isNull().alias("purged"))


@query("SELECT user_id, min(floor(epoch(ts))::BIGINT) AS first_open_s FROM events WHERE event_type = 'view' GROUP BY user_id")
def first_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set once."""
    return events(spark, sf_dir).where("event_type = 'view'").groupBy("user_id").agg(F.min("at_s").alias("first_open_s"))


@query("""SELECT part, arg_min(p_partkey, p_partkey) AS head, sum(p_size)::BIGINT AS size, count(*) AS n FROM (SELECT p_partkey, p_size, p_partkey // 8 AS part FROM part) GROUP BY part""")
def tree_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours merged two by two; three levels."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("at"), F.col("p_partkey").alias("head"), F.col("p_size").cast("long").alias("size"), F.lit(1).cast("long").alias("n"))
    for _ in range(3):
        rows = rows.groupBy(F.floor(F.col("at") / 2).alias("at")).agg(F.min("head").alias("head"), F.sum("size").alias("size"), F.sum("n").alias("n"))
    return rows.select(F.col("at").alias("part"), "head", "size", "n")


@query(f"{ITEMS} SELECT id, user_id, sha256(user_id || '|' || id || '|' || created_s) AS etag, strftime(make_timestamp(created_s * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000000Z|' || id AS cursor FROM items")
def cursor_and_etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X57, X58."""
    etag = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("user_id", "id", "created_s"))), 256)
    cursor = F.concat(F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("|"), F.col("id").cast("string"))
    return items(spark, sf_dir).select("id", "user_id", etag.alias("etag"), cursor.alias("cursor"))


@query(f"""{ITEMS} SELECT id, CASE WHEN status = 'failed' OR needs_retry THEN CASE WHEN contains(lower(title), 'the') THEN 'unavailable' WHEN contains(lower(title), 'en') THEN 'blocked' ELSE 'other' END END AS failure,
coalesce(edited_title, title) AS title, array_to_string(topics, ', ') AS topic_line FROM items""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class only for failed or retried rows; ``item_details`` has the messages."""
    has = lambda s: F.contains(F.lower("title"), F.lit(s))
    kind = F.when((F.col("status") == "failed") | F.col("needs_retry"), F.when(has("the"), "unavailable").when(has("en"), "blocked").otherwise("other"))
    return items(spark, sf_dir).select("id", kind.alias("failure"), filters.display_title().alias("title"), F.array_join("topics", ", ").alias("topic_line"))


_REASON = "lower(coalesce(search_text, ''))"


@query(f"""{ITEMS} SELECT id, coalesce(edited_title, title) AS title, coalesce(edited_summary, CASE WHEN NOT link_only THEN summary END) AS summary, edited_title IS NOT NULL OR edited_summary IS NOT NULL AS edited,
array_to_string(CASE WHEN len(topics) > 1 THEN topics ELSE list_concat(topics, tools) END, ', ') AS topic_line, CASE WHEN status = 'failed' OR needs_retry THEN
  CASE WHEN regexp_matches({_REASON}, '{"|".join(filters.ACCESS_WORDS)}') THEN '{filters.ACCESS}' WHEN regexp_matches({_REASON}, '{"|".join(filters.OUTAGE_WORDS)}') THEN '{filters.OUTAGE}' ELSE '{filters.UNREADABLE}' END END AS failure FROM items""")
def item_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A save as it is shown: overlaid fields, topics of its second brief or else of its first, and what went wrong in the user's words."""
    own = items(spark, sf_dir)
    second = F.when(F.size("topics") > 1, F.col("topics"))
    failure = filters.failure_message(F.col("status"), F.col("needs_retry"), F.col("search_text"))
    edited = F.col("edited_title").isNotNull() | F.col("edited_summary").isNotNull()
    return own.select("id", filters.display_title().alias("title"), filters.display_summary().alias("summary"), edited.alias("edited"), F.array_join(F.coalesce(second, F.concat("topics", "tools")), ", ").alias("topic_line"), failure.alias("failure"))


@query(f"{ITEMS} SELECT id, trim(regexp_replace(concat_ws(' ', coalesce(edited_title, title), summary, array_to_string(topics, ' '), array_to_string(tools, ' '), url), '\\s+', ' ', 'g')) AS document, sha256(concat_ws(' ', title, summary)) AS content_hash FROM items")
def search_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat text that is indexed."""
    flat = F.concat_ws(" ", filters.display_title(), "summary", F.array_join("topics", " "), F.array_join("tools", " "), "url")
    return items(spark, sf_dir).select("id", text.whitespace(flat).alias("document"), F.sha2(F.concat_ws(" ", "title", "summary"), 256).alias("content_hash"))


# -- sources and sinks -------------------------------------------------------


@query(f"{ITEMS} SELECT id, 'raw/' || id || '/' || substr(sha256(search_text), 1, 16) || '.json' AS path FROM items")
def snapshot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8, S9."""
    return items(spark, sf_dir).select("id", sinks.snapshot_path(F.col("id"), F.col("search_text")).alias("path"))


@query(f"{ITEMS} SELECT 'items_total{{status=\"' || status || '\"}} ' || count(*) AS line FROM items GROUP BY status")
def metrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11."""
    return sinks.prometheus(items(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")), "items_total", "status", "n")


@query()
def account_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every save as JSON with its owner's note."""
    return sinks.export_saves(items(spark, sf_dir), memories(spark, sf_dir))


@query()
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures split into accepted and rejected rows."""
    pages = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 17 != 0, F.col("page_id")).alias("client_id"), F.when(F.col("page_id") % 13 == 0, F.lit("http://127.0.0.1/x")).otherwise(F.col("url")).alias("url"))
    accepted, rejected = sinks.ingest_batch(pages)
    return accepted.select("client_id", "canonical_url", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("client_id", F.lit(None).cast("string").alias("canonical_url"), "reason"))


@query(f"""{ITEMS}, cached AS (SELECT i.id, a.id AS asset, a.opened_s AS processed_s FROM items i LEFT JOIN items a ON i.content_id = a.content_id AND a.status = 'ready' AND a.brief_source = 'model')
SELECT id, arg_max(asset, (coalesce(processed_s, -1), asset)) AS asset FROM cached GROUP BY id""")
def evidence_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's newest acceptable evidence, or null."""
    own = items(spark, sf_dir)
    newest = F.max_by("id", F.struct(F.coalesce("opened_s", F.lit(-1)), "id")).alias("asset")
    assets = own.where("status = 'ready' and brief_source = 'model'").groupBy("content_id").agg(newest)
    return own.select("id", "content_id").join(assets, "content_id", "left").select("id", "asset")


@query("""WITH q AS (SELECT event_id AS id, user_id, at_s FROM (SELECT *, floor(epoch(ts))::BIGINT AS at_s FROM events) WHERE event_type = 'error'), done AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) AS done_s FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT q.id, q.at_s, d.done_s IS NOT NULL AS enriched FROM q LEFT JOIN done d ON q.user_id = d.user_id ORDER BY q.at_s, q.id LIMIT 20""")
def offline_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest twenty pending saves, with what is known of them."""
    log = events(spark, sf_dir)
    oldest = log.where("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id", "at_s").orderBy("at_s", F.col("event_id")).limit(20)
    done = log.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("at_s").alias("done_s"))
    return oldest.join(done, "user_id", "left").select("id", "at_s", F.col("done_s").isNotNull().alias("enriched"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS owner, epoch(o_orderdate)::BIGINT AS due_s, o_orderstatus = 'F' AS delivered FROM orders)
SELECT r.id, c_name AS owner_name, r.due_s, CASE WHEN r.due_s <= 1000000000 THEN true ELSE delivered END AS delivered FROM r JOIN customer ON owner = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders with their owner; those past are delivered."""
    due = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("due_s"), (F.col("o_orderstatus") == "F").alias("delivered"))
    owners = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner_name"))
    return due.join(owners, "o_custkey").select("id", "owner_name", "due_s", (F.col("delivered") | (F.col("due_s") <= 1_000_000_000)).alias("delivered"))


@query(f"{ITEMS} SELECT id, user_id, coalesce(nullif(trim(CASE WHEN id % 4 = 0 THEN 'kept' END), ''), CASE WHEN id % 4 = 1 THEN NULL ELSE 'old note' END) AS note, nullif(left(trim(CASE WHEN id % 5 = 0 THEN '  ' ELSE title END), 120), '') AS title FROM items")
def note_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only supplied fields change; blank ones are null."""
    i = F.col("id")
    new, old = F.when(i % 4 == 0, "kept"), F.when(i % 4 != 1, "old note")
    return items(spark, sf_dir).select("id", "user_id", F.coalesce(F.nullif(F.trim(new), F.lit("")), old).alias("note"), F.nullif(F.substring(F.trim(F.when(i % 5 == 0, "  ").otherwise(F.col("title"))), 1, 120), F.lit("")).alias("title"))
