"""Job, reuse, quota and access queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import identity
from lodestone.session import shared_dir, table
from lodestone.sources.binders import NOW, events, items, with_tables
from lodestone.streaming import jobs

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
def job_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every job after its log, long after its last event: lost workers hold no lease."""
    return jobs.replay(jobs.as_log(events(spark, sf_dir)), until=2**40)


@query()
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T6 as a stream: one micro-batch of all there is, state in the state store, the same transitions."""
    base = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    log = jobs.as_log(raw.withColumn("at_s", F.unix_seconds(F.col("ts").cast("timestamp"))))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        jobs.stream(log, wait_s=None).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    rows = spark.read.parquet(f"{base}/out")
    last = rows.groupBy("job").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("job", "batch")]), "batch").alias("s"))
    return last.select("job", "s.*")


@query()
def quota_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that are all checked before any is spent."""
    uses = events(spark, sf_dir).select(F.col("user_id").alias("owner"), "at_s", F.col("event_id").alias("seq"), F.lit(1).alias("calls"), (F.col("event_id") % 50).alias("tokens"))
    return jobs.spend_quotas(uses, {"calls": 5, "tokens": 120}, 86_400)


@query(f"""{with_tables('log')}, clicks AS (SELECT user_id, event_id, at_s, lag(at_s) OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS before FROM log WHERE event_type IN ('error', 'view'))
SELECT user_id, count(*) AS n, count(*) FILTER (at_s - before > 21600 OR before IS NULL) AS bursts FROM clicks GROUP BY user_id""")
def dispatch_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims grouped into bursts by the gap before them; ``admitted_calls`` is the limiter."""
    order = W.partitionBy("user_id").orderBy("at_s", "event_id")
    rows = events(spark, sf_dir).where("event_type in ('error', 'view')").withColumn("before", F.lag("at_s").over(order))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if((F.col("at_s") - F.col("before") > 21_600) | F.col("before").isNull()).alias("bursts"))


_JOBS = f"""jobs AS (SELECT id, content_id, CASE id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'READY' ELSE 'FAILED' END AS status, created_s AS available_s,
CASE WHEN id % 8 = 1 THEN {NOW} - 100 - (id % 7) * 60 END AS locked_s, CASE WHEN id % 16 = 1 THEN created_s END AS claimed_s, created_s FROM items WHERE content_id IS NOT NULL)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "PROCESSING", "READY", "FAILED"))), (i % 4 + 1).cast("int"))
    return items(spark, sf_dir).where("content_id is not null").select("id", "content_id", status.alias("status"), F.col("created_s").alias("available_s"), F.when(i % 8 == 1, NOW - 100 - (i % 7) * 60).alias("locked_s"), F.when(i % 16 == 1, F.col("created_s")).alias("claimed_s"), "created_s")


@query(f"""{with_tables('items')}, {_JOBS} SELECT id, status FROM jobs WHERE available_s <= {NOW} AND (status = 'PENDING' OR (status = 'PROCESSING' AND claimed_s IS NULL)) AND (locked_s IS NULL OR locked_s < {NOW} - 300) ORDER BY created_s, id LIMIT 50""")
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what a worker may claim next, first in first out."""
    free = F.col("locked_s").isNull() | (F.col("locked_s") < NOW - 300)
    open_ = (F.col("status") == "PENDING") | ((F.col("status") == "PROCESSING") & F.col("claimed_s").isNull())
    return _jobs(spark, sf_dir).where((F.col("available_s") <= NOW) & open_ & free).orderBy("created_s", "id").limit(50).select("id", "status")


@query(f"""{with_tables('items')}, {_JOBS} SELECT i.id FROM items i WHERE (i.brief_source IS DISTINCT FROM 'model' OR i.intent IS NULL) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.content_id = i.content_id AND j.status IN ('PENDING', 'PROCESSING'))""")
def stale_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-safe inequality, then an anti join with active jobs."""
    active = _jobs(spark, sf_dir).where("status in ('PENDING', 'PROCESSING')").select("content_id").distinct()
    stale = items(spark, sf_dir).where(~F.col("brief_source").eqNullSafe("model") | F.col("intent").isNull())
    return stale.join(active, "content_id", "left_anti").select("id")


_ASSETS = "assets AS (SELECT content_id, url, CASE id % 3 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PRIVATE' ELSE 'UNKNOWN' END AS visibility, user_id AS owner, id % 2 = 0 AS is_cache, id % 4 = 0 AS has_payload, created_s, id AS asset FROM items WHERE content_id IS NOT NULL)"


@query(f"""{with_tables('items')}, {_ASSETS}, usable AS (SELECT i.id, a.asset, a.created_s, 1 AS tier FROM items i JOIN assets a ON i.content_id = a.content_id WHERE (a.visibility = 'PUBLIC' AND (NOT a.is_cache OR a.has_payload)) OR (a.visibility <> 'PUBLIC' AND a.owner = i.user_id)
UNION ALL SELECT i.id, a.asset, a.created_s, 2 AS tier FROM items i JOIN assets a ON i.url = a.url WHERE (a.visibility = 'PUBLIC' AND (NOT a.is_cache OR a.has_payload)) OR (a.visibility <> 'PUBLIC' AND a.owner = i.user_id))
SELECT id, arg_min(asset, (tier, created_s, asset)) AS asset FROM usable GROUP BY id""")
def reusable_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset to reuse: by content first, then by URL, the earliest of those one may see."""
    own, i = items(spark, sf_dir), F.col("id")
    visibility = F.when(i % 3 == 0, "PUBLIC").when(i % 3 == 1, "PRIVATE").otherwise("UNKNOWN")
    assets = own.where("content_id is not null").select("content_id", "url", visibility.alias("visibility"), F.col("user_id").alias("owner"), ((i % 2 != 0) | (i % 4 == 0)).alias("complete"), F.col("created_s").alias("at"), i.alias("asset"))
    asks = own.select("id", "user_id", "content_id", "url")
    open_, mine = (F.col("visibility") == "PUBLIC") & F.col("complete"), F.col("visibility") != "PUBLIC"
    earliest = F.min(F.struct("at", "asset"))

    def tier(key: str, n: int) -> list:
        """The earliest public asset of a key and the earliest one of each owner: two equi-joins, a row a key each."""
        public = assets.where(open_).groupBy(key).agg(earliest.alias(f"public_{n}"))
        private = assets.where(mine).groupBy(key, F.col("owner").alias("user_id")).agg(earliest.alias(f"private_{n}"))
        return [(public, [key]), (private, [key, "user_id"])]

    for n, key in ((1, "content_id"), (2, "url")):
        for side, on in tier(key, n):
            asks = asks.join(side, on, "left")
    best = F.coalesce(F.least("public_1", "private_1"), F.least("public_2", "private_2"))
    return asks.select("id", best["asset"].alias("asset")).where("asset is not null")


_CLAIMS = {"1-URGENT": "true", "2-HIGH": '"true"', "3-MEDIUM": '"false"', "4-NOT SPECIFIED": '"2026-01-01T00:00:00Z"'}


@query("""WITH accounts AS (SELECT c_custkey AS account_id, lower(c_name) AS email, CASE WHEN c_acctbal >= 4000 THEN 'sub-' || c_custkey END AS subject FROM customer),
gone AS (SELECT 'sub-' || c_custkey AS subject FROM customer WHERE c_acctbal < -900),
logins AS (SELECT o_orderkey AS login_id, 'sub-' || o_custkey AS subject, CASE WHEN o_orderstatus = 'P' THEN 'team-' || c_nationkey ELSE lower(c_name) END AS email,
  coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED'), false) AS proven FROM orders JOIN customer ON o_custkey = c_custkey),
met AS (SELECT l.*, g.subject IS NOT NULL AS gone, k.account_id AS own, h.account_id AS holder, h.subject AS held_by FROM logins l LEFT JOIN gone g ON l.subject = g.subject
  LEFT JOIN accounts k ON l.subject = k.subject LEFT JOIN accounts h ON l.email = h.email),
judged AS (SELECT *, CASE WHEN gone THEN 'deleted' WHEN own IS NOT NULL THEN 'already bound' WHEN held_by IS NOT NULL THEN 'refused' WHEN holder IS NOT NULL AND NOT proven THEN 'unproven' END AS fixed FROM met),
firsts AS (SELECT email, min(login_id) AS first_id, arg_min(subject, login_id) AS first_subject FROM judged WHERE fixed IS NULL GROUP BY email),
done AS (SELECT j.*, coalesce(fixed, CASE WHEN first_subject <> subject THEN 'refused' WHEN first_id <> login_id THEN 'already bound' WHEN holder IS NOT NULL THEN 'bound' ELSE 'created' END) AS outcome FROM judged j LEFT JOIN firsts f ON j.email = f.email)
SELECT login_id, outcome, CASE outcome WHEN 'already bound' THEN coalesce(own, holder) WHEN 'bound' THEN holder END AS account_id FROM done""")
def resolve_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as logins of their customers, some by a shared address; customers as accounts, those of low balance without a subject."""
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.lower("c_name").alias("email"))
    subject = lambda c: F.concat(F.lit("sub-"), F.col(c).cast("string"))
    accounts = who.select(F.col("c_custkey").alias("account_id"), "email", F.when(F.col("c_acctbal") >= 4000, subject("c_custkey")).alias("subject"))
    claims = F.create_map(*(F.lit(x) for pair in _CLAIMS.items() for x in pair))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").join(who, F.col("o_custkey") == F.col("c_custkey"))
    address = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("team-"), F.col("c_nationkey").cast("string"))).otherwise(F.col("email"))
    logins = orders.select(F.col("o_orderkey").alias("login_id"), subject("o_custkey").alias("subject"), address.alias("email"), F.try_element_at(claims, F.col("o_orderpriority")).alias("claim"))
    return identity.resolve_logins(logins, accounts, who.where("c_acctbal < -900").select(subject("c_custkey").alias("subject")))


@query(f"""{with_tables('items')} SELECT id, CASE WHEN edited_title IS NOT NULL THEN 'confirm' WHEN status = 'pending' THEN 'busy' WHEN id % 10 = 3 THEN 'quota' ELSE 'queued' END AS regenerate,
CASE WHEN status = 'pending' THEN 'no-op' WHEN status = 'failed' OR needs_retry THEN 'retried' ELSE 'refused' END AS retry FROM items""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards of transitions, tried in order; ``asked_transitions`` applies them."""
    regenerate = F.when(F.col("edited_title").isNotNull(), "confirm").when(F.col("status") == "pending", "busy").when(F.col("id") % 10 == 3, "quota").otherwise("queued")
    retry = F.when(F.col("status") == "pending", "no-op").when((F.col("status") == "failed") | F.col("needs_retry"), "retried").otherwise("refused")
    return items(spark, sf_dir).select("id", regenerate.alias("regenerate"), retry.alias("retry"))


@query(f"""{with_tables('items')}, gone AS (SELECT DISTINCT user_id FROM items WHERE id % 50 = 7 AND user_id % 2 = 1) SELECT i.id, CASE WHEN i.user_id IN (SELECT user_id FROM gone) THEN NULL ELSE i.user_id END AS owner FROM items i WHERE i.user_id NOT IN (SELECT user_id FROM gone) OR i.id % 3 = 0""")
def account_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deleted account's own rows go; shared assets stay without an owner."""
    own = items(spark, sf_dir).select("id", "user_id")
    gone = own.where("id % 50 = 7 and user_id % 2 = 1").select("user_id", F.lit(True).alias("gone")).distinct()
    marked = own.join(gone, "user_id", "left")
    return marked.where("gone is null or id % 3 = 0").select("id", F.when(F.col("gone").isNull(), F.col("user_id")).alias("owner"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events""")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that may be broken gives null, never an error."""
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"), "props")
    return rows.select("event_id", F.try_variant_get("v", "$.k", "string").alias("k"), F.col("v").isNotNull().alias("valid"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(n, n)), 6) AS size, len(n) AS width FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS n FROM embeddings)""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length one; another width would give null."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.when(F.size("embedding") == 64, F.transform("embedding", lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("n"))
    return rows.select("vec_id", F.round(F.sqrt(F.aggregate("n", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("size"), F.size("n").alias("width"))


@query(f"""{with_tables('items')} SELECT content_id, arg_max(coalesce(edited_title, title), (created_s, id)) AS title, max(created_s) AS updated_s, bool_or(id % 3 = 0) AS public FROM items WHERE content_id IS NOT NULL AND status = 'ready' GROUP BY content_id""")
def asset_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest finished save of a content overwrites its asset; only listed columns are read."""
    own = items(spark, sf_dir).where("content_id is not null and status = 'ready'")
    newest = F.max_by(F.coalesce("edited_title", "title"), F.struct("created_s", "id"))
    return own.groupBy("content_id").agg(newest.alias("title"), F.max("created_s").alias("updated_s"), F.bool_or(F.col("id") % 3 == 0).alias("public"))


@query("""SELECT conv_id, string_agg('[' || printf('%02d:%02d', turn // 60, turn % 60) || '] ' || text, chr(10) ORDER BY turn, text) AS transcript, count(*) AS segments FROM conversations GROUP BY conv_id""")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments as one text; media stages are recorded elsewhere and never run here."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"), F.count("*").alias("segments"))
    line = lambda x: F.concat(F.format_string("[%02d:%02d] ", F.floor(x["turn"] / 60), x["turn"] % 60), x["text"])
    return rows.select("conv_id", F.array_join(F.transform("s", line), "\n").alias("transcript"), "segments")


@query("""WITH d AS (SELECT user_id, event_id % 97 AS token, CASE event_id % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' WHEN 2 THEN 'gone' ELSE 'sent' END AS outcome FROM events WHERE event_type = 'click')
SELECT user_id, count(*) FILTER (outcome = 'sent') AS sent, count(*) FILTER (outcome = 'failed') AS failed, count(DISTINCT token) FILTER (outcome = 'gone') AS removed, 2 * count(*) FILTER (outcome = 'failed') AS published FROM d GROUP BY user_id""")
def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a delivery batch; dead tokens are removed once, failures stay to be published again."""
    outcome = F.element_at(F.array(*map(F.lit, ("sent", "failed", "gone", "sent"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", (F.col("event_id") % 97).alias("token"), outcome.alias("outcome"))
    failed = F.count_if(F.col("outcome") == "failed")
    return rows.groupBy("user_id").agg(F.count_if(F.col("outcome") == "sent").alias("sent"), failed.alias("failed"), F.countDistinct(F.when(F.col("outcome") == "gone", F.col("token"))).alias("removed"), (failed * 2).alias("published"))
