"""Queries that keep stored tables true, bound to orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import upkeep
from lodestone.session import stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _seconds(column: str) -> F.Column:
    return F.unix_seconds(F.col(column).cast("timestamp"))


#: The moment of the reminders' sync: among the orders' dates.
SYNC = 820_454_400


@query(f"""WITH l AS (SELECT l_orderkey AS item_id, CAST(epoch(min(l_shipdate)) AS BIGINT) AS own_s, CASE max(l_returnflag) WHEN 'N' THEN 'set' WHEN 'A' THEN 'remove' ELSE CASE WHEN max(l_linestatus) = 'F' THEN 'delivered' ELSE '' END END AS was,
  max(l_discount) > 0.08 AS heard, min(l_quantity) > 40 AS asleep FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 60),
r AS (SELECT o_orderkey AS item_id, CAST(epoch(o_orderdate) AS BIGINT) AS server_s FROM orders WHERE o_orderpriority <> '5-LOW'),
b AS (SELECT coalesce(l.item_id, r.item_id) AS item_id, own_s, server_s, was, coalesce(heard, false) AS heard, coalesce(asleep, false) AS asleep, l.item_id IS NOT NULL AS here FROM l FULL JOIN r ON l.item_id = r.item_id),
p AS (SELECT *, CASE WHEN NOT here OR asleep THEN NULL WHEN was = 'remove' THEN 'remove' WHEN was = 'set' AND own_s > {SYNC} THEN 'set' WHEN was = 'delivered' THEN 'acknowledge' END AS pushed FROM b),
s AS (SELECT *, CASE WHEN pushed = 'remove' THEN NULL WHEN pushed = 'set' THEN own_s WHEN pushed = 'acknowledge' AND server_s = own_s AND own_s <= {SYNC} THEN NULL ELSE server_s END AS at_server, CASE WHEN pushed IS NOT NULL THEN '' ELSE was END AS says FROM p),
o AS (SELECT *, CASE WHEN NOT here OR pushed = 'remove' THEN CASE WHEN at_server IS NULL THEN 'deleted' ELSE 'stored' END WHEN asleep OR says <> '' THEN 'kept' WHEN at_server IS NULL THEN 'deleted' WHEN at_server = own_s THEN 'kept' ELSE 'stored' END AS outcome FROM s),
f AS (SELECT *, CASE outcome WHEN 'stored' THEN at_server WHEN 'kept' THEN own_s END AS at_s, CASE outcome WHEN 'stored' THEN '' WHEN 'kept' THEN says END AS d, CASE outcome WHEN 'stored' THEN false WHEN 'kept' THEN heard END AS h FROM o),
u AS (SELECT *, coalesce(outcome <> 'deleted' AND NOT asleep AND NOT h AND d <> 'remove' AND at_s <= {SYNC}, false) AS due FROM f)
SELECT item_id, pushed, outcome, at_s AS scheduled_s, CASE WHEN due THEN CASE WHEN d = 'set' THEN 'remove' ELSE 'delivered' END ELSE d END AS dirty, h OR due AS delivered FROM u""")
def reminder_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's reminders, from lines, merged with the server's, from orders."""
    flag, status = F.max("l_returnflag"), F.max("l_linestatus")
    dirty = F.when(flag == "N", "set").when(flag == "A", "remove").when(status == "F", "delivered").otherwise("")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.min(_seconds("l_shipdate")).alias("scheduled_s"), dirty.alias("dirty"), (F.max("l_discount") > 0.08).alias("delivered"), (F.min("l_quantity") > 40).alias("suspended"), F.sum("l_quantity").alias("all"))
    remote = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("item_id"), _seconds("o_orderdate").alias("scheduled_s"))
    return upkeep.merge_reminders(lines.where("all > 60").drop("all"), remote, SYNC)


_SHARED = """assets AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_retailprice > 1200 THEN 'PUBLIC' WHEN p_size > 25 THEN 'PRIVATE' END AS visibility, p_name AS title FROM part),
items AS (SELECT l_orderkey * 1000000000 + l_partkey AS id, CAST(l_partkey AS VARCHAR) AS content_id, o_custkey AS user_id, max(l_returnflag) AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey, o_custkey),
memories AS (SELECT DISTINCT content_id, user_id FROM items WHERE flag <> 'R')"""


def _shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as assets, those of an order as saves of its customer, who remembers what was not returned."""
    visibility = F.when(F.col("p_retailprice") > 1200, "PUBLIC").when(F.col("p_size") > 25, "PRIVATE")
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), visibility.alias("visibility"), F.lit(None).cast("long").alias("owner"), F.col("p_name").alias("title"))
    items = _saves(spark, sf_dir).select("id", "content_id", "user_id", "flag")
    return assets, items.where("flag <> 'R'").select("content_id", "user_id").distinct(), items


def _saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content_id, user_id, flag, created_s, shipped_s): a row for each part of an order, stored, as its readers read it several times."""
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.max("l_returnflag").alias("flag"), F.min(_seconds("l_shipdate")).alias("shipped_s"))
    met = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return stored(met.select((F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey")).alias("id"), F.col("l_partkey").cast("string").alias("content_id"), F.col("o_custkey").alias("user_id"), "flag", _seconds("o_orderdate").alias("created_s"), "shipped_s"))


@query(f"""WITH {_SHARED}, shared AS (SELECT m.content_id FROM memories m JOIN assets a ON a.id = m.content_id WHERE a.visibility IS DISTINCT FROM 'PUBLIC' GROUP BY m.content_id HAVING count(DISTINCT user_id) > 1),
moves AS (SELECT m.content_id, m.user_id, md5('split|' || m.content_id || '|' || m.user_id) AS copy FROM memories m JOIN shared USING (content_id))
SELECT 'asset' AS kind, coalesce(copy, id) AS id, user_id AS owner, CASE WHEN copy IS NOT NULL THEN id END AS parent FROM assets LEFT JOIN moves ON assets.id = moves.content_id
UNION ALL SELECT 'item', CAST(i.id AS VARCHAR), i.user_id, coalesce(copy, i.content_id) FROM items i LEFT JOIN moves v ON i.content_id = v.content_id AND i.user_id = v.user_id""")
def split_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private assets that several users remember become a copy each, and every user's rows move to their own."""
    assets, _, items = upkeep.split_shared(*_shared(spark, sf_dir))
    rows = assets.select(F.lit("asset").alias("kind"), "id", "owner", "parent")
    return rows.unionByName(items.select(F.lit("item").alias("kind"), F.col("id").cast("string").alias("id"), F.col("user_id").alias("owner"), F.col("content_id").alias("parent")))


@query(f"""WITH {_SHARED}, asked AS (SELECT i.id, i.user_id, i.content_id AS parent, md5('detach|' || i.id || '|' || i.content_id) AS copy FROM items i WHERE flag = 'A'),
after AS (SELECT i.id, i.user_id, coalesce(copy, i.content_id) AS content_id FROM items i LEFT JOIN asked a ON i.id = a.id)
SELECT 'memory' AS kind, m.content_id, m.user_id, CAST(NULL AS VARCHAR) AS parent FROM memories m WHERE (m.content_id, m.user_id) NOT IN (SELECT (parent, user_id) FROM asked) OR (m.content_id, m.user_id) IN (SELECT (content_id, user_id) FROM after)
UNION ALL SELECT 'memory', a.copy, a.user_id, NULL FROM asked a JOIN memories m ON m.content_id = a.parent AND m.user_id = a.user_id UNION ALL SELECT 'asset', copy, user_id, parent FROM asked""")
def detached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves that are made anew leave their shared content and take a copy of their memory along."""
    _, memories, items = _shared(spark, sf_dir)
    again = items.where("flag = 'A'").select("id")
    _, notes, assets = upkeep.detach(items, memories, again)
    rows = notes.select(F.lit("memory").alias("kind"), "content_id", "user_id", F.lit(None).cast("string").alias("parent"))
    return rows.unionByName(assets.select(F.lit("asset").alias("kind"), F.col("id").alias("content_id"), F.col("owner").alias("user_id"), "parent"))


#: The moment of the sweep, late among the orders' dates.
SWEEP = 852_076_800


@query(f"""WITH users AS (SELECT c_custkey AS user_id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS guest FROM customer),
items AS (SELECT l_orderkey * 1000000000 + l_partkey AS id, o_custkey AS user_id, CAST(l_partkey AS VARCHAR) AS content_id, CAST(epoch(o_orderdate) AS BIGINT) AS created_s, max(l_returnflag) = 'R' AS deleted FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
memories AS (SELECT DISTINCT user_id, content_id FROM items), firsts AS (SELECT content_id AS id, arg_min(user_id, (created_s, items.id)) AS owner, min(created_s) AS created_s FROM items GROUP BY content_id),
assets AS (SELECT f.*, p_retailprice > 1200 AS public FROM firsts f JOIN part ON f.id = CAST(p_partkey AS VARCHAR)), busy AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS content_id FROM lineitem WHERE l_quantity = 50 AND l_tax = 0),
gone AS (SELECT i.* FROM items i JOIN users u USING (user_id) WHERE guest AND NOT deleted AND created_s < {SWEEP} - 86400 AND content_id NOT IN (SELECT content_id FROM busy)),
rest AS (SELECT * FROM items WHERE id NOT IN (SELECT id FROM gone)),
forgot AS (SELECT DISTINCT g.user_id, g.content_id FROM gone g JOIN memories m ON m.user_id = g.user_id AND m.content_id = g.content_id WHERE NOT EXISTS (SELECT 1 FROM rest r WHERE r.user_id = g.user_id AND r.content_id = g.content_id)),
kept AS (SELECT m.* FROM memories m WHERE NOT EXISTS (SELECT 1 FROM forgot f WHERE f.user_id = m.user_id AND f.content_id = m.content_id)),
swept AS (SELECT a.id FROM assets a JOIN users u ON u.user_id = a.owner WHERE guest AND NOT public AND id NOT IN (SELECT content_id FROM busy) AND id NOT IN (SELECT content_id FROM rest) AND id NOT IN (SELECT content_id FROM kept)
  AND (created_s < {SWEEP} - 86400 OR EXISTS (SELECT 1 FROM gone g WHERE g.content_id = a.id AND g.user_id = a.owner)))
SELECT 'item' AS kind, CAST(id AS VARCHAR) AS id FROM gone UNION ALL SELECT 'memory', user_id || ':' || content_id FROM forgot UNION ALL SELECT 'asset', id FROM swept UNION ALL SELECT 'chunk', id || ':0' FROM gone""")
def guest_leavings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of guests' saves, memories, assets and chunks has expired, customers of two segments being guests."""
    guest = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "guest:").otherwise("user:")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(guest, F.col("c_custkey").cast("string")).alias("subject"))
    items = _saves(spark, sf_dir).select("id", "user_id", "content_id", "created_s", F.when(F.col("flag") == "R", F.col("shipped_s")).alias("deleted_s"))
    firsts = items.groupBy("content_id").agg(F.min_by("user_id", F.struct("created_s", "id")).alias("owner"), F.min("created_s").alias("created_s"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_retailprice") > 1200, "PUBLIC").otherwise("PRIVATE").alias("visibility"))
    assets = firsts.withColumnRenamed("content_id", "id").join(parts, "id")
    jobs = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_tax = 0").select(F.col("l_partkey").cast("string").alias("content_id"), F.lit("PROCESSING").alias("status"), F.lit(None).cast("long").alias("locked_s"))
    chunks = items.select(F.col("id").alias("item_id"), F.lit(0).alias("chunk_idx"))
    return upkeep.sweep_guests(users, items, items.select("user_id", "content_id"), assets, jobs, chunks, SWEEP)


@query()
def packed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as segments, packed in groups of 2,000 characters as they are sent, the oversized split."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    size = F.char_length(F.format_string('{"id": %d, "text": ""}', F.col("turn"))) + F.char_length(F.coalesce("text", F.lit("")))
    return upkeep.pack_segments(rows, "conv_id", "turn", "text", size, cap=2_000).select("conv_id", "turn", "piece", "group", F.char_length("text").alias("chars"))


_RUNS = """runs AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS created_s, epoch(min(l_shipdate))::BIGINT AS claimed_s, epoch(max(l_shipdate))::BIGINT AS updated_s FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
timed AS (SELECT created_s, CASE WHEN claimed_s IS NOT NULL THEN greatest(0, claimed_s - created_s) END AS wait_s, CASE WHEN claimed_s IS NOT NULL AND updated_s IS NOT NULL THEN greatest(0, updated_s - claimed_s) END AS run_s FROM runs)"""


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: claimed when the first line ships, done when the last one does."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(_seconds("l_shipdate")).alias("claimed_s"), F.max(_seconds("l_shipdate")).alias("updated_s"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _seconds("o_orderdate").alias("created_s"))
    return upkeep.durations(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"))


@query(f"WITH {_RUNS} SELECT count(wait_s) AS waits, count(run_s) AS runs, CAST(sum(wait_s) AS BIGINT) AS waited, CAST(sum(run_s) AS BIGINT) AS ran, quantile_disc(wait_s, 0.95) AS wait_p95, quantile_disc(run_s, 0.5) AS run_p50, quantile_disc(run_s, 0.95) AS run_p95 FROM timed")
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: how long jobs wait and run, exactly, by nearest rank."""
    exact = lambda c, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")
    return _timed(spark, sf_dir).agg(F.count("wait_s").alias("waits"), F.count("run_s").alias("runs"), F.sum("wait_s").alias("waited"), F.sum("run_s").alias("ran"), exact("wait_s", 0.95).alias("wait_p95"), exact("run_s", 0.5).alias("run_p50"), exact("run_s", 0.95).alias("run_p95"))


@query(f"WITH {_RUNS} SELECT count(run_s) AS n, true AS near FROM timed WHERE created_s IS NOT NULL")
def duration_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: quantiles of run times merged from a sketch a month; near: each one's rank is within 1.7 % of what was asked."""
    timed = _timed(spark, sf_dir)
    merged = upkeep.merged_quantiles(upkeep.slice_sketches(timed, "created_s", "run_s", 30 * 86_400), [0.5, 0.95])
    ranks = [F.avg((F.col("run_s") <= F.col(c)).cast("double")).alias(f"up_{c}") for c in ("p50", "p95")] + [F.avg((F.col("run_s") < F.col(c)).cast("double")).alias(f"low_{c}") for c in ("p50", "p95")]
    # one row of quantiles meets every job
    checked = timed.where("run_s is not null").join(F.broadcast(merged)).agg(F.max("n").alias("n"), *ranks)
    near = lambda c, p: (F.col(f"low_{c}") - 0.017 <= p) & (F.col(f"up_{c}") + 0.017 >= p)
    return checked.select("n", (near("p50", 0.5) & near("p95", 0.95)).alias("near"))
