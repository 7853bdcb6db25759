"""Queries about time: the rate limiter, ticks on real clocks, and notes that are sent once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import schedule
from lodestone.session import shared_dir, table
from lodestone.sources.binders import events
from lodestone.streaming import limits, weekly

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Ten calls an hour of each kind of event: what a provider would take of the log.
HOUR_MS = 3_600_000


@query("""WITH RECURSIVE calls AS (SELECT event_type AS key, (epoch_us(ts) // 1000) AS at_ms, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
ring AS (SELECT key, at_ms, seq, n, true AS granted, [at_ms] AS times FROM calls WHERE n = 1
UNION ALL SELECT c.key, c.at_ms, c.seq, c.n, len(list_filter(r.times, lambda t: c.at_ms - t < 3600000)) < 10, CASE WHEN len(list_filter(r.times, lambda t: c.at_ms - t < 3600000)) < 10
  THEN list_append(list_filter(r.times, lambda t: c.at_ms - t < 3600000), c.at_ms) ELSE list_filter(r.times, lambda t: c.at_ms - t < 3600000) END FROM ring r JOIN calls c ON c.key = r.key AND c.n = r.n + 1)
SELECT key, at_ms, seq, granted FROM ring""")
def admitted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding-window limiter over the log, a provider a kind of event; each key's calls are cut into independent stretches."""
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    return limits.admit(calls, window=HOUR_MS).withColumnRenamed("at", "at_ms")


#: Five weeks in which clocks are put back in Europe and America, and forward in Australia.
BEGIN, END = 1_790_812_800, 1_794_009_600
_ZONES = {"signup": "America/New_York", "view": "Europe/Berlin", "click": "Australia/Lord_Howe", "purchase": "Asia/Kolkata", "error": "Not/A_Zone"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ZONES.items() if k != "error")
_DUE_SQL = f"""
last AS (SELECT user_id AS owner, arg_max(ts, (ts, event_id)) AS ts, CASE arg_max(event_type, (ts, event_id)) {_CASES} END AS zone FROM events GROUP BY user_id),
pref AS (SELECT owner, isodow(ts) - 1 AS weekday, hour(ts) AS hour, minute(ts) AS minute, zone FROM last WHERE zone IS NOT NULL),
local AS (SELECT owner, weekday, hour, minute, tick_s, timezone(zone, to_timestamp(tick_s)) AS clock FROM pref, (SELECT unnest(range({BEGIN}, {END}, 900)) AS tick_s)),
moments AS (SELECT owner, tick_s, clock, date_trunc('day', clock) - to_days(CAST((isodow(clock) - 1 - weekday + 7) % 7 AS INT)) + to_hours(hour) + to_minutes(minute) AS scheduled FROM local),
due AS (SELECT owner, tick_s, CAST(epoch(scheduled) AS BIGINT) AS scheduled_s, strftime(scheduled, '%G-W%V') AS week FROM moments WHERE clock >= scheduled AND clock < scheduled + INTERVAL 15 MINUTE)"""


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekly preference for each user: the weekday and minute of the last thing they did; the kind of it stands for their zone."""
    last = events(spark, sf_dir).groupBy(F.col("user_id").alias("owner")).agg(F.max_by(F.struct("ts", "event_type"), F.struct("ts", "event_id")).alias("e"))
    zones = F.create_map(*(F.lit(x) for pair in _ZONES.items() for x in pair))
    return last.select("owner", F.weekday("e.ts").alias("weekday"), F.hour("e.ts").alias("hour"), F.minute("e.ts").alias("minute"), F.try_element_at(zones, F.col("e.event_type")).alias("zone"))


@query(f"WITH {_DUE_SQL} SELECT owner, tick_s, scheduled_s, week FROM due")
def weekly_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick that serves each user's weekly moment on the clock of their zone, days of clock changes included."""
    return schedule.due_ticks(preferences(spark, sf_dir), BEGIN, END)


@query(f"WITH {_DUE_SQL}, devices AS (SELECT DISTINCT user_id AS owner FROM events WHERE event_type = 'signup' AND value > 20) SELECT owner, week, count(DISTINCT week) AS sent FROM due JOIN devices USING (owner) GROUP BY owner, week")
def weekly_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of due ticks in several batches, one message an owner and week; owners without a device are asked again and reached by none."""
    folder = f"{shared_dir(spark)}/weekly-{uuid.uuid4().hex}"
    schedule.due_ticks(preferences(spark, sf_dir), BEGIN, END).repartitionByRange(4, "tick_s").write.parquet(f"{folder}/due")
    devices = table(spark, sf_dir, "events").where("event_type = 'signup' and value > 20").select(F.col("user_id").alias("owner"), F.lit(True).alias("delivered")).distinct()
    source = spark.readStream.schema("owner long, tick_s long, scheduled_s long, week string").option("maxFilesPerTrigger", 2).parquet(f"{folder}/due")
    weekly.run(source, folder, lambda claimed: claimed.join(devices, "owner", "left"))
    return weekly.ledger(spark, folder).where("delivered").groupBy("owner", "week").agg(F.count("*").alias("sent"))
