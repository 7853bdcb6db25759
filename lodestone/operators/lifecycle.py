"""What happens to a save between its capture and its being read: resuming, keeping a link, copying chunks, work at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The stages of processing, in order, and how many of each kind may run at once.
STAGES = ["FETCH", "NORMALIZE", "UNDERSTAND", "BRIEF", "CHUNK", "EMBED"]
AT_ONCE = {"fetch": 4, "ai": 4, "embedding": 2}
DAY = 86_400


def resume_index(last_stage: Column) -> Column:
    """How many stages are done; none if the last one is null or unknown."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), last_stage), F.lit(0)).cast("int")


def remaining_stages(jobs: DataFrame, key: str, last_stage: str) -> DataFrame:
    """(key, stage_idx, stage): what each job has yet to run after its last committed stage; nothing for a finished one."""
    left = F.slice(F.array(*map(F.lit, STAGES)), F.col("__done") + 1, F.lit(len(STAGES)))
    done = jobs.select(key, resume_index(F.col(last_stage)).alias("__done"))
    return done.select(key, "__done", F.posexplode(left).alias("__at", "stage")).select(key, (F.col("__done") + F.col("__at")).alias("stage_idx"), "stage")


def keep_links(items: DataFrame, jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, outcome, closes_job) of requests (id) to keep saves as links only.

    ``items`` are (id, content_id, status, needs_retry, link_only), ``jobs`` (content_id, held). A link stays as it is; a
    save that did not fail is refused; one that is being read is busy; any other is kept and ready. The content's job is
    closed once no other save of it waits. A save without content has no job. Unknown ids give no row, repeated ones one.
    """
    held = jobs.groupBy("content_id").agg(F.coalesce(F.bool_or("held"), F.lit(False)).alias("held"))
    wanted = asked.select("id").distinct().withColumn("asked", F.lit(True))
    outcome = F.when(F.col("link_only"), "unchanged").when(~F.coalesce((F.col("status") == "failed") | F.col("needs_retry"), F.lit(False)), "refused").when(F.col("held"), "busy").otherwise("kept")
    rows = items.select("id", "content_id", "status", "needs_retry", "link_only").join(wanted, "id", "left").join(held, "content_id", "left")
    judged = rows.withColumn("outcome", F.when(F.col("asked"), outcome))
    waits = judged.where(F.col("status").isin("pending", "failed") & ~F.coalesce(F.col("outcome") == "kept", F.lit(False))).select("content_id", F.lit(True).alias("waits")).distinct()
    closes = (F.col("outcome") == "kept") & F.col("held").isNotNull() & F.col("waits").isNull()
    return judged.where("outcome is not null").join(waits, "content_id", "left").select("id", "outcome", closes.alias("closes_job"))


def copy_chunks(chunks: DataFrame, copies: DataFrame) -> DataFrame:
    """Chunks (item_id, ...) after each target's own were replaced by its source's, as these were before any copy.

    ``copies`` are (target, source); the smallest source counts if a target has several. A copy onto itself changes nothing.
    """
    chosen = copies.where("target is not null and source is not null").groupBy("target").agg(F.min("source").alias("source")).where("target <> source")
    kept = chunks.join(chosen.select(F.col("target").alias("item_id")), "item_id", "left_anti")
    taken = chunks.join(chosen.withColumnRenamed("source", "item_id"), "item_id").drop("item_id").withColumnRenamed("target", "item_id")
    return kept.unionByName(taken)


def busiest(holds: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(stage, total, peak, within): how many holds (stage, started_s, ended_s) of a stage ran at once at most, and if its limit kept.

    A hold ends before another starts in the same second; those of no length are left out. Starts and ends are summed by
    second first and by day next, so no task sorts more than the seconds of one day or the days of one stage.
    """
    allowed = F.create_map(*(F.lit(x) for pair in (AT_ONCE if limits is None else limits).items() for x in pair))
    ends = F.explode(F.array(F.struct(F.col("started_s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("ended_s").alias("at"), F.lit(-1).alias("d"))))
    edges = holds.where("stage is not null and started_s < ended_s").select("stage", ends.alias("e")).select("stage", "e.at", "e.d", F.floor(F.col("e.at") / DAY).alias("day"))
    net = edges.groupBy("stage", "day", "at").agg(F.sum("d").alias("d"), F.count_if(F.col("d") > 0).alias("starts"))
    inside = net.withColumn("busy", F.sum("d").over(W.partitionBy("stage", "day").orderBy("at")))
    days = inside.groupBy("stage", "day").agg(F.sum("d").alias("d"), F.max("busy").alias("most"), F.sum("starts").alias("starts"))
    before = F.coalesce(F.sum("d").over(W.partitionBy("stage").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    peaks = days.withColumn("most", F.col("most") + before).groupBy("stage").agg(F.sum("starts").alias("total"), F.max("most").alias("peak"))
    return peaks.select("stage", "total", "peak", (F.col("peak") <= F.try_element_at(allowed, F.col("stage"))).alias("within"))
