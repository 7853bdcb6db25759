"""Weekly notes that are sent once a week and owner, whatever is replayed.

A stream of due rows is sent batch by batch. A batch first writes whom it claims, then delivers, then writes who was
reached: each a table of its own number in a ledger, written whole or not at all. A batch that is run again takes the claims
it wrote before, and does nothing if it had come to its end; only what was delivered keeps later batches from trying.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A delivery: (owner, week, tick_s, message) in, the same with a boolean ``delivered`` out. It may be asked again for a
#: message it has taken, if a run was killed before its end, and must not pass that on twice: ``message`` tells it.
Deliver = Callable[[DataFrame], DataFrame]

_CLAIM = "owner long, week string, tick_s long, message string"
_SENT = f"{_CLAIM}, delivered boolean"


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return _exists(spark, f"{path}/_SUCCESS")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(owner, week, tick_s, message, delivered, batch): every outcome so far."""
    if not _exists(spark, f"{folder}/outcomes"):
        return spark.createDataFrame([], f"{_SENT}, batch long")
    return spark.read.schema(f"{_SENT}, batch long").parquet(f"{folder}/outcomes")


def send_batch(due: DataFrame, number: int, folder: str, deliver: Deliver) -> None:
    """Claims, delivers and records one batch of ``due`` (owner, week, tick_s), once.

    Of several rows of an owner and week the earliest tick is claimed; those delivered by an earlier batch are not. What
    isn't delivered is released: a later batch that finds it due tries again. Rows without owner or week are left out.
    """
    spark = due.sparkSession
    claims, outcomes = f"{folder}/claims/batch={number}", f"{folder}/outcomes/batch={number}"
    if _written(spark, outcomes):
        return
    if not _written(spark, claims):
        asked = due.where("owner is not null and week is not null").groupBy(F.col("owner").cast("long").alias("owner"), "week").agg(F.min(F.col("tick_s").cast("long")).alias("tick_s"))
        done = ledger(spark, folder).where(F.col("delivered") & (F.col("batch") < number)).select("owner", "week").distinct()
        message = F.sha2(F.concat_ws("|", F.col("owner").cast("string"), "week"), 256)
        asked.join(done, ["owner", "week"], "left_anti").withColumn("message", message).write.mode("overwrite").parquet(claims)
    claimed = spark.read.schema(_CLAIM).parquet(claims)
    deliver(claimed).select("owner", "week", "tick_s", "message", F.coalesce("delivered", F.lit(False)).alias("delivered")).write.mode("overwrite").parquet(outcomes)


def run(due: DataFrame, folder: str, deliver: Deliver) -> None:
    """Sends a streaming DataFrame of due rows to its end; a run that was killed is taken up where its checkpoint stands."""
    send = lambda batch, number: send_batch(batch, number, folder, deliver)
    due.writeStream.foreachBatch(send).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
