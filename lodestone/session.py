"""Session helpers shared by tests, the bench and interactive use."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lodestone", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC clock, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``; Spark's own reader, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodestone"
    return folder.rstrip("/")


#: Bytes of an Arrow batch. Spark's own limits, 10,000 rows and 64 MB, are too much for what Python makes of them.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands Python at most BATCH_BYTES of rows at a time (or less, if so set)."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


#: Spark's setting that deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: for what a plan reads several times. It goes with that folder.

    Its own shuffle files go when it is written.
    """
    path, conf = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)
