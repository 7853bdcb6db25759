"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word pattern of the contracts (anything but ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between such words.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodestone-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder. For narrow, small rows."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


#: Spark's setting that deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: compact, and safe when executors are lost.

    Its own shuffle files go when it is written, rather than when the driver happens to collect garbage.
    """
    conf = df.sparkSession.conf
    path, before = f"{shared_dir(df.sparkSession).rstrip('/')}/lodestone-{uuid.uuid4().hex}", conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for the frames. For frames that nothing reads any more."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(_folders.pop(frame))
        path.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Bytes of an Arrow batch. Spark's own limits, 10,000 rows and 64 MB, are too much for a few batches at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands Python at most BATCH_BYTES of rows at a time (or less, if so set)."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, lengthened until ``df`` has no such columns, whatever their case."""
    known = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in known:
            name += "_"
        out.append(name)
    return tuple(out)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return whole_text(column).cast("binary")


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)
