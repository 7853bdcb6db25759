"""Writers: raw snapshots by content, account exports, and metrics as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_path(item: Column, payload: Column) -> Column:
    """``raw/{item}/{first 16 digits of the payload's SHA-256}.json``: the same content, the same path."""
    return F.concat(F.lit("raw/"), item.cast("string"), F.lit("/"), F.substring(F.sha2(payload, 256), 1, 16), F.lit(".json"))


def write_snapshots(rows: DataFrame, folder: str) -> None:
    """Raw payloads as JSON lines below a folder for each item bucket, so an item's snapshots are one partition to drop."""
    rows.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(256))).write.mode("append").partitionBy("bucket").json(folder)


def export_saves(items: DataFrame, memories: DataFrame) -> DataFrame:
    """(user_id, created_s, save): every save with its private note as one JSON document."""
    joined = items.join(memories.select("user_id", "content_id", "user_note", "user_intent"), ["user_id", "content_id"], "left")
    return joined.select("user_id", "created_s", "id", F.to_json(F.struct("id", "url", "title", "summary", "topics", "user_note", "user_intent")).alias("save"))


def prometheus(counts: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """Metric lines in the text exposition format, one row a sample."""
    quoted = F.regexp_replace(F.regexp_replace(F.col(label).cast("string"), r"\\", r"\\\\"), '"', r'\\"')
    return counts.select(F.format_string(f'{name}{{{label}="%s"}} %s', quoted, F.col(value).cast("string")).alias("line"))


def write_metrics(lines: DataFrame, folder: str) -> None:
    lines.write.mode("overwrite").text(folder)


def ingest_batch(batch: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """A capture batch (client_id, url) as (accepted with their identity, rejected with a reason); a bad row harms no other."""
    from lodestone.functions.identity import url_parts

    parsed = batch.withColumn("parts", url_parts("url"))
    reason = F.when(F.col("client_id").isNull(), "no client id").when(F.col("parts.canonical").isNull(), "bad url").when(~F.col("parts.safe"), "unsafe url")
    checked = parsed.withColumn("reason", reason)
    accepted = checked.where("reason is null").select("client_id", F.col("parts.canonical").alias("canonical_url"), F.col("parts.platform_id").alias("platform_id"))
    return accepted.dropDuplicates(["client_id"]), checked.where("reason is not null").select("client_id", "url", "reason")
