"""Merges: latest-wins, survivor, upsert and reconciliation operators over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: one aggregation with map-side combine, no sort and no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__best"))
    return best.select(*keys, *(F.col(f"__best.{c}").alias(c) for c in rest))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__best"))
    return best.select(*keys, *(F.col(f"__best.{c}").alias(c) for c in rest))


def survivors(rows: DataFrame, key: str, order: list[str], fill: list[str]) -> DataFrame:
    """One row a key: the earliest survives, and its missing ``fill`` fields come from the next that has them."""
    earliest = F.min(F.struct(*order)).alias("__first")
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in fill]
    merged = rows.groupBy(key).agg(earliest, *filled, F.count("*").alias("n_merged"))
    return merged.select(key, *(F.col(f"__first.{c}").alias(c) for c in order), *fill, "n_merged")


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose keys aren't stored, one each."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows replace stored ones of their key if they are later."""
    return latest_per_key(stored.unionByName(incoming), keys, order)


def reconcile(local: DataFrame, remote: DataFrame, key: str, value: str, dirty: str) -> DataFrame:
    """Remote and local rows merged: dirty local rows win, clean local rows missing remotely go."""
    both = local.select(key, F.col(value).alias("__local"), F.col(dirty).alias("__dirty")).join(remote.select(key, F.col(value).alias("__remote"), F.lit(True).alias("__there")), key, "full_outer")
    wins = F.coalesce("__dirty", F.lit(False))
    merged = both.where(wins | F.coalesce("__there", F.lit(False)))
    return merged.select(key, F.when(wins, F.col("__local")).otherwise(F.col("__remote")).alias(value), wins.alias(dirty))


def within_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts groups before the shuffle, so hot groups stay small."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def split_per_owner(assets: DataFrame, members: DataFrame, key: str, owner: str) -> DataFrame:
    """A private copy of each asset for every distinct member."""
    return assets.join(members.select(key, owner).distinct(), key).withColumn("copy_id", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(owner).cast("string"))))
