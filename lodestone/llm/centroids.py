"""Centroid clustering of quantised vectors by weighted deduplication.

Vectors become whole numbers, so equal ones can be grouped: Lloyd's rounds run over the distinct vectors with their
multiplicities, and the assignments are joined back to the ids at the end. All sums are of integers, so results are
the same whatever the partitions. A round is one map over the stored distinct vectors, with the centroids in each task,
and an aggregation of a row per task and cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, unused

#: Parts of one that a component is counted in.
SCALE = 1024
DIMENSIONS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
#: Components up to this size in steps, so that squared distances stay exact in 64 bits.
LARGEST = 1 << 27
#: A vector with more than this share of all rows is a heavy one. So there are at most 1,000 of them, and these are broadcast.
HEAVY = 0.001
#: Vectors whose distances to all centroids are computed together.
GROUP = 4096


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has exactly so many components, none of them null, infinite or NaN."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Each component x, as a double, as the whole number floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long"))


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the k rows (__id, __vector) with the smallest SHA-256 of ``seed:id``, in that order. Rows without id don't start one."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("__id").cast("string")), 256)
    found = rows.where("__id is not null").select(key.alias("key"), "__vector").orderBy("key", "__vector").limit(k).collect()  # k rows
    return np.array([r["__vector"] for r in found], np.int64)


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; of equally near centroids, the smaller number."""
    cluster, distance = np.empty(len(vectors), np.int32), np.empty(len(vectors), np.int64)
    for start in range(0, len(vectors), GROUP):
        some = vectors[start : start + GROUP]
        every = np.stack([np.square(some - c).sum(axis=1) for c in centroids], axis=1)
        cluster[start : start + GROUP] = best = every.argmin(axis=1)
        distance[start : start + GROUP] = every[np.arange(len(some)), best]
    return cluster, distance


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _weighted(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """weights @ values, exact: in Python's whole numbers where 64 bits may not do."""
    if int(weights.max()) * max(1, int(np.abs(values).max())) * len(weights) < 1 << 62:
        return (weights @ values).astype(object)
    return weights.astype(object) @ values.astype(object)


def _round(distinct: DataFrame, centroids: np.ndarray) -> tuple[dict[int, tuple[int, list[int]]], dict[int, int]]:
    """({cluster: (vectors, sums of components)}, {cluster: sum of distances}), of all rows that the distinct vectors stand for."""
    k, d = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, d + 2), object)
        for batch in batches:
            vectors, n = _matrix(batch.column(0), d), batch.column(1).to_numpy()
            cluster, distance = _nearest(vectors, centroids)
            measured = np.column_stack([np.ones(len(n), np.int64), vectors, distance])
            for c in range(k):
                mine = cluster == c
                if mine.any():
                    totals[c] += _weighted(n[mine], measured[mine])
        some = [c for c in range(k) if totals[c][0]]
        if some:
            parts = pa.array([[str(x) for x in totals[c]] for c in some], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), parts], ["cluster", "parts"])

    rows = bounded_batches(distinct).select("vector", "n").mapInArrow(sums, "cluster int, parts array<string>")
    places = rows.select("cluster", F.posexplode("parts").alias("place", "part"))
    found = places.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()  # k * (d + 2) rows
    by_cluster: dict[int, dict[int, int]] = {}
    for r in found:
        by_cluster.setdefault(r.cluster, {})[r.place] = int(r.total)
    moments = {c: (v[0], [v[i] for i in range(1, d + 1)]) for c, v in by_cluster.items()}
    return moments, {c: v[d + 1] for c, v in by_cluster.items()}


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, dict[int, int]]:
    """(centroids after the rounds, {cluster: inertia} under them) for distinct vectors (vector, n)."""
    for _ in range(rounds):
        moments, _ = _round(distinct, centroids)
        moved = [[s // moments[c][0] for s in moments[c][1]] if c in moments else list(old) for c, old in enumerate(centroids)]
        centroids = np.array(moved, np.int64)
    return centroids, _round(distinct, centroids)[1]


def cluster(
    vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids): ``vectors``' usable rows with __cluster and __distance (squared), and a row a centroid.

    Rows whose vector has another number of components, or a null, infinite or NaN one, are left out. All columns of the
    others stay. Rows that repeat count as often as they stand there; a null id is clustered but starts no centroid. Where
    fewer than k rows can, there are fewer centroids. Ties go to the smaller centroid; an empty cluster stays where it
    is. No usable row gives two empty results. Components beyond 2^27 steps raise an error, as distances would not be exact.
    The centroids' rows are __cluster, __centroid array, __inertia (0 for an empty cluster) and __all, the sum of these.
    """
    id_of, steps = unused(vectors, "__id", "__vector")
    rows = vectors.where(usable(F.col(vector), dimensions)).withColumn(steps, quantised(F.col(vector), scale))
    in_range = F.forall(steps, lambda x: F.abs(x) <= LARGEST)
    rows = rows.withColumn(steps, F.when(in_range, F.col(steps)).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} steps"))))
    distinct = stored(rows.groupBy(F.col(steps).alias("vector")).agg(F.count("*").alias("n")))
    starts = first_centroids(rows.select(F.col(key).alias("__id"), F.col(steps).alias("__vector")), k, seed)
    schema = "__cluster int, __centroid array<long>, __inertia decimal(38,0), __all decimal(38,0)"
    spark = vectors.sparkSession
    if not len(starts):
        return rows.drop(steps).where("false").withColumns({"__cluster": F.lit(0), "__distance": F.lit(0).cast("long")}), spark.createDataFrame([], schema)
    centroids, inertia = lloyd(distinct, starts, rounds)
    every = sum(inertia.values())
    table = spark.createDataFrame([(c, [int(x) for x in row], Decimal(inertia.get(c, 0)), Decimal(every)) for c, row in enumerate(centroids)], schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, distance = _nearest(_matrix(batch.column(0), dimensions), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array(distance)], ["vector", "n", "__cluster", "__distance"])

    assigned = bounded_batches(distinct).mapInArrow(assign, "vector array<long>, n long, __cluster int, __distance long")
    return _joined_back(rows, assigned, steps, distinct.agg(F.sum("n")).first()[0]).drop(steps), table


def _joined_back(rows: DataFrame, assigned: DataFrame, steps: str, total: int) -> DataFrame:
    """``rows`` with what their vector was assigned. Heavy vectors, of which there are few by definition, are broadcast; the others' rows meet by vector."""
    (of,) = unused(rows, "__of")
    assigned = assigned.withColumnRenamed("vector", of)
    heavy = F.broadcast(assigned.where(F.col("n") > HEAVY * total).drop("n"))
    by_heavy = rows.join(heavy, F.col(steps) == F.col(of))
    others = rows.join(heavy, F.col(steps) == F.col(of), "left_anti").join(assigned.where(F.col("n") <= HEAVY * total).drop("n"), F.col(steps) == F.col(of))
    return by_heavy.drop(of).unionByName(others.drop(of))


def digest(assignments: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): assignments with the figures of their clusters."""
    text = F.array_join(F.transform("__centroid", lambda x: x.cast("string")), ",")
    facts = centroids.select(F.col("__cluster").alias("cluster"), F.col("__inertia").cast("long").alias("cluster_inertia"), F.col("__all").cast("long").alias("inertia"), F.sha2(text, 256).alias("centroid_sha256"))
    rows = assignments.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("__cluster").alias("cluster"), F.col("__distance").alias("distance"))
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

