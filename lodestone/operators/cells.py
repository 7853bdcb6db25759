"""Approximate nearest neighbours over any number of vectors: an inverted file of cells around centroids.

Centroids are fitted on a bounded sample; every vector is stored in the folder of its nearest centroid's cell. A query
looks into a few cells and ranks what they hold by its exact cosine. How many cells are needed is measured against
the exact search for a sample of the vectors; where no number of cells reaches the recall asked for, all are looked into.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import ranking
from lodestone.session import stored

#: Vectors that centroids are fitted on at most, Lloyd's rounds, and centroids at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 1_024
#: Vectors that the number of cells is measured with, and the recall it must reach.
TRIALS, RECALL = 64, 0.95


@dataclass
class Cells:
    """Where the cells lie, the unit vectors they stand around, and how many of them a query looks into."""

    spark: SparkSession
    folder: str
    centroids: np.ndarray
    probes: int = 1

    def rows(self) -> DataFrame:
        """(cell, id, vector)"""
        return self.spark.read.schema("id long, vector array<double>, cell int").parquet(self.folder).select("cell", "id", "vector")


def _unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(size > 0, size, 1)


def _centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means of the sample's unit vectors; starts are spread over the distinct ones in their order."""
    points = _unit(sample)
    starts = np.unique(points.round(6), axis=0)
    found = starts[np.linspace(0, len(starts) - 1, min(cells, len(starts))).astype(int)]
    for _ in range(ROUNDS):
        near = (points @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        found = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), found)
    return found


def build(rows: DataFrame, folder: str, n: int = ranking.LIST_SIZE, width: int = 64, recall: float = RECALL) -> Cells:
    """Stores ``rows`` (id, vector) in cells in a folder and measures how many of them a search for n neighbours needs.

    Vectors of another width, with nulls or of length zero are left out: they are near nothing. Ids are unique.
    """
    spark = rows.sparkSession
    usable = rows.where((F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & F.exists("vector", lambda x: x != 0)).select("id", F.col("vector").cast("array<double>").alias("vector"))
    usable = stored(usable)  # counted, drawn from and placed, but made once
    count = usable.count()
    drawn = usable.orderBy(F.xxhash64("id", F.lit("cells")), "id").limit(SAMPLE).select("vector").toArrow().column("vector")
    sample = np.array(drawn.to_pylist(), float).reshape(-1, width)
    centroids = _centroids(sample, int(min(MOST_CELLS, max(1, round(np.sqrt(count)))))) if len(sample) else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cell = (_unit(vectors) @ shared.value.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], ["cell", "id", "vector"])

    # a large cell is dealt to as many files as tasks hold rows of it; small ones lie in few
    placed = usable.mapInArrow(place, "cell int, id long, vector array<double>")
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, count // 5_000_000)))).write.mode("overwrite").partitionBy("cell").parquet(folder)
    index = Cells(spark, folder, centroids)
    index.probes = _probes_needed(index, n, recall)
    return index


def _probes_needed(index: Cells, n: int, recall: float) -> int:
    """The smallest number of cells, doubled from one on, in which a sample of the stored vectors finds this share of their n neighbours."""
    trials = index.rows().orderBy(F.xxhash64("id", F.lit("trial")), "id").limit(TRIALS).select(F.col("id").alias("query_id"), "vector")
    trials = index.spark.createDataFrame(trials.toArrow()) if index.centroids.any() else trials.limit(0)
    cells = len(index.centroids)
    # neighbours by cell: where each of the true neighbours lies, and how near its cell is to the query
    true = ranking.exact_neighbours(trials, index.rows().select("id", "vector"), n)
    true = index.rows().select("id", "cell").join(F.broadcast(true), "id").select("query_id", "cell").toArrow()
    if not true.num_rows:
        return 1
    ids = trials.toArrow()
    matrix = _unit(np.array(ids.column("vector").to_pylist(), float))
    order = np.argsort(-(matrix @ index.centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None, :].repeat(len(order), 0), axis=1)
    row = {q: i for i, q in enumerate(ids.column("query_id").to_pylist())}
    at = place[[row[q] for q in true.column("query_id").to_pylist()], true.column("cell").to_numpy()]
    probes = 1
    while probes < cells and (at < probes).mean() < recall:
        probes *= 2
    return min(probes, cells)


def search(index: Cells, queries: DataFrame, n: int = ranking.LIST_SIZE, probes: int | None = None) -> DataFrame:
    """(query_id, id, cosine, rank): the n nearest of the rows in the nearest cells of each query (query_id, vector), ties by id.

    Queries go to every task in blocks of bounded size, with the cells that each looks into; only these cells' folders are
    read. A task multiplies a cell's rows with the queries that look into it and keeps the n best of each. Looking into
    all cells is the exact search. Cosines have six decimals; queries without a usable vector find nothing.
    """
    cells, width = index.centroids.shape
    look = min(probes or index.probes, cells)
    usable = queries.where((F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull()) & F.exists("vector", lambda x: x != 0)).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    if look == cells:
        return ranking.exact_neighbours(usable, index.rows().select("id", "vector"), n)
    blocks, parts = ranking.in_blocks(usable, ranking.BLOCK)
    out = None
    for part in parts:
        found = _within(index, part, n, look, blocks) if part.num_rows else None
        out = found if out is None else out if found is None else out.unionByName(found)
    if out is None:
        out = index.spark.createDataFrame([], "query_id long, id long, cosine double")
    return ranking.top_rows(out, "query_id", "cosine", ["id"], n)


def _within(index: Cells, part: pa.Table, n: int, look: int, blocks: int) -> DataFrame:
    names, matrix = part.column("query_id").to_numpy(), _unit(np.array(part.column("vector").to_pylist(), float))
    nearest = np.argsort(-(matrix @ index.centroids.T), axis=1, kind="stable")[:, :look]
    asking = np.repeat(np.arange(len(names)), look)[np.argsort(nearest, axis=None, kind="stable")]
    cells, starts = np.unique(np.sort(nearest, axis=None), return_index=True)
    asked = dict(zip(cells.tolist(), np.split(asking, starts[1:]), strict=True))
    shared = index.spark.sparkContext.broadcast((names, matrix, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, asked = shared.value
        best = ranking.Nearest(names, matrix, n)
        for batch in batches:
            cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1]))
            for c in np.unique(cell):
                some = np.flatnonzero(cell == c)
                for start in range(0, len(some), ranking.ROWS):
                    mine = some[start : start + ranking.ROWS]
                    best.meet(ids[mine], vectors[mine], asked[int(c)])
        yield from best.batches()

    rows = index.rows().where(F.col("cell").isin(list(asked))).select("cell", "id", "vector")
    return ranking.dealt(rows, blocks).mapInArrow(run, "query_id long, id long, cosine double")
