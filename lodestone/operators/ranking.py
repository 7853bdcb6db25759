"""Candidate scoring, rank fusion and evaluation measures."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import shared_dir

#: Weights of the five candidate lists, the fusion constant, and the recency term.
LIST_WEIGHTS = {"lexical": 0.3, "vector": 0.7, "chunk_vector": 0.5, "chunk_lexical": 0.35, "note": 0.45}
RRF_K, RECENCY_WEIGHT, HALF_LIFE_DAYS, MIN_COSINE, LIST_SIZE = 60, 0.001, 30, 0.60, 50


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size)


#: Queries that go to every task at once, and the rows that they are multiplied with at once.
BLOCK, ROWS = 8_192, 1_024


class Nearest:
    """The n best rows of each of a block of queries (unit vectors) among rows that come by slice; it holds a few times n rows a query.

    Cosines are taken in single precision first. Only those that may reach a query's n-th best, whatever the error of that,
    are computed in double precision and counted in millionths, so the result is that of double precision.
    """

    def __init__(self, names: np.ndarray, matrix: np.ndarray, n: int):
        self.names, self.matrix, self.single, self.n = names, matrix, matrix.astype(np.float32), n
        self.slack = np.float32(4 * (matrix.shape[1] + 8) * 2.0**-24 + 2e-6)
        self.floor = np.full(len(names), -np.inf, np.float32)
        # the n-th best so far, none yet: a row with the same score must have a smaller id
        self.worst, self.last = np.full(len(names), -(1 << 62)), np.full(len(names), np.iinfo(np.int64).max)
        self.kept, self.held = [], 0

    def meet(self, ids: np.ndarray, vectors: np.ndarray, who: np.ndarray | None = None) -> None:
        """Rows (unit vectors), at most ROWS, meet the queries at the places ``who``, or all."""
        floor = self.floor if who is None else self.floor[who]
        scores = (self.single if who is None else self.single[who]) @ vectors.astype(np.float32).T
        fresh = np.flatnonzero(floor == -np.inf)
        if len(fresh) and len(ids) >= self.n:
            floor[fresh] = np.partition(np.nan_to_num(scores[fresh], nan=-2), len(ids) - self.n, axis=1)[:, len(ids) - self.n] - self.slack
            if who is not None:
                self.floor[who] = floor
        found = np.flatnonzero(scores >= floor[:, None])
        for start in range(0, len(found), 1 << 15):
            query, row = np.divmod(found[start : start + (1 << 15)], len(ids))
            query = query if who is None else who[query]
            score = np.rint(np.einsum("ij,ij->i", self.matrix[query], vectors[row]) * 1e6).astype(np.int64)
            row = ids[row]
            good = (score > self.worst[query]) | ((score == self.worst[query]) & (row < self.last[query]))
            self.kept.append((query[good], row[good], score[good]))
            self.held += len(self.kept[-1][0])
        if self.held > 2 * self.n * len(self.names):
            self._prune()

    def _prune(self) -> None:
        query, row, score = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        best, nth = place < self.n, place == self.n - 1
        self.kept, self.held = [(query[best], row[best], score[best])], int(best.sum())
        full = query[nth]
        self.worst[full], self.last[full] = score[nth], row[nth]
        self.floor[full] = np.maximum(self.floor[full], (score[nth] / 1e6).astype(np.float32) - self.slack)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(query_id, id, cosine) of all that is kept."""
        if self.kept:
            self._prune()
            query, row, score = self.kept[0]
            yield pa.RecordBatch.from_arrays([pa.array(self.names[query], pa.int64()), pa.array(row, pa.int64()), pa.array(score / 1e6, pa.float64())], ["query_id", "id", "cosine"])


def in_blocks(queries: DataFrame, block: int) -> tuple[int, Iterator[pa.Table]]:
    """The number of blocks of about ``block`` queries (query_id, vector), and each of them. They are dealt to folders once: no block reads another's."""
    blocks = max(1, -(-queries.count() // block))
    if blocks > 1:
        spark, folder = queries.sparkSession, f"{shared_dir(queries.sparkSession)}/queries-{uuid.uuid4().hex}"
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        dealt.repartition("block").write.partitionBy("block").parquet(folder)
        queries = spark.read.schema(dealt.schema).parquet(folder)
    return blocks, (queries.where(F.col("block") == number).drop("block").toArrow() if blocks > 1 else queries.toArrow() for number in range(blocks))


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` in so few tasks that those of all blocks keep the cores busy: each task of a block gives n rows a query to be merged."""
    return rows if blocks == 1 else rows.coalesce(max(1, -(-4 * rows.sparkSession.sparkContext.defaultParallelism // blocks)))


def exact_neighbours(queries: DataFrame, rows: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(query_id, id, cosine, rank): the n nearest rows (id, vector) of each query (query_id, vector), ties by id.

    The query set is taken in blocks of bounded size, each of which goes to every task as one matrix. A task multiplies
    it with its rows a slice at a time and keeps the n best of each query, so what is merged by query afterwards is n
    rows a task and query. Cosines have six decimals. Vectors of another width, of length zero or null match nothing.
    """
    blocks, parts = in_blocks(queries.where("vector is not null").select("query_id", "vector"), block)
    rows, scored = dealt(rows, blocks), None
    for part in parts:
        found = _nearest(rows, part.column("query_id").to_numpy(), [np.array(v, float) for v in part.column("vector").to_pylist()], n)
        scored = found if scored is None else scored.unionByName(found)
    return top_rows(scored, "query_id", "cosine", ["id"], n)


def _nearest(rows: DataFrame, ids: np.ndarray, vectors: list[np.ndarray], n: int) -> DataFrame:
    """The best n rows of each query within each task."""
    width = len(vectors[0]) if vectors else 0
    usable = [i for i, v in enumerate(vectors) if len(v) == width and np.linalg.norm(v) > 0]
    matrix = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in usable]).reshape(len(usable), width)
    shared = rows.sparkSession.sparkContext.broadcast((ids[usable], matrix))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(*shared.value, n)
        for batch in batches:
            for start in range(0, batch.num_rows if len(best.names) else 0, ROWS):
                part = batch.slice(start, ROWS)
                own, vectors = part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                sizes = np.linalg.norm(vectors, axis=1)
                some = (sizes > 0) & np.isfinite(sizes)
                best.meet(own[some], vectors[some] / sizes[some, None])
        yield from best.batches()

    own = rows.where((F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull())).select("id", "vector")
    return own.mapInArrow(search, "query_id long, id long, cosine double")


def recency(created: Column, now: Column) -> Column:
    """1 for a save of this moment, halved every thirty days; 0 without a time."""
    days = F.greatest((now - created) / 86_400.0, F.lit(0.0))
    return F.coalesce(F.pow(F.lit(0.5), days / HALF_LIFE_DAYS), F.lit(0.0))


def top_rows(scored: DataFrame, query: str, score: str, ties: list[str], n: int = LIST_SIZE) -> DataFrame:
    """The n best rows of each query with their position; positions count rows, not items."""
    order = [F.col(score).desc(), *(F.col(t).asc() for t in ties)]
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order))).where(F.col("rank") <= n)


def fuse(ranked: DataFrame, now: int, weights: dict[str, float] = LIST_WEIGHTS, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion with the relevance gate.

    ranked: query_id, list, id, rank, raw, created_s, content_id. An item's first position in a list counts. It is
    admitted by any lexical list, or by a cosine of MIN_COSINE in a vector list, and then scored by all lists. One
    aggregation on (query, item) gives both.
    """
    weight = F.coalesce(*(F.when(F.col("list") == name, F.lit(w)) for name, w in weights.items()))
    first = ranked.groupBy("query_id", "id", "list").agg(F.min("rank").alias("rank"), F.max("raw").alias("raw"), F.min("created_s").alias("created_s"), F.min("content_id").alias("content_id"))
    vector = F.col("list").isin("vector", "chunk_vector")
    fused = first.groupBy("query_id", "id").agg(
        F.sum(weight / (k + F.col("rank"))).alias("fused"),
        F.max(~vector | (F.col("raw") >= MIN_COSINE)).alias("admitted"),
        F.min("created_s").alias("created_s"),
        F.min("content_id").alias("content_id"),
        F.count("*").alias("n_lists"),
    )
    score = F.col("fused") + RECENCY_WEIGHT * recency(F.col("created_s"), F.lit(now))
    return fused.where("admitted").select("query_id", "id", score.alias("score"), "content_id", "n_lists")


def collapse(scored: DataFrame, n: int) -> DataFrame:
    """The best item of each content, then the n best of each query. Items without a content stand for themselves."""
    key = F.coalesce(F.col("content_id"), F.concat(F.lit("item:"), F.col("id").cast("string")))
    keyed = scored.withColumn("__key", key)
    best = keyed.groupBy("query_id", "__key").agg(F.max_by(F.struct("id", "score", "n_lists"), F.struct("score", -F.col("id"))).alias("b"))
    flat = best.select("query_id", "b.id", "b.score", "b.n_lists")
    return flat.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where(F.col("position") <= n)


def best_chunk(chunks: DataFrame) -> DataFrame:
    """Each item's chunk to show: that of the vector list if any, else the lexical one, at its best rank."""
    priority = F.when(F.col("list") == "chunk_vector", 0).otherwise(1)
    return chunks.groupBy("query_id", "id").agg(F.min_by(F.struct("chunk_idx", "list"), F.struct(priority, "rank")).alias("b")).select("query_id", "id", "b.chunk_idx", "b.list")


def evaluate(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Recall@k (any gold item) and mean reciprocal rank over the queries of ``gold``; a missing item counts 0."""
    best = gold.join(ranked, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("position").alias("position"))
    return best.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.when(F.col("position") <= k, 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("position"), F.lit(0.0))), 6).alias("mrr"))
