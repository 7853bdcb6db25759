"""Queries over stored indexes: postings for words, cells for vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import embed
from lodestone.operators import cells, postings, ranking
from lodestone.plans import search
from lodestone.session import shared_dir, stored, table
from lodestone.sources import fixtures

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def item_index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> postings.Index:
    rows = search.searchable_items(spark, sf_dir).select("id", F.col("search_text").alias("text"))
    return postings.build(rows, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}", stemmed)


@query(search.SQL["lexical_top"])
def indexed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best saves of each query from the stored index, which reads only postings that can matter."""
    return postings.top(item_index(spark, sf_dir), search.query_words(search.query_table(spark)))


@query()
def indexed_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over stems; each distinct word of the corpus is stemmed once, when the index is written."""
    return postings.top(item_index(spark, sf_dir, stemmed=True), search.query_words(search.query_table(spark)))


@query("SELECT query_id, postings, true AS fewer FROM (" + search.SQL["lexical_top"].split("scored AS")[0].rstrip(", \n") + " SELECT query_id, count(*) AS postings FROM tf GROUP BY query_id)")
def index_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings the queries' terms have, and that no more than these are read."""
    report = postings.read_report(item_index(spark, sf_dir), search.query_words(search.query_table(spark)))
    return report.select("query_id", "postings", (F.col("read") <= F.col("postings")).alias("fewer"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector) of every chunk of a searchable save that has words."""
    rows = embed.embedded(search.chunk_rows(spark, sf_dir), "chunk_no", "chunk_text")
    return rows.select(F.col("chunk_no").alias("id"), "vector").where("vector is not null")


def chunk_cells(spark: SparkSession, sf_dir: str) -> cells.Cells:
    return cells.build(chunk_vectors(spark, sf_dir), f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}")


def _asked(index: cells.Cells) -> DataFrame:
    """The chunks of saves whose id is divisible by 20."""
    return index.rows().where(F.floor(F.col("id") / search.PLACES) % 20 == 0).select(F.col("id").alias("query_id"), "vector")


@query()
def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty nearest chunks of every chunk of a save whose id is divisible by 20, by the stored cells."""
    index = chunk_cells(spark, sf_dir)
    return cells.search(index, _asked(index))


@query()
def neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of the true fifty neighbours the cells give, and into how many cells of all a query looks."""
    index = chunk_cells(spark, sf_dir)
    asked = _asked(index)
    return measured(index, asked, ranking.LIST_SIZE)


def measured(index: cells.Cells, queries: DataFrame, n: int, probes: int | None = None) -> DataFrame:
    """(n_queries, recall, cells, probes) of a search against the exact one; a neighbour as near as the n-th counts as found."""
    exact = ranking.exact_neighbours(queries, index.rows().select("id", "vector"), n)
    limit = stored(exact.groupBy("query_id").agg(F.min("cosine").alias("worst"), F.count("*").alias("wanted")))  # read twice, searched for once
    found = cells.search(index, queries, n, probes).join(limit, "query_id").where("cosine >= worst").groupBy("query_id").agg(F.count("*").alias("found"))
    each = limit.join(found, "query_id", "left").select((F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("share"))
    return each.agg(F.count("*").alias("n_queries"), F.round(F.avg("share"), 6).alias("recall")).withColumns({"cells": F.lit(len(index.centroids)), "probes": F.lit(min(probes or index.probes, len(index.centroids)))})


@query(r"""WITH g AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark WHERE item_id IN (SELECT query_id FROM g)),
w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), tf AS (SELECT query_id, id, term, count(*) AS tf FROM w JOIN q USING (term) GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(tf / (tf + 1.2::DOUBLE)), 9) AS raw FROM tf GROUP BY ALL), r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS place FROM s),
best AS (SELECT g.query_id, min(place) AS place FROM g LEFT JOIN (SELECT * FROM r WHERE place <= 50) r ON g.query_id = r.query_id AND g.id = r.id GROUP BY g.query_id)
SELECT count(*) AS n_queries, round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr,
  coalesce(string_agg(CASE WHEN place > 5 THEN query_id END::VARCHAR, ',' ORDER BY query_id), '') AS buried, coalesce(string_agg(CASE WHEN place IS NULL THEN query_id END::VARCHAR, ',' ORDER BY query_id), '') AS missing FROM best""")
def fixture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages with the documents that hold them as a fixture of queries, read back and asked of the stored index of all documents."""
    folder = f"{shared_dir(spark)}/fixture-{uuid.uuid4().hex}"
    gold = search.gold_documents(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("gold"))
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(gold, "query_id")
    fixtures.write_queries(passages.select("text", "gold", F.lit("known item").alias("difficulty"), F.col("query_id").cast("string").alias("note"), F.array().cast("array<string>").alias("tags")), folder)
    asked = fixtures.read(spark, folder, fixtures.QUERIES).select(F.col("note").cast("long").alias("query_id"), "text", "gold")
    words = asked.select("query_id", F.explode(F.array_distinct(postings.words_of(F.col("text")))).alias("term"))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    ranked = postings.top(postings.build(documents, f"{folder}-index"), words)
    places = asked.select("query_id", F.explode(F.col("gold").cast("array<long>")).alias("id")).join(ranked, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("place"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("query_id")))), lambda x: x.cast("string")), ",")
    shares = [F.round(F.avg(F.when(F.col("place") <= 5, 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 6).alias("mrr")]
    return places.agg(F.count("*").alias("n_queries"), *shares, listed(F.col("place") > 5).alias("buried"), listed(F.col("place").isNull()).alias("missing"))
