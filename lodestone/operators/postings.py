"""A stored inverted index: postings in buckets of terms, with bounds that tell which of them a query need not read.

A posting's impact is what its term adds to a row's score. Postings of a term lie in tiers of impact, and a small table has each
tier's size and bounds. A query reads the high tiers first; that gives a score that its n-th best row reaches at least.
A posting whose tier's bound, with the best that the query's other terms can add, stays below that score cannot be of such
a row and is not read. So the n best rows and their scores are those of reading everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.stem import stems
from lodestone.operators import ranking
from lodestone.session import bounded_batches, stored

#: Fixed value: how fast a term's repetitions stop counting.
SATURATION = 1.2
#: Folders that terms are dealt to; tiers of impact between 0 and 1.
BUCKETS, TIERS = 64, 32
#: Postings of a query's term that are read for a first bound, in whole tiers, best first.
PROBE = 500


@dataclass
class Index:
    """Where an index lies, and whether its terms are stems."""

    spark: SparkSession
    folder: str
    stemmed: bool

    def postings(self) -> DataFrame:
        """(bucket, term, tier, id, impact)"""
        return self.spark.read.schema("term string, tier int, id long, impact double, bucket int").parquet(f"{self.folder}/postings")

    def bounds(self) -> DataFrame:
        """(bucket, term, tier, n, most, least)"""
        return self.spark.read.schema("term string, tier int, n long, most double, least double, bucket int").parquet(f"{self.folder}/bounds")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def build(rows: DataFrame, folder: str, stemmed: bool = False) -> Index:
    """Writes an index of ``rows`` (id, text) to a folder.

    A row with a null id is left out, one without words has no posting. Rows that share an id count as one text.
    Words are counted by row before stems are looked up, and each distinct word is stemmed once. A bucket's
    postings are sorted by term and tier, so a reader skips all others by the files' own statistics.
    """
    spark = rows.sparkSession
    # texts are dealt by id before they are cut, so a text's words are counted where they are
    texts = rows.where("id is not null").select(F.col("id").cast("long").alias("id"), "text").repartition("id")
    counted = texts.select("id", F.explode(words_of(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    if stemmed:
        counted = stored(counted)
        stem = bounded_batches(counted.select("term").distinct()).withColumn("stem", stems(F.array("term"))[0])
        met = counted.join(stored(stem.where("stem <> term")), "term", "left").select("id", F.coalesce("stem", "term").alias("term"), "tf")
        counted = met.groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    impact = F.col("tf") / (F.col("tf") + SATURATION)
    placed = counted.select(_bucket(F.col("term")).alias("bucket"), "term", F.floor(impact * TIERS).cast("int").alias("tier"), "id", impact.alias("impact"))
    dealt = placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "term", F.col("tier").desc())
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    index = Index(spark, folder, stemmed)
    limits = index.postings().groupBy("bucket", "term", "tier").agg(F.count("*").alias("n"), F.max("impact").alias("most"), F.min("impact").alias("least"))
    limits.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/bounds")
    return index


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _terms(index: Index, queries: DataFrame) -> tuple[DataFrame, list[str], list[int]]:
    """(query_id, term) of a batch of queries (query_id, term), with its distinct terms and their buckets: a batch is bounded by its caller."""
    term = stems(F.array("term"))[0] if index.stemmed else F.col("term")
    own = queries.where("term is not null").select("query_id", term.alias("term")).distinct()
    found = own.select("term", _bucket(F.col("term")).alias("bucket")).distinct().collect()
    return own, [r.term for r in found], sorted({r.bucket for r in found})


def _of(table: DataFrame, terms: list[str], buckets: list[int]) -> DataFrame:
    """The rows of some terms: other buckets' folders are not opened, other terms are skipped within files."""
    return table.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)) if terms else table.where("false")


def _plan(index: Index, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame, list[str], list[int]]:
    """(tiers, wanted, terms, buckets): each query's tiers with their bounds, and those of them that must be read for its n best rows."""
    own, terms, buckets = _terms(index, queries)
    tiers = own.join(F.broadcast(_of(index.bounds(), terms, buckets)), "term")  # at most TIERS rows a term of the batch
    above = F.aggregate(F.filter("all", lambda t: t["tier"] > F.col("t.tier")), F.lit(0).cast("long"), lambda s, t: s + t["n"])
    listed = tiers.groupBy("query_id", "term").agg(F.collect_list(F.struct("tier", "n", "most", "least")).alias("all"), F.max("most").alias("best"))
    tiers = listed.select("query_id", "term", "best", "all", F.explode("all").alias("t")).select("query_id", "term", "best", above.alias("above"), "t.*")
    first = tiers.where(F.col("above") < PROBE).select("query_id", "term", "tier")
    probed = _scored(index, terms, buckets, first)
    reached = ranking.top_rows(probed, "query_id", "raw", ["id"], n).groupBy("query_id").agg(F.count("*").alias("rows"), F.min("raw").alias("reached"))
    sums = listed.groupBy("query_id").agg(F.sum("best").alias("best_of_all"))
    judged = tiers.join(sums, "query_id").join(reached, "query_id", "left")
    can = F.col("most") + F.col("best_of_all") - F.col("best")
    # scores are compared as they are shown, so half of their last place is left to rounding
    return tiers, judged.where((F.coalesce("rows", F.lit(0)) < n) | (can + 1e-8 >= F.col("reached"))).select("query_id", "term", "tier", "n"), terms, buckets


def _scored(index: Index, terms: list[str], buckets: list[int], tiers: DataFrame) -> DataFrame:
    """(query_id, id, raw) of the postings in the queries' tiers.

    Postings are dealt by id before each meets all queries that ask for its term: so a frequent term, which may lie in one
    file, isn't one task's work, a posting is shuffled once rather than for each query, and a row's postings add up where they are.
    """
    spark = index.spark
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    asked = F.broadcast(tiers)
    needed = _of(index.postings(), terms, buckets).select("term", "tier", "id", "impact").join(F.broadcast(tiers.select("term", "tier").distinct()), ["term", "tier"], "left_semi")
    return needed.repartition(tasks, "id").join(asked, ["term", "tier"]).groupBy("query_id", "id").agg(_total())


def _total() -> Column:
    return F.round(F.sum("impact"), 9).alias("raw")


def top(index: Index, queries: DataFrame, n: int = ranking.LIST_SIZE) -> DataFrame:
    """(query_id, id, raw, rank): the n best rows of each query of a batch (query_id, term), ties by id, as if all its postings were read."""
    _, wanted, terms, buckets = _plan(index, queries, n)
    scored = _scored(index, terms, buckets, wanted.drop("n"))
    return ranking.top_rows(scored, "query_id", "raw", ["id"], n).select("query_id", "id", "raw", "rank")


def read_report(index: Index, queries: DataFrame, n: int = ranking.LIST_SIZE) -> DataFrame:
    """(query_id, postings, read): how many postings a query's terms have, and how many of them its n best rows need."""
    tiers, wanted, _, _ = _plan(index, queries, n)
    all_of = tiers.groupBy("query_id").agg(F.sum("n").alias("postings"))
    return all_of.join(wanted.groupBy("query_id").agg(F.sum("n").alias("read")), "query_id", "left").select("query_id", "postings", F.coalesce("read", F.lit(0)).alias("read"))
