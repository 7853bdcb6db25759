"""Hybrid search: five candidate lists for a batch of queries, fused, gated, collapsed and explained in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import embed, text
from lodestone.functions.stem import stems
from lodestone.operators import filters, ranking
from lodestone.session import bounded_batches, stored, table
from lodestone.sources.binders import EPOCH, NOW, STEP, items, memories, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The registered queries search for these words; a service passes its own batch.
DEMO_QUERIES = [(1, "the tion and erthat"), (2, "eau lequeux"), (3, "looking for thatthe onnd"), (4, "cheitkeit und die"), (5, "the recipe that has a note")]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def term_counts(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key..., term, tf): words of a text with their frequency."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    return rows.select(*key, F.explode(words).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def lexical_scores(terms: DataFrame, rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """(query_id, key..., raw): a saturating term-frequency score of every row that holds any term of a query.

    Words that are no term of the batch, which its caller bounds, are dropped within their row, so only matches become rows.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    wanted = [r.term for r in terms.select("term").distinct().collect()]
    hits = rows.select(*key, F.explode(F.filter(words, lambda w: w.isin(wanted))).alias("term")).join(terms, "term")
    counted = hits.groupBy("query_id", *key, "term").agg(F.count("*").alias("tf"))
    return counted.groupBy("query_id", *key).agg(F.round(F.sum(F.col("tf") / (F.col("tf") + 1.2)), 9).alias("raw"))


def query_table(spark: SparkSession, queries: list[tuple[int, str]] = DEMO_QUERIES) -> DataFrame:
    return spark.createDataFrame(queries, "query_id long, query string").withColumn("terms", text.query_terms(F.col("query")))


def query_words(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(text.match_terms(F.col("terms"))).alias("term"))


#: Chunks of one save at most, by which a save and a chunk share one number.
PLACES = 1 << 20


def searchable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(filters.searchable())


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, chunk_idx, chunk_no, chunk_text, start_timestamp): timed chunks of every searchable save."""
    cut = text.timed_chunks(searchable_items(spark, sf_dir), "id", "search_text")
    return cut.select("id", "chunk_idx", (F.col("id") * PLACES + F.col("chunk_idx")).alias("chunk_no"), "chunk_text", "start_timestamp")


def _listed(top: DataFrame, name: str, info: DataFrame) -> DataFrame:
    return top.join(info, "id").select("query_id", F.lit(name).alias("list"), "id", "rank", F.col("raw").cast("double").alias("raw"), "created_s", "content_id")


def _own_chunk(top: DataFrame) -> DataFrame:
    """Best rows by number as rows of a save and a chunk."""
    return top.select("query_id", F.floor(F.col("id") / PLACES).alias("id"), (F.col("id") % PLACES).cast("int").alias("chunk_idx"), "rank", "raw")


def candidates(spark: SparkSession, sf_dir: str, queries: DataFrame, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates of all lists, chunk candidates with their chunk) of a batch of queries, which its caller bounds.

    Notes are the owner's own on the save's content. Queries, saves and chunks are embedded alike; every chunk has a vector.
    """
    found = searchable_items(spark, sf_dir)
    info, words = found.select("id", "created_s", "content_id"), query_words(queries)
    asked = embed.embedded(queries, "query_id", "query").where("vector is not null")
    lexical = ranking.top_rows(lexical_scores(words, found, ["id"], "search_text"), "query_id", "raw", ["id"])
    chunks = chunk_rows(spark, sf_dir) if chunks is None else chunks
    chunk_lexical = _own_chunk(ranking.top_rows(lexical_scores(words, chunks, ["chunk_no"], "chunk_text").withColumnRenamed("chunk_no", "id"), "query_id", "raw", ["id"]))
    note = ranking.top_rows(lexical_scores(words, notes(spark, sf_dir), ["id"], "note"), "query_id", "raw", ["id"])
    nearest = lambda rows, key, body: ranking.exact_neighbours(asked, embed.embedded(rows, key, body).withColumnRenamed(key, "id").where("vector is not null"), ranking.LIST_SIZE).withColumnRenamed("cosine", "raw")
    vector, chunk_vector = nearest(found, "id", "search_text"), _own_chunk(nearest(chunks, "chunk_no", "chunk_text"))
    lists = _listed(lexical, "lexical", info).unionByName(_listed(vector, "vector", info)).unionByName(_listed(note, "note", info))
    lists = lists.unionByName(_listed(chunk_vector, "chunk_vector", info)).unionByName(_listed(chunk_lexical, "chunk_lexical", info))
    shown = chunk_vector.select("query_id", "id", "chunk_idx", "rank", F.lit("chunk_vector").alias("list")).unionByName(chunk_lexical.select("query_id", "id", "chunk_idx", "rank", F.lit("chunk_lexical").alias("list")))
    return lists, shown


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_note, user_intent, note): what the owner of a searchable save wrote about its content; the earliest memory of each."""
    own = memories(spark, sf_dir).groupBy("user_id", "content_id").agg(F.min_by(F.struct("user_note", "user_intent"), "memory_of").alias("m"))
    met = searchable_items(spark, sf_dir).select("id", "user_id", "content_id").join(own, ["user_id", "content_id"])
    return met.select("id", "m.user_note", "m.user_intent", F.concat_ws(" ", "m.user_note", "m.user_intent").alias("note"))


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship; every query of the batch at once."""
    queries = query_table(spark)
    chunks = stored(chunk_rows(spark, sf_dir))  # cut once: scored by words, by vectors, and shown
    lists, shown = candidates(spark, sf_dir, queries, chunks)
    best = ranking.collapse(ranking.fuse(lists, NOW).withColumn("score", F.round("score", 9)), 10)
    chosen = best.join(ranking.best_chunk(shown).select("query_id", "id", "chunk_idx"), ["query_id", "id"], "left")
    # a save's texts are fetched for the few that are shown: ten a query
    chunk = chunks.select("id", "chunk_idx", "chunk_text", "start_timestamp")
    own = items(spark, sf_dir).select("id", filters.display_title().alias("title"), F.concat_ws(" ", "search_text", filters.display_title(), filters.display_summary(), F.array_join("topics", " ")).alias("document"))
    joined = chosen.join(chunk, ["id", "chunk_idx"], "left").join(own, "id").join(notes(spark, sf_dir).drop("note"), "id", "left").join(F.broadcast(queries.select("query_id", "terms")), "query_id")
    reason = text.evidence_reason(F.col("terms"), F.col("document"), F.col("chunk_text"), F.col("start_timestamp"), F.col("user_note"), F.col("user_intent"))
    return joined.select("query_id", "position", "id", "score", "n_lists", "title", reason.alias("reason"))


LEX = """terms AS (SELECT * FROM (VALUES (1, 'tion'), (1, 'erthat'), (2, 'eau'), (2, 'lequeux'), (3, 'thatthe'), (3, 'onnd'), (4, 'cheitkeit'), (4, 'und'), (4, 'die'), (5, 'recipe'), (5, 'note')) AS t(query_id, term)),
words AS (SELECT id, unnest(regexp_extract_all(lower(search_text), '[\\p{L}\\p{N}]+')) AS term FROM items WHERE status = 'ready' AND deleted_s IS NULL AND (link_only OR brief_source <> 'fallback')),
tf AS (SELECT query_id, id, term, count(*) AS tf FROM words JOIN terms USING (term) GROUP BY ALL),
scored AS (SELECT query_id, id, round(sum(tf / (tf + 1.2::DOUBLE)), 9) AS raw FROM tf GROUP BY ALL)"""


@query(f"{with_tables('items')}, {LEX} SELECT query_id, id, raw, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM scored) WHERE rank <= 50")
def lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any term matches; ties broken by id."""
    found = items(spark, sf_dir).where(filters.searchable())
    return ranking.top_rows(lexical_scores(query_words(query_table(spark)), found, ["id"], "search_text"), "query_id", "raw", ["id"]).select("query_id", "id", "raw", "rank")


COS = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"


@query(f"SELECT query_id, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {COS} AS cosine FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all, in blocks of the query set."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ranking.exact_neighbours(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, 10)


RANKED = f"""ranked AS (SELECT query_id, list, id, rank, raw, {EPOCH} + id * {STEP} AS created_s, CASE WHEN id % 9 <> 0 THEN 'c' || (id % 13) END AS content_id FROM (
  SELECT event_id % 7 AS query_id, CASE event_id % 5 WHEN 0 THEN 'lexical' WHEN 1 THEN 'vector' WHEN 2 THEN 'chunk_vector' WHEN 3 THEN 'chunk_lexical' ELSE 'note' END AS list, user_id AS id,
  row_number() OVER (PARTITION BY event_id % 7, event_id % 5 ORDER BY value DESC, event_id) AS rank, value / 200 AS raw FROM events) WHERE rank <= 50)"""
FUSED = f"""firsts AS (SELECT query_id, id, list, min(rank) AS rank, max(raw) AS raw, min(created_s) AS created_s, min(content_id) AS content_id FROM ranked GROUP BY ALL),
fused AS (SELECT query_id, id, round(sum(CASE list WHEN 'lexical' THEN 0.3::DOUBLE WHEN 'vector' THEN 0.7::DOUBLE WHEN 'chunk_vector' THEN 0.5::DOUBLE WHEN 'chunk_lexical' THEN 0.35::DOUBLE ELSE 0.45::DOUBLE END / (60 + rank))
  + 0.001::DOUBLE * pow(0.5::DOUBLE, greatest(({NOW} - min(created_s)) / 86400.0::DOUBLE, 0) / 30), 6) AS score, min(content_id) AS content_id, count(*) AS n_lists FROM firsts GROUP BY query_id, id
  HAVING bool_or(list NOT IN ('vector', 'chunk_vector') OR raw >= 0.6))"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ["lexical", "vector", "chunk_vector", "chunk_lexical", "note"]
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 7).alias("query_id"), F.element_at(F.array(*map(F.lit, lists)), (F.col("event_id") % 5 + 1).cast("int")).alias("list"), F.col("user_id").alias("id"), "value", "event_id")
    top = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "list").orderBy(F.col("value").desc(), "event_id"))).where("rank <= 50")
    return top.select("query_id", "list", "id", "rank", (F.col("value") / 200).alias("raw"), (EPOCH + F.col("id") * STEP).alias("created_s"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("c"), (F.col("id") % 13).cast("string"))).alias("content_id"))


@query(f"WITH {RANKED}, {FUSED} SELECT query_id, id, score, content_id, n_lists FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First positions, weighted reciprocal ranks, recency and the gate."""
    return ranking.fuse(_ranked(spark, sf_dir), NOW).withColumn("score", F.round("score", 6))


@query(f"""WITH {RANKED}, {FUSED}, keyed AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(content_id, 'item:' || id) ORDER BY score DESC, id) AS k FROM fused)
SELECT query_id, id, score, n_lists, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM keyed WHERE k = 1) WHERE position <= 10""")
def collapse_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11, W12, W19."""
    return ranking.collapse(ranking.fuse(_ranked(spark, sf_dir), NOW).withColumn("score", F.round("score", 6)), 10)


@query(f"""WITH {RANKED}, c AS (SELECT query_id, id, list, rank, id * 3 + rank AS chunk_idx FROM ranked WHERE list LIKE 'chunk%')
SELECT query_id, id, chunk_idx, list FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY list = 'chunk_lexical', rank) AS n FROM c) WHERE n = 1""")
def best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector list first, even if its rank is worse."""
    chunks = _ranked(spark, sf_dir).where(F.startswith("list", F.lit("chunk"))).withColumn("chunk_idx", F.col("id") * 3 + F.col("rank"))
    return ranking.best_chunk(chunks)


@query(f"{with_tables('items')} SELECT id, round(pow(0.5::DOUBLE, greatest(({NOW} - created_s) / 86400.0::DOUBLE, 0) / 30), 6) AS boost FROM items")
def recency_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    return items(spark, sf_dir).select("id", F.round(ranking.recency(F.col("created_s"), F.lit(NOW)), 6).alias("boost"))


@query("""WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}')) AS terms FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}')) AS words FROM documents),
hits AS (SELECT query_id, doc_id, count(*) AS overlap FROM (SELECT query_id, unnest(terms) AS w FROM q) JOIN (SELECT doc_id, unnest(words) AS w FROM d) USING (w) GROUP BY ALL)
SELECT query_id, doc_id, overlap, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS position FROM hits) WHERE position <= 5""")
def bag_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-item queries by token overlap, as a join on words rather than of all pairs."""
    return _bag(spark, sf_dir)


def _bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda t, key, name: table(spark, sf_dir, t).select(F.col(key).alias(name), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), 0))).alias("w"))
    hits = words("benchmark", "item_id", "query_id").join(words("documents", "doc_id", "doc_id"), "w").groupBy("query_id", "doc_id").agg(F.count("*").alias("overlap"))
    return ranking.top_rows(hits, "query_id", "overlap", ["doc_id"], 5).withColumnRenamed("rank", "position").select("query_id", "doc_id", "overlap", "position")


@query("""WITH g AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}')) AS terms FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}')) AS words FROM documents),
hits AS (SELECT query_id, doc_id, count(*) AS overlap FROM (SELECT query_id, unnest(terms) AS w FROM q) JOIN (SELECT doc_id, unnest(words) AS w FROM d) USING (w) GROUP BY ALL),
r AS (SELECT query_id, doc_id AS id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS position FROM hits) WHERE position <= 5),
best AS (SELECT g.query_id, min(position) AS position FROM g LEFT JOIN r ON g.query_id = r.query_id AND g.id = r.id GROUP BY g.query_id)
SELECT count(*) AS n_queries, round(avg(CASE WHEN position <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / position, 0)), 6) AS mrr FROM best""")
def recall_and_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage are its gold."""
    return ranking.evaluate(_bag(spark, sf_dir).withColumnRenamed("doc_id", "id"), gold_documents(spark, sf_dir))


def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id): the documents that hold a benchmark passage as it stands.

    A word with other signs around it in the passage is a whole word of every text that holds it. The rarest such word, by how many
    documents have it, leads to the documents that are searched; words at the passage's ends may be parts of longer ones there.
    A passage without such a word (of a word or two, or of none) is looked for in every document, once for all of its copies.
    """
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    split = lambda c, pattern: F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(pattern), 0))
    whole = split("passage", r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]++(?=[^\p{L}\p{N}])")
    inner = passages.select("query_id", F.explode(whole).alias("w"))
    met = docs.select("id", F.explode(split("text", r"[\p{L}\p{N}]+")).alias("w")).join(inner.select("w").distinct(), "w")
    rarest = inner.join(met.groupBy("w").count(), "w", "left").groupBy("query_id").agg(F.min_by("w", F.struct(F.coalesce("count", F.lit(0)), "w")).alias("w"))
    pairs = met.join(rarest, "w").select("query_id", "id")
    held = F.contains("text", F.col("passage"))
    found = docs.join(pairs, "id").join(passages, "query_id").where(held).select("query_id", "id")
    short = passages.where(F.size(whole) == 0)
    everywhere = docs.join(short.select("passage").distinct(), held).select("passage", "id").join(short, "passage").select("query_id", "id")
    return found.unionByName(everywhere).distinct()


@query(rf"""SELECT doc_id, array_to_string(list_filter(['tion', 'the', 'qu'], lambda t: regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])' || t)), '+') AS matched FROM documents""")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a text holds at the start of a word."""
    terms = F.array(F.lit("tion"), F.lit("the"), F.lit("qu"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.matched(terms, F.col("text")), "+").alias("matched"))


@query()
def stemmed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical score over stems; stems of text and query come from one UDF, ranks from the same operator."""
    words = lambda c: stems(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"[\p{L}\p{N}]+"), 0))
    docs = bounded_batches(items(spark, sf_dir)).where(filters.searchable()).select("id", F.array_join(words("search_text"), " ").alias("stemmed"))
    queries = query_table(spark).select("query_id", F.explode(stems(text.match_terms(F.col("terms")))).alias("term")).distinct()
    return ranking.top_rows(lexical_scores(queries, docs, ["id"], "stemmed"), "query_id", "raw", ["id"]).select("query_id", "id", "raw", "rank")


@query(f"""WITH {RANKED} SELECT query_id, list, id, row_number() OVER (PARTITION BY query_id, list ORDER BY rank) AS position FROM ranked WHERE created_s >= {EPOCH + 20 * STEP} AND created_s <= {EPOCH + 120 * STEP}""")
def filtered_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata filters cut each list after its fifty rows, and positions are counted on what is left."""
    rows = _ranked(spark, sf_dir).where(F.col("created_s").between(EPOCH + 20 * STEP, EPOCH + 120 * STEP))
    return rows.select("query_id", "list", "id", F.row_number().over(W.partitionBy("query_id", "list").orderBy("rank")).alias("position"))


@query("""WITH r AS (SELECT user_id % 20 AS query_id, min(event_id % 9 + 1) AS place FROM events WHERE user_id % 20 < 18 GROUP BY 1), g AS (SELECT DISTINCT user_id % 20 AS query_id FROM events)
SELECT count(*) AS n, round(avg((coalesce(r.place, 99) <= 5)::INT), 6) AS recall, coalesce(string_agg(CASE WHEN r.place > 5 THEN g.query_id END::VARCHAR, ',' ORDER BY g.query_id), '') AS buried, coalesce(string_agg(CASE WHEN r.place IS NULL THEN g.query_id END::VARCHAR, ',' ORDER BY g.query_id), '') AS missing FROM g LEFT JOIN r ON g.query_id = r.query_id""")
def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall with the queries whose gold is buried or missing."""
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("query_id"), (F.col("event_id") % 9 + 1).alias("place"))
    ranked = log.where("query_id < 18").groupBy("query_id").agg(F.min("place").alias("place"))
    joined = log.select("query_id").distinct().join(ranked, "query_id", "left")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("query_id")))), lambda x: x.cast("string")), ",")
    return joined.agg(F.count("*").alias("n"), F.round(F.avg((F.coalesce("place", F.lit(99)) <= 5).cast("int")), 6).alias("recall"), listed(F.col("place") > 5).alias("buried"), listed(F.col("place").isNull()).alias("missing"))
