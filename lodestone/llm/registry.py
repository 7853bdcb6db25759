"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import audit, bpe, centroids, decontamination, html, licenses, lines, media, mixing, quality, simhash, suffixes, tokens
from .common import table

#: Where the tokenizer file lies; a parameter of the query's operator.
TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: a row per page; see ``html.extract_text`` for null, empty and broken ones."""
    return html.extract_text(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of benchmark items, exact or edited, in all documents: a row per document and item; see ``decontamination.find_leaks`` for null and short items."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents: a row per place; see ``licenses.scan_licenses`` for null and empty texts."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as sound and read back: a row per document; a null text counts as empty, see ``media.store_as_media``."""
    return media.media_digest(media.store_as_media(table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text: a row per document; a null text counts as empty, see ``tokens.count_tokens``."""
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every document, by perplexity and by words of refused documents: see ``quality.classify`` for what departs from perplexity alone."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words are one group, see ``simhash.near_duplicates``."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without repeated strings of 200 bytes: a row per document; see ``suffixes.remove_repeats``."""
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: a row per document; a null source is a source, see ``mixing.mix``."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its source's boilerplate lines: a row per document; a null text stays null, see ``lines.drop_boilerplate_lines``."""
    rows = lines.drop_boilerplate_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


OP10_SQL = """
WITH pages AS (SELECT doc_id, source, coalesce(text, '') AS body, text FROM documents),
pieces AS (SELECT DISTINCT source, body, trim(line) AS line FROM (SELECT source, body, unnest(string_split(body, chr(10))) AS line FROM pages) WHERE trim(line) <> ''),
counted AS (SELECT source, line, count(*) AS n FROM pieces GROUP BY source, line HAVING count(*) >= 5),
totals AS (SELECT source, count(DISTINCT body) AS n FROM pages GROUP BY source),
known AS (SELECT c.source, list(c.line) AS lines FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE c.n > 0.1 * t.n GROUP BY c.source),
cut AS (SELECT p.doc_id, p.text, string_split(p.body, chr(10)) AS every, list_filter(string_split(p.body, chr(10)), lambda x: NOT coalesce(list_contains(k.lines, trim(x)), false)) AS kept
  FROM pages p LEFT JOIN known k ON p.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, len(every) AS n_lines, len(every) - len(kept) AS n_dropped, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM cut
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents by lang: a row per part, order and step; see ``audit.filter_audit`` for odd rows."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors in 8 clusters after 10 rounds: a row per vector; see ``centroids.cluster`` for odd rows."""
    return centroids.digest(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again: a row per document; see ``bpe.encode`` for odd rows."""
    import public_tokenizers

    path = public_tokenizers.path(WORD_TOKENIZER)
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


#: Counts every order and step from the rows' failures, without inclusion-exclusion.
OP11_SQL = """
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
flags AS (SELECT doc_id, part, CAST(len(words) < 200 AS INT) AS a, CAST(100 * list_unique(words) < 50 * len(words) AS INT) AS b,
  CAST(100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) AS INT) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d, CAST(coalesce(doc_id > first, false) AS INT) AS e FROM words),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
rows AS (SELECT part, CASE WHEN a = 1 THEN 'A' ELSE '' END || CASE WHEN b = 1 THEN 'B' ELSE '' END || CASE WHEN c = 1 THEN 'C' ELSE '' END || CASE WHEN d = 1 THEN 'D' ELSE '' END || CASE WHEN e = 1 THEN 'E' ELSE '' END AS fails,
  count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM flags LEFT JOIN known ON flags.doc_id = known.doc_id GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
judged AS (SELECT *, contains(fails, filter) AS fails_it, translate(fails, before, '') <> fails AS gone FROM rows, steps),
counted AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT fails_it AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails_it AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails_it AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails_it AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails_it AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counted
"""


def _op12_sql(rounds: int = centroids.ROUNDS) -> str:
    """Lloyd's rounds over every vector, one after another, without weights."""
    kept = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}),
starts AS (SELECT v, sha256('{centroids.SEED}:' || vec_id) AS h FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {centroids.CLUSTERS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM starts)"""
    for i in range(rounds + 1):
        kept += f""",
d{i} AS (SELECT r, c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept k, c{i} m),
a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := CAST(d AS BIGINT), c := c)) AS best FROM d{i} GROUP BY r)"""
        if i < rounds:
            kept += f""",
s{i} AS (SELECT best.c AS c, place, sum(x) AS s, count(*) AS n FROM (SELECT a.best, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS place FROM a{i} a JOIN kept k USING (r)) GROUP BY ALL),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))"""
    last = f"a{rounds} a JOIN kept k USING (r) JOIN c{rounds} c ON c.c = a.best.c"
    return kept + f"""
SELECT vec_id, CAST(a.best.c AS INT) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM {last}
"""


def queries() -> dict:
    return {
        "op1_html_text": op1_html_text,
        "op2_decontamination": op2_decontamination,
        "op3_licenses": op3_licenses,
        "op4_media": op4_media,
        "op5_token_counts": op5_token_counts,
        "op6_quality": op6_quality,
        "op7_simhash": op7_simhash,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_mixing": op9_mixing,
        "op10_line_dedup": op10_line_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_centroids": op12_centroids,
        "op13_bpe": op13_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = {"op10_line_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_centroids": _op12_sql()}
    return known | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
