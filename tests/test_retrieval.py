"""Stored indexes against reading everything, and the fused search against a plain version of it."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import embed, text
from lodestone.functions.stem import porter
from lodestone.operators import cells, postings, ranking
from lodestone.plans import retrieval, search
from lodestone.sources import binders, fixtures

WORD = re.compile(r"[^\W_]+")


def plain_top(rows, queries, n, stem=lambda w: w):
    """The n best rows of each query by adding up all postings."""
    out = []
    for query, words in queries.items():
        wanted, scored = {stem(w) for w in words}, []
        for key, body in rows.items():
            found = [stem(w) for w in WORD.findall((body or "").lower())]
            hits = [found.count(w) for w in wanted if w in found]
            if hits:
                scored.append((-round(sum(tf / (tf + 1.2) for tf in hits), 9), key))
        out += [(query, key, -score, place) for place, (score, key) in enumerate(sorted(scored)[:n], 1)]
    return sorted(out)


def corpus(rng, n):
    kinds = [f"w{k}" for k in range(60)] + ["running", "runs", "run", "Ångström", "nation", "national"]
    weights = [1 / (1 + i) for i in range(len(kinds))]
    rows = {i: " ".join(rng.choices(kinds, weights, k=rng.randrange(1, 60))) for i in range(n)}
    return rows | {9001: "w0 " * 900, 9002: None, 9003: "", 9004: "w3 w3 W3 w0!w0"}


@pytest.mark.parametrize("stemmed", [False, True])
def test_index_gives_what_reading_all_gives(spark, tmp_path, monkeypatch, stemmed):
    monkeypatch.setattr(postings, "PROBE", 40)
    rows = corpus(random.Random(1), 600)
    queries = {1: ["w0"], 2: ["w0", "w1", "w2"], 3: ["w55", "w0"], 4: ["running", "nation"], 5: ["nothing"], 6: ["w0", "w40", "ångström", "w0"], 7: ["w59"]}
    frame = spark.createDataFrame([*rows.items(), (None, "w0 w0")], "id long, text string")
    asked = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in ws] + [(8, None)], "query_id long, term string")
    index = postings.build(frame, str(tmp_path / "index"), stemmed)
    for n in (5, 50):
        found = sorted(map(tuple, postings.top(index, asked, n).collect()))
        assert found == plain_top(rows, queries, n, porter if stemmed else str)
    report = {r.query_id: (r.postings, r.read) for r in postings.read_report(index, asked, 5).collect()}
    assert all(read <= every for every, read in report.values()) and 5 not in report
    assert report[1][1] < report[1][0] / 3 and sum(r for _, r in report.values()) < 0.9 * sum(p for p, _ in report.values())


def test_index_of_nothing(spark, tmp_path):
    index = postings.build(spark.createDataFrame([(1, None)], "id long, text string"), str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "a")], "query_id long, term string")
    assert postings.top(index, asked).count() == postings.top(index, asked.where("false")).count() == 0


# -- cells -------------------------------------------------------------------


def test_cells_reach_their_recall(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 64))
    rows = [(i, (centres[i % 25] + 0.4 * rng.normal(size=64)).tolist()) for i in range(3_000)]
    rows += [(4_000 + i, rows[0][1]) for i in range(800)] + [(9_000, None), (9_001, [0.0] * 64), (9_002, [1.0]), (9_003, [None] * 64)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    index = cells.build(frame, str(tmp_path / "cells"), 20)
    assert index.rows().count() == 3_800 and 1 <= index.probes < len(index.centroids) / 2
    asked = frame.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    got = retrieval.measured(index, asked, 20).first()
    assert got.n_queries == 76 and got.recall >= 0.9
    found = cells.search(index, asked, 20)
    assert found.groupBy("query_id").agg(F.max("rank").alias("r"), F.count("*").alias("n")).where("r <> 20 or n <> 20").count() == 0
    exact = ranking.exact_neighbours(asked, frame, 20)
    assert sorted(map(tuple, cells.search(index, asked, 20, probes=99_999).collect())) == sorted(map(tuple, exact.collect()))
    both = found.join(exact.select("query_id", "id", F.col("cosine").alias("sure")), ["query_id", "id"])
    assert both.where("cosine <> sure").count() == 0


def test_cells_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([(1, None)], "id long, vector array<double>")
    index = cells.build(frame, str(tmp_path / "cells"))
    assert cells.search(index, frame.withColumnRenamed("id", "query_id")).count() == 0


def test_chunks_all_have_vectors_and_neighbours(spark, data):
    index = retrieval.chunk_cells(spark, data)
    words = search.chunk_rows(spark, data).where(F.col("chunk_text").rlike(r"[\p{L}\p{N}]")).count()
    assert index.rows().count() == words > 100
    got = retrieval.QUERIES["neighbour_recall"](spark, data).first()
    assert got.recall >= 0.9 and got.n_queries >= 8


def test_embedding_adds_up_words(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "B A a!"), (3, None), (4, "..."), (5, "c")], "id long, text string")
    found = {r.id: r.vector for r in embed.embedded(rows, "id", "text").collect()}
    assert np.allclose(found[1], found[2]) and abs(np.linalg.norm(found[1]) - 1) < 1e-9 and found[3] is found[4] is None
    one = {r.id: np.array(r.vector) for r in embed.embedded(spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string"), "id", "text").collect()}
    mixed = math.sqrt(2) * one[1] + one[2]
    assert np.allclose(found[1], mixed / np.linalg.norm(mixed))


# -- the fused search --------------------------------------------------------


def plain_search(saves, chunks, notes, vectors, chunk_vectors, queries, asked, now):
    """The fused list of each query, one list after another: {query: [(position, id, score)]}."""
    out = {}
    for query, words in queries.items():
        lexical = lambda rows: [(key, score) for _, key, score, _ in sorted(plain_top(rows, {query: words}, 50), key=lambda r: r[3])]  # noqa: B023, E731
        near = lambda rows: sorted(((k, round(float(np.dot(asked[query], v)), 6)) for k, v in rows.items() if v is not None), key=lambda r: (-r[1], r[0]))[:50]  # noqa: B023, E731
        lists = {"lexical": lexical({i: s["text"] for i, s in saves.items()}), "note": lexical(notes), "chunk_lexical": lexical(chunks), "vector": near(vectors), "chunk_vector": near(chunk_vectors)}
        scores, admitted = {}, set()
        for name, rows in lists.items():
            seen = set()
            for place, (key, raw) in enumerate(rows, 1):
                key = key // search.PLACES if name.startswith("chunk") else key
                if "vector" not in name or raw >= 0.6:
                    admitted.add(key)
                if key not in seen:
                    seen.add(key)
                    scores[key] = scores.get(key, 0) + ranking.LIST_WEIGHTS[name] / (60 + place)
        final = {}
        for key in admitted:
            age = max((now - saves[key]["created"]) / 86_400, 0)
            score = round(scores[key] + 0.001 * 0.5 ** (age / 30), 9)
            content = saves[key]["content"] or f"item:{key}"
            final[content] = max(final.get(content, (-1, 0)), (score, -key))
        out[query] = [(n, -key, score) for n, (score, key) in enumerate(sorted(final.values(), reverse=True)[:10], 1)]
    return out


def test_search_equals_the_plain_version(spark, data):
    saves = {r.id: {"text": r.search_text, "created": r.created_s, "content": r.content_id} for r in search.searchable_items(spark, data).collect()}
    chunks = {r.chunk_no: r.chunk_text for r in search.chunk_rows(spark, data).collect()}
    notes = {r.id: r.note for r in search.notes(spark, data).collect()}
    of = lambda frame, key, body: {r[key]: r.vector for r in embed.embedded(frame, key, body).collect()}
    batch = search.query_table(spark)
    queries = {q: sorted({r.term for r in search.query_words(batch).where(F.col("query_id") == q).collect()}) for q, _ in search.DEMO_QUERIES}
    args = of(search.searchable_items(spark, data), "id", "search_text"), of(search.chunk_rows(spark, data), "chunk_no", "chunk_text"), queries, of(batch, "query_id", "query")
    expected = plain_search(saves, chunks, notes, *args, binders.NOW)
    found = {}
    for r in search.hybrid_search(spark, data).orderBy("query_id", "position").collect():
        found.setdefault(r.query_id, []).append((r.position, r.id, r.score))
    assert found == {q: rows for q, rows in expected.items() if rows} and len(found) >= 3


def test_reasons_name_times_and_notes(spark):
    terms = F.array(F.lit("apple"))
    said = lambda *args: spark.range(1).select(text.evidence_reason(terms, *map(F.lit, args))).first()[0]
    assert said("pear", "an apple", "14:02", None, None) == "apple (at 14:02)"
    assert said("pear", "an apple", None, None, None) == "apple (in the content)"
    assert said("pear", None, None, "apple pie", None) == "apple (your note)"
    assert said("pear", None, None, None, None) == "similar meaning"


def test_fixtures_are_read_under_their_schemas(spark, tmp_path):
    lines = [
        '{"key": "a", "title": "T", "tags": ["x", "y"], "brief": {"title": "B", "structured_data": {"steps": [1, {"two": null}], "n": 2.5}, "topics": ["t"]}, "invented": 1}',
        '{"key": "b", "brief": {"structured_data": "plain"}}',
        "{broken",
    ]
    (tmp_path / "documents.json").write_text("\n".join(lines))
    rows = fixtures.read(spark, str(tmp_path / "documents.json"), fixtures.DOCUMENTS).select("key", "tags", "brief.title", F.to_json("brief.structured_data").alias("data")).collect()
    assert [tuple(r) for r in rows] == [("a", ["x", "y"], "B", '{"n":2.5,"steps":[1,{"two":null}]}'), ("b", None, None, '"plain"'), (None, None, None, None)]
    (tmp_path / "golden.json").write_text('{\n "items": [{"id": "1", "title": "One", "tags": ["x"]}, {"id": "2"}],\n "queries": [{"q": "first", "expect": "1"}, {"q": "second", "expect": "2"}],\n "metric": "recall"}')
    golden = fixtures.read(spark, str(tmp_path / "golden.json"), fixtures.GOLDEN, multi_line=True)
    assert [tuple(r) for r in fixtures.golden_queries(golden).collect()] == [(1, "first", ["1"]), (2, "second", ["2"])]
    assert [(r.id, r.title, r.tags) for r in fixtures.golden_items(golden).collect()] == [("1", "One", ["x"]), ("2", None, None)]
