"""Costs that grew faster than the input in round 3."""

import numpy as np

from lodestone.llm import quality
from lodestone.operators import cells, evaluate, ranking
from lodestone.plans import content, retrieval


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def unit(rng, n, width=64):
    rows = rng.normal(size=(n, width))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def test_a_task_computes_few_cosines_exactly_and_holds_a_few_times_n():
    rng = np.random.default_rng(3)
    queries, rows = unit(rng, 40), unit(rng, 20_000)
    rows[5_000:7_000] = queries[0]  # copies of a query: ties by id
    ids = rng.permutation(len(rows))
    exact = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            exact.append(np.size(at)) if isinstance(at, np.ndarray) else None
            return np.asarray(super().__getitem__(at))

    best = ranking.Nearest(np.arange(40), queries, 10)
    best.matrix = queries.view(Counted)
    for start in range(0, len(rows), 1_000):
        best.meet(ids[start : start + 1_000], rows[start : start + 1_000])
        assert best.held <= 2 * 10 * 40
    (found,) = best.batches()
    got = sorted(zip(*(c.to_pylist() for c in found.columns), strict=True))
    scores = np.rint(queries @ rows.T * 1e6).astype(int)
    order = [np.lexsort((ids, -s))[:10] for s in scores]
    assert got == sorted((q, int(ids[i]), scores[q, i] / 1e6) for q, some in enumerate(order) for i in some)
    assert sum(exact) < 0.02 * scores.size


def test_odd_vectors_match_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [0.0, 0.0]), (5, [0.6, 0.8])], "id long, vector array<double>")
    found = ranking.exact_neighbours(spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>"), rows, 1)
    assert [tuple(r) for r in found.collect()] == [(9, 1, 1.0, 1)]


def test_queries_in_blocks_find_the_same(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit(rng, 400))], "id long, vector array<double>")
    asked = rows.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    listed = lambda df: sorted(map(tuple, df.collect()))
    assert listed(ranking.exact_neighbours(asked, rows, 7, block=9)) == listed(ranking.exact_neighbours(asked, rows, 7))
    blocks, parts = ranking.in_blocks(asked, 9)
    parts = list(parts)
    assert blocks == len(parts) == 12 and sorted(i for p in parts for i in p.column("query_id").to_pylist()) == list(range(0, 400, 4))


def test_vectors_are_made_once_for_the_cells(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit(np.random.default_rng(6), 300))], "id long, vector array<double>")

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    index = cells.build(rows.mapInArrow(counted, rows.schema), str(tmp_path / "cells"), 5)
    assert made.value == 300 == index.rows().count()


def test_the_true_neighbours_are_looked_for_once(spark, data):
    assert plan_of(retrieval.QUERIES["neighbour_recall"](spark, data)).count("MapInArrow") == 1


def test_a_body_is_stemmed_once_and_not_for_each_word(spark, data):
    plan = plan_of(content.QUERIES["grounded_answers"](spark, data))
    assert "array_contains(array_distinct(" not in plan and plan.count("(__body") <= 2
    talk = spark.createDataFrame([(1, ["baking breads daily", "baking cars daily rockets", "x"], "He bakes a bread; daily baking!")], "id long, said array<string>, body string")
    assert tuple(evaluate.groundedness(talk, "id", "said", "body").first()) == (1, 2, 1, ["baking cars daily rockets"], 0.5)


def test_no_shuffle_of_the_model_stays_beside_the_keys_of_the_texts(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    keys = np.random.default_rng(7).integers(-(1 << 63), 1 << 63, 500)
    before = shuffled()
    bits = np.frombuffer(quality._bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long")), np.uint8)
    assert not shuffled() - before
    places = np.unique(keys.view(np.uint64) >> np.uint64(64 - quality.FILTER_BITS)).astype(int)
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == places.tolist()
