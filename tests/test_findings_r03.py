"""Costs that round 3 found: what is read once, and what is dealt evenly."""

import pytest

from lodestone.functions import embed, stem
from lodestone.operators import postings
from lodestone.plans import briefs, saves, upkeep


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", [saves.QUERIES["shares_taken"], saves.QUERIES["reused_results"], upkeep.QUERIES["detached"], upkeep.QUERIES["guest_leavings"]])
def test_orders_and_their_lines_are_joined_once(spark, data, query):
    assert "o_orderkey" not in plan_of(query(spark, data))


def test_postings_are_dealt_by_row_before_queries_meet_them(spark, tmp_path):
    texts = spark.createDataFrame([(i, "the " * (i % 5 + 1) + f"w{i % 7}") for i in range(200)], "id long, text string")
    queries = spark.createDataFrame([(q, t) for q in range(9) for t in ("the", f"w{q}")], "query_id long, term string")
    for stemmed in (False, True):
        index = postings.build(texts, f"{tmp_path}/{stemmed}", stemmed)
        found = postings.top(index, queries, 5)
        assert "RepartitionByExpression [id" in plan_of(found)
        for q in range(9):
            tf = {i: [(i % 5 + 1), int(i % 7 == q)] for i in range(200)}
            plain = sorted((-round(sum(n / (n + 1.2) for n in c), 9), i) for i, c in tf.items())[:5]
            assert [(-r.raw, r.id) for r in sorted(found.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] == plain


def test_a_brief_is_written_once(spark, data):
    assert plan_of(briefs.QUERIES["brief_report"](spark, data)).lower().count("structstojson") <= 2


def test_python_gets_bounded_batches_and_keeps_bounded_stems(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    embed.embedded(spark.createDataFrame([(1, "a b")], "id long, text string"), "id", "text")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 4 << 20
    assert stem.porter.cache_info().maxsize <= 1 << 16
