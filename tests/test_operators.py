"""Filters, merges, ranking and the job state machine on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import filters, lifecycle, merges, ranking
from lodestone.streaming import jobs


def test_facets_are_checked():
    assert filters.read_facets({"topic": "AI", "saved": "2026-01-01"})
    for bad in ({"x": "1"}, {"topic": " "}, {"saved": "yesterday"}, {"topic": "a" * 513}):
        with pytest.raises(ValueError):
            filters.read_facets(bad)


def test_entity_is_data_not_a_pattern(spark):
    rows = spark.createDataFrame([(1, ["C++ Builder"], ["Ann"]), (2, ["CSS"], [])], "id long, tools array<string>, people array<string>")
    assert [r.id for r in rows.where(filters.has_entity("c++")).collect()] == [1]
    assert rows.where(filters.has_entity(".*")).count() == 0
    assert rows.where(filters.has_entity("build")).count() == 0


def test_forgotten_boundary(spark):
    now = 10_000_000
    rows = spark.createDataFrame([(1, now - filters.WEEK), (2, now - filters.WEEK - 1)], "id long, created_s long").select("*", F.lit(None).cast("long").alias("opened_s"), F.lit(None).cast("long").alias("deleted_s"))
    assert [r.id for r in rows.where(filters.forgotten(now)).collect()] == [2]


def test_empty_allow_list_allows_nothing(spark):
    rows = spark.createDataFrame([(1,)], "id long")
    assert filters.allow_list(rows, rows.where("false")).count() == 0


def test_survivors_fill_missing_fields(spark):
    rows = spark.createDataFrame([("k", 2, "b", None), ("k", 1, None, None), ("k", 3, "c", "x")], "key string, id long, title string, note string")
    assert tuple(merges.survivors(rows, "key", ["id"], ["title", "note"]).first()) == ("k", 1, "b", "x", 3)


def test_reconcile(spark):
    local = spark.createDataFrame([(1, "l", True), (2, "l", False), (3, "l", False)], "id long, v string, dirty boolean")
    remote = spark.createDataFrame([(1, "r"), (3, "r"), (4, "r")], "id long, v string")
    assert sorted(map(tuple, merges.reconcile(local, remote, "id", "v", "dirty").collect())) == [(1, "l", True), (3, "r", False), (4, "r", False)]


def test_fusion_gate_and_order(spark):
    rows = [(1, "lexical", 1, 1, 0.1, 0, "a"), (1, "vector", 2, 1, 0.59, 0, "b"), (1, "vector", 3, 2, 0.60, 0, "c"), (1, "lexical", 1, 7, 0.1, 0, "a"), (1, "note", 4, 1, 0.2, 0, "a")]
    schema = "query_id long, list string, id long, rank int, raw double, created_s long, content_id string"
    scores = {}
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        fused = ranking.fuse(spark.createDataFrame(rows, schema), 0)
        scores[seed] = {r.id: r.score for r in fused.collect()}
    assert scores[0] == scores[1] and set(scores[0]) == {1, 3, 4}
    assert scores[0][1] == pytest.approx(0.3 / 61 + 0.001, abs=1e-9)
    assert [r.id for r in ranking.collapse(fused, 5).orderBy("position").collect()] == [3, 4]


def test_job_transitions():
    job = jobs.step(jobs.Job(), "record", 0, 0)
    assert jobs.step(job, "record", 5, 0) == job
    job = jobs.step(job, "claim", 1, 7)
    assert job.status == "PROCESSING" and jobs.step(job, "succeed", 2, 8).rejected == 1
    assert jobs.step(job, "succeed", 2, 7).status == "READY"
    assert jobs.step(job, "pause", 2, 7).attempts == 0
    lost = jobs.step(job, "heartbeat", 1000, 7)
    assert lost.status == "PENDING" and lost.attempts == 1 and lost.available_s == 303
    for n in range(1, 6):
        job = jobs.step(jobs.step(job, "claim", n * 1000, n), "fail", n * 1000 + 1, n) if job.status == "PENDING" else jobs.step(job, "fail", 2, 7)
    assert job.status == "FAILED" and job.attempts == 5 and job.claimed_s == 1


def test_replay_equals_the_plain_fold(spark):
    random.seed(3)
    rows = [(random.randrange(5), random.randrange(3000), i, random.choice(["record", "claim", "heartbeat", "succeed", "fail", "pause"]), random.randrange(2)) for i in range(400)]
    plain = {}
    for job, at, _, action, token in sorted(rows):
        plain[job] = jobs.step(plain.get(job, jobs.Job()), action, at, token)
    found = jobs.replay(spark.createDataFrame([*rows, (None, 1, 1, "record", 0)], "job long, at_s long, seq long, action string, token long"))
    assert {r.job: jobs.row_state(r) for r in found.collect()} == plain


def test_lost_worker_fails_without_an_event(spark):
    log = spark.createDataFrame([(1, 0, 1, "record", 0), (1, 5, 2, "claim", 7)], "job long, at_s long, seq long, action string, token long")
    state = lambda until: tuple(jobs.replay(log, until).select("status", "attempts", "available_s").first())
    assert state(None) == state(305) == ("PROCESSING", 0, 0)
    assert state(306) == ("PENDING", 1, 307)


def test_lost_worker_fails_by_timer_in_a_stream(spark, tmp_path):
    schema = "job long, at_s long, seq long, action string, token long"
    spark.createDataFrame([(1, 0, 1, "record", 0), (1, 5, 2, "claim", 7), (2, 0, 3, "record", 0)], schema).write.parquet(f"{tmp_path}/in")
    log, seen = spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        keep = lambda batch, number: seen.extend((r.job, r.status, r.attempts) for r in batch.collect())
        run = jobs.stream(log, wait_s=1).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
        for _ in range(60):
            if (1, "PENDING", 1) in seen or run.awaitTermination(1):
                break
        run.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert (1, "PROCESSING", 0) in seen and seen[-1] == (1, "PENDING", 1) and seen.count((2, "PENDING", 0)) == 1


def test_stages_resume_after_the_last_one(spark):
    rows = spark.createDataFrame([(1, "BRIEF"), (2, "EMBED"), (3, None), (4, "other")], "id long, last string")
    left = lifecycle.remaining_stages(rows, "id", "last").collect()
    assert sorted((r.stage_idx, r.stage) for r in left if r.id == 1) == [(4, "CHUNK"), (5, "EMBED")]
    assert not [r for r in left if r.id == 2] and len([r for r in left if r.id == 3]) == len([r for r in left if r.id == 4]) == 6


def test_links_are_kept_and_jobs_closed(spark):
    saves = [(1, "a", "failed", False, False), (2, "a", "failed", False, False), (3, "b", "failed", False, False), (4, "b", "ready", False, False), (5, "c", "ready", True, False), (6, "d", "ready", False, True), (7, None, "failed", None, False)]
    items = spark.createDataFrame(saves, "id long, content_id string, status string, needs_retry boolean, link_only boolean")
    held = spark.createDataFrame([("a", False), ("b", False), ("b", None), ("c", True)], "content_id string, held boolean")
    asked = spark.createDataFrame([(i,) for i in (1, 3, 3, 4, 5, 6, 7, 99)], "id long")
    found = {r.id: (r.outcome, r.closes_job) for r in lifecycle.keep_links(items, held, asked).collect()}
    assert found == {1: ("kept", False), 3: ("kept", True), 4: ("refused", False), 5: ("busy", False), 6: ("unchanged", False), 7: ("kept", False)}


def test_chunks_are_copied_as_they_were(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (2, 1, "bb"), (3, 0, "c")], "item_id long, chunk_idx int, chunk_text string")
    copies = spark.createDataFrame([(2, 1), (2, 3), (3, 2), (1, 1), (9, None)], "target long, source long")
    assert sorted(map(tuple, lifecycle.copy_chunks(chunks, copies).select("item_id", "chunk_idx", "chunk_text").collect())) == [(1, 0, "a"), (2, 0, "a"), (3, 0, "b"), (3, 1, "bb")]


def test_work_at_once(spark):
    day = lifecycle.DAY
    holds = [("ai", 0, 10), ("ai", 5, day + 5), ("ai", 10, 20), ("ai", day, day + 9), ("ai", 3, 3), ("fetch", 1, 2), (None, 1, 2)]
    found = {r.stage: (r.total, r.peak, r.within) for r in lifecycle.busiest(spark.createDataFrame(holds, "stage string, started_s long, ended_s long"), {"ai": 1, "fetch": 1}).collect()}
    assert found == {"ai": (4, 2, False), "fetch": (1, 1, True)}
