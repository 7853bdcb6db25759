"""The sliding-window limiter, in batch and as a stream, against a plain loop."""

import random

from pyspark.sql import functions as F

from lodestone.streaming import limits


def plain(calls, burst, window):
    out, grants = {}, {}
    for key, at, seq in sorted(calls):
        mine = grants.setdefault(key, [])
        ok = sum(at - g < window for g in mine) < burst
        if ok:
            mine.append(at)
        out[key, at, seq] = ok
    return out


def busy_calls(rng, n):
    """One key with light and overloaded times and pauses, and some others."""
    calls, at = [], 1_000_000
    for i in range(n):
        pace = (5, 60, 140, 700)[i // 150 % 4]
        at += rng.randrange(pace) + (3_000 if rng.random() < 0.003 else 0)
        calls.append(("hot", at, i))
    calls += [(f"k{i % 7}", 1_000_000 + rng.randrange(40_000), i) for i in range(200)]
    return calls + [("tied", 5_000, i) for i in range(15)] + [("tied", 6_000, 99), ("tied", 5_999, 98)]


def test_batch_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(limits, "SLICE", 7)
    calls = busy_calls(random.Random(1), 4_000)
    frame = spark.createDataFrame(calls + [(None, 1, 1), ("x", None, 1)], "key string, at long, seq long").repartition(5)
    for burst, window in ((10, 1_000), (3, 400)):
        found = limits.admit(frame, burst, window).collect()
        assert {(r.key, r.at, r.seq): r.granted for r in found} == plain(calls, burst, window) and len(found) == len(calls)


def test_a_hot_key_is_split(spark, monkeypatch):
    monkeypatch.setattr(limits, "SLICE", 7)
    calls = busy_calls(random.Random(2), 3_000)
    rows = limits.stretches(spark.createDataFrame(calls, "key string, at long, seq long")).where("key = 'hot' and not context")
    sizes = [r["count"] for r in rows.groupBy("stretch").count().collect()]
    assert len(sizes) > 20 and sum(sizes) == 3_000 and max(sizes) < 1_000


def test_no_calls(spark):
    assert limits.admit(spark.createDataFrame([], "key string, at long, seq long")).count() == 0


def test_stream_equals_a_plain_loop(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    calls = sorted(busy_calls(random.Random(3), 500)[:650], key=lambda c: c[1])
    calls = [c for c in calls if c[0] != "tied"]
    rng = random.Random(4)
    for n, start in enumerate(range(0, len(calls), 200)):  # within a file and a little across files, calls come out of order
        part = calls[start : start + 200]
        rng.shuffle(part)
        spark.createDataFrame(part, "key string, at long, seq long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    end = max(c[1] for c in calls) + 100_000
    spark.createDataFrame([("end", end, 0)], "key string, at long, seq long").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    source = spark.readStream.schema("key string, at long, seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = lambda batch, number: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
    limits.stream(source, "20 seconds").writeStream.foreachBatch(out).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").where(F.col("key") != "end").collect()
    decided = {(r.key, r.at, r.seq): r.granted for r in found}
    assert len(found) == len(decided)
    assert decided == plain(calls, 10, 1_000)
