"""A sliding-window rate limiter: a call is granted if fewer than ``burst`` calls were granted within the window before it.

Who is granted depends on who was granted before, so a key's calls are taken in order. In batch, keys are cut where
the state is known whatever came before, so one busy key is many independent stretches; as a stream, the last
grants of a key are its state, and calls wait for the watermark so that late ones still take their turn.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: Grants within a window, and the window in milliseconds.
BURST, WINDOW_MS = 10, 1_000
#: Windows that make a slice of time, the unit in which a key's calls are looked at for places to cut.
SLICE = 60


class Ring:
    """The grants of the last window, oldest first."""

    def __init__(self, burst: int = BURST, window: int = WINDOW_MS, times: list[int] = ()):
        self.burst, self.window, self.times = burst, window, deque(times)

    def ask(self, at: int) -> bool:
        while self.times and at - self.times[0] >= self.window:
            self.times.popleft()
        if len(self.times) >= self.burst:
            return False
        self.times.append(at)
        return True


def stretches(calls: DataFrame, burst: int = BURST, window: int = WINDOW_MS) -> DataFrame:
    """``calls`` (key, at, seq) with ``stretch`` and ``context``: each stretch can be decided by itself.

    A call is light if the window up to it has at most ``burst`` calls, its own time's included: it is granted whatever was
    granted before. A key is cut at a call with none but light ones in the window before it, at the first such of a slice:
    all calls of that window count there. These go with the stretch as ``context`` rows, which are repeated and not to be
    decided. Slices, not keys, are the groups of every window here, but for one that runs over a row a slice.
    """
    size = SLICE * window
    own = F.floor(F.col("at") / size)
    # a call whose window reaches into the next slice is looked at there too
    spread = F.explode(F.when(F.floor((F.col("at") + window - 1) / size) > own, F.array(own, own + 1)).otherwise(F.array(own)))
    seen = calls.where("key is not null and at is not null").select("key", "at", "seq", own.alias("own"), spread.alias("slice"))
    of_slice = W.partitionBy("key", "slice").orderBy("at")
    heavy = seen.withColumn("heavy", F.count("*").over(of_slice.rangeBetween(1 - window, 0)) > burst)
    # whether a copied call is heavy is known in its own slice only: there its whole window is
    known = heavy.where("own = slice").select("key", "at", "seq", "own", "heavy", spread.alias("slice"))
    before = F.max(F.col("heavy").cast("int")).over(of_slice.rangeBetween(1 - window, -1))
    cut = F.when((F.col("own") == F.col("slice")) & (F.coalesce(before, F.lit(0)) == 0), F.col("at"))
    marked = known.withColumn("cut", cut)
    cuts = marked.groupBy("key", "slice").agg(F.min("cut").alias("cut"))
    ordered = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    cuts = cuts.withColumn("since", F.coalesce(F.last("cut", ignorenulls=True).over(ordered), F.lit(-(2**62))))
    rows = known.join(cuts, ["key", "slice"])
    decided = F.when(F.col("own") == F.col("slice"), F.struct(F.when(F.col("at") >= F.col("cut"), F.col("cut")).otherwise(F.col("since")).alias("stretch"), F.lit(False).alias("context")))
    context = F.when((F.col("at") < F.col("cut")) & (F.col("at") > F.col("cut") - window), F.struct(F.col("cut").alias("stretch"), F.lit(True).alias("context")))
    return rows.select("key", "at", "seq", F.explode(F.array_compact(F.array(decided, context))).alias("s")).select("key", "at", "seq", "s.stretch", "s.context")


def admit(calls: DataFrame, burst: int = BURST, window: int = WINDOW_MS) -> DataFrame:
    """(key, at, seq, granted) for ``calls`` (key string, at in milliseconds, seq; calls of one time are taken by seq).

    Stretches stream through tasks in order of time with the ring of one in memory. A stretch ends where a key has let up
    for one window; one that never does is one stretch, as each grant then depends on all before. Calls without key or
    time are left out; repeated ones are separate calls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ring = None, Ring(burst, window)
        for batch in batches:
            keys, ats, seqs, starts, contexts = (batch.column(i).to_pylist() for i in range(5))
            granted = []
            for key, at, start in zip(keys, ats, starts, strict=True):
                if (key, start) != held:
                    held, ring = (key, start), Ring(burst, window)
                granted.append(ring.ask(at))
            keep = pa.array([not c for c in contexts])
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(granted, pa.bool_())], ["key", "at", "seq", "granted"])
            yield out.filter(keep)

    rows = stretches(calls.select(F.col("key").cast("string").alias("key"), F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq")), burst, window)
    dealt = rows.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at", "seq")
    return dealt.select("key", "at", "seq", "stretch", "context").mapInArrow(run, "key string, at long, seq long, granted boolean")


class Limiter(StatefulProcessor):
    """The same decisions over a stream. A key's state is its ring and the calls that the watermark has not passed yet.

    An event-time timer at a batch's last call decides all calls up to it, in order; whatever comes later than that is
    late and dropped by the watermark. A timer one window later clears the ring, so quiet keys hold no state.
    """

    def __init__(self, burst: int = BURST, window: int = WINDOW_MS) -> None:
        self.burst, self.window = burst, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "times array<long>")
        self.waiting = handle.getListState("waiting", "at long, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = 0
        for frame in rows:
            ats = frame["at"].astype("int64").tolist()
            self.waiting.appendList(list(zip(ats, frame["seq"].astype("int64").tolist(), strict=True)))
            last = max(last, *ats)
        self.handle.registerTimer(last)
        yield _decided([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        calls = sorted((int(at), int(seq)) for at, seq in self.waiting.get())
        due, later = [c for c in calls if c[0] <= until], [c for c in calls if c[0] > until]
        ring = Ring(self.burst, self.window, self.ring.get()[0] if self.ring.exists() else [])
        out = [(key[0], at, seq, ring.ask(at)) for at, seq in due]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if due:
            self.ring.update(([int(t) for t in ring.times],))
            self.handle.registerTimer(until + self.window)
        elif not later and (not ring.times or until - ring.times[-1] >= self.window):
            self.ring.clear()
        yield _decided(out)

    def close(self) -> None:
        pass


def _decided(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "at", "seq", "granted"]).astype({"key": "object", "at": "int64", "seq": "int64", "granted": "bool"})


def stream(calls: DataFrame, late: str = "1 second", burst: int = BURST, window: int = WINDOW_MS) -> DataFrame:
    """Decisions on a streaming DataFrame of calls (key string, at, seq), which may come ``late`` and out of order."""
    timed = calls.where("key is not null and at is not null").withColumn("time", F.timestamp_millis("at")).withWatermark("time", late)
    return timed.groupBy("key").transformWithStateInPandas(Limiter(burst, window), "key string, at long, seq long, granted boolean", "Append", "EventTime")
