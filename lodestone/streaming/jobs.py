"""The durable job state machine: one transition function, replayed in batch or run by Structured Streaming.

A job is PENDING, PROCESSING, READY or FAILED. Recording is a no-op while a job is active; a claim takes a token and a
lease; success ends it; failure waits with backoff or, at the cap, fails for good; a lease that runs out is a failure; a
pause puts it back without counting an attempt; anything under another token is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: Attempts before a job fails, seconds of a lease, and the bounds of backoff.
MOST_ATTEMPTS, LEASE, BACKOFF_BASE, BACKOFF_MOST = 5, 300, 2, 300

STATE = "status string, attempts int, token long, locked_s long, available_s long, claimed_s long, rejected int, completed int"
RESULT = f"job long, {STATE}"


@dataclass(frozen=True)
class Job:
    status: str = "NONE"
    attempts: int = 0
    token: int = -1
    locked_s: int = -1
    available_s: int = 0
    claimed_s: int = -1
    rejected: int = 0
    completed: int = 0


def _failed(job: Job, at: int) -> Job:
    attempts = job.attempts + 1
    if attempts >= MOST_ATTEMPTS:
        return replace(job, status="FAILED", attempts=attempts, token=-1, locked_s=-1)
    wait = min(BACKOFF_BASE * 2 ** min(attempts - 1, 20), BACKOFF_MOST)
    return replace(job, status="PENDING", attempts=attempts, token=-1, locked_s=-1, available_s=at + wait)


def expire(job: Job, at: int) -> Job:
    """The job at a time without an event: a lease that ran out before it is one failed attempt."""
    if job.status == "PROCESSING" and job.locked_s >= 0 and at - job.locked_s > LEASE:
        return _failed(job, job.locked_s + LEASE)
    return job


def step(job: Job, action: str, at: int, token: int) -> Job:
    """The job after one event."""
    job = expire(job, at)
    held = job.status == "PROCESSING" and job.token == token
    if action == "record":
        return Job("PENDING", available_s=at, rejected=job.rejected, completed=job.completed) if job.status in ("NONE", "READY", "FAILED") else job
    if action == "claim":
        if job.status == "PENDING" and job.available_s <= at:
            return replace(job, status="PROCESSING", token=token, locked_s=at, claimed_s=at if job.claimed_s < 0 else job.claimed_s)
        return replace(job, rejected=job.rejected + 1)
    if not held:
        return replace(job, rejected=job.rejected + 1) if job.status != "NONE" else job
    if action == "heartbeat":
        return replace(job, locked_s=at)
    if action == "succeed":
        return replace(job, status="READY", attempts=job.attempts + 1, token=-1, locked_s=-1, completed=job.completed + 1)
    if action == "pause":
        return replace(job, status="PENDING", token=-1, locked_s=-1, available_s=at + 60)
    return _failed(job, at)


def replay(log: DataFrame, until: int | None = None) -> DataFrame:
    """Every job's state from its log (job, at_s, seq, action, token), in time order, as of its last event or of ``until``.

    With ``until``, a lost worker's job whose lease ran out by then has failed once, though no event says so. Rows of a job
    stream through one task in order with only its state in memory, so a long log is no group to collect.
    """

    def row(key: int, job: Job) -> tuple:
        return (key, *astuple(job if until is None else expire(job, until)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, out = None, Job(), []
        for frame in frames:
            for key, at, action, token in zip(frame["job"], frame["at_s"], frame["action"], frame["token"], strict=True):
                if key != held:
                    if held is not None:
                        out.append(row(held, state))
                    held, state = key, Job()
                state = step(state, action, int(at), int(token))
            if len(out) >= 10_000:
                yield _frame(out)
                out = []
        if held is not None:
            out.append(row(held, state))
        yield _frame(out)

    return log.where("job is not null").repartition("job").sortWithinPartitions("job", "at_s", "seq").mapInPandas(run, RESULT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["job", "status", "attempts", "token", "locked_s", "available_s", "claimed_s", "rejected", "completed"])


class JobProcessor(StatefulProcessor):
    """The same transitions over a stream; the state of a job is one value in the state store.

    With ``wait_s``, a job under way has a timer: if no event of it comes within that many seconds of processing time, its
    lease counts as run out. The timer starts at the last event's arrival, so a log that comes late loses no job.
    """

    def __init__(self, wait_s: int | None) -> None:
        self.wait_s = wait_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _stored(self) -> Job:
        return Job(*self.state.get()) if self.state.exists() else Job()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        job = self._stored()
        events = pd.concat(list(rows)).sort_values(["at_s", "seq"])  # one job's events of one micro-batch
        for at, action, token in zip(events["at_s"], events["action"], events["token"], strict=True):
            job = step(job, action, int(at), int(token))
        self.state.update(astuple(job))
        if self.wait_s is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if job.status == "PROCESSING":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_s * 1000)
        yield _frame([(key[0], *astuple(job))])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self._stored()
        job = expire(job, job.locked_s + LEASE + 1)
        self.state.update(astuple(job))
        yield _frame([(key[0], *astuple(job))])

    def close(self) -> None:
        pass


def stream(log: DataFrame, wait_s: int | None = LEASE) -> DataFrame:
    """A streaming DataFrame of job states from a streaming log; the last row of a job is its state.

    ``wait_s`` is how long a silent job under way keeps its lease; None, for runs that end, sets no timers, as these would
    ask for ever more micro-batches.
    """
    mode = "None" if wait_s is None else "ProcessingTime"
    return log.where("job is not null").groupBy("job").transformWithStateInPandas(JobProcessor(wait_s), RESULT, "Update", mode)


def as_log(events: DataFrame) -> DataFrame:
    """The event table as a job log: sign-ups record, views claim, clicks keep alive, purchases succeed, errors fail."""
    action = F.when(F.col("event_type") == "signup", "record").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "purchase", "succeed").otherwise("fail")
    return events.select(F.col("user_id").alias("job"), "at_s", F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 2).alias("token"))


def spend_quotas(uses: DataFrame, limits: dict[str, int], window: int) -> DataFrame:
    """Which uses (owner, at_s, seq, amounts by counter) fit all fixed-window counters; none is spent unless all fit.

    A counter's window starts at its first spend and lasts ``window`` seconds. Rows of an owner stream through one task.
    """
    names = list(limits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, spent, started = None, {}, {}
        for frame in frames:
            granted = []
            for row in frame.itertuples(index=False):
                if row.owner != owner:
                    owner, spent, started = row.owner, dict.fromkeys(names, 0), dict.fromkeys(names)
                for name in names:
                    if started[name] is not None and row.at_s >= started[name] + window:
                        spent[name], started[name] = 0, None
                fits = all(spent[n] + getattr(row, n) <= limits[n] for n in names)
                if fits:
                    for n in names:
                        if getattr(row, n):
                            spent[n] += getattr(row, n)
                            started[n] = row.at_s if started[n] is None else started[n]
                granted.append(fits)
            yield frame[["owner", "seq"]].assign(granted=granted)

    return uses.repartition("owner").sortWithinPartitions("owner", "at_s", "seq").mapInPandas(run, "owner long, seq long, granted boolean")


def row_state(row: Row) -> Job:
    return Job(*(row[c] for c in ("status", "attempts", "token", "locked_s", "available_s", "claimed_s", "rejected", "completed")))
