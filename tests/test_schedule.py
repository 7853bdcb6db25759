"""Ticks on real clocks against asking every tick, and weekly notes through replays, kills and failed deliveries."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lodestone.operators import schedule
from lodestone.streaming import weekly

DAY = 86_400


def plain_ticks(preferences, begin, end):
    """Asks at every tick who is due, as a clock on the wall shows it."""
    out = []
    for owner, weekday, hour, minute, zone in preferences:
        for tick in range(begin, end, 900):
            local = dt.datetime.fromtimestamp(tick, ZoneInfo(zone)).replace(tzinfo=None)
            moment = (local - dt.timedelta(days=(local.weekday() - weekday) % 7)).replace(hour=hour, minute=minute, second=0)
            if 0 <= (local - moment).total_seconds() < 900:
                year, week, _ = moment.isocalendar()
                out.append((owner, tick, int((moment - dt.datetime(1970, 1, 1)).total_seconds()), f"{year}-W{week:02d}"))
    return sorted(out)


@pytest.mark.parametrize("day", ["2026-03-02", "2026-03-25", "2026-09-30", "2026-10-21", "2026-12-24"])
def test_ticks_equal_asking_each(spark, day):
    rng = random.Random(day)
    zones = ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kathmandu", "UTC", "Pacific/Kiritimati", "America/St_Johns"]
    rows = [(i, rng.randrange(7), rng.choice([0, 1, 2, 3, rng.randrange(24)]), rng.randrange(60), rng.choice(zones)) for i in range(120)]
    rows += [(500, 6, 23, 50, "UTC"), (501, 6, 2, 30, "Europe/Berlin"), (502, 6, 2, 50, "Europe/Berlin"), (503, 6, 2, 30, "America/New_York"), (504, 6, 1, 30, "America/New_York")]
    odd = [(600, 1, 1, 1, "Mars/Olympus"), (601, 1, 1, 1, None), (602, 1, 1, 1, ""), (603, None, 1, 1, "UTC"), (604, 1, 99, 1, "UTC"), (605, 1, 1, 1, "../etc")]
    begin = int(dt.datetime.fromisoformat(f"{day}T00:00:00+00:00").timestamp())
    frame = spark.createDataFrame(rows + odd, "owner long, weekday int, hour int, minute int, zone string")
    found = sorted(tuple(r) for r in schedule.due_ticks(frame, begin, begin + 15 * DAY).collect())
    assert found == plain_ticks(rows, begin, begin + 15 * DAY)


def test_skipped_and_repeated_moments(spark):
    frame = spark.createDataFrame([(1, 6, 2, 30, "Europe/Berlin"), (2, 6, 2, 50, "Europe/Berlin")], "owner long, weekday int, hour int, minute int, zone string")
    day = lambda text: int(dt.datetime.fromisoformat(f"{text}T00:00:00+00:00").timestamp())
    forward = schedule.due_ticks(frame, day("2026-03-28"), day("2026-03-31")).collect()
    assert [(r.owner, r.tick_s - day("2026-03-29")) for r in forward] == [(2, 3600)]  # 03:00, ten minutes after a moment that never came
    back = schedule.due_ticks(frame.where("owner = 1"), day("2026-10-24"), day("2026-10-27")).collect()
    assert sorted(r.tick_s - day("2026-10-25") for r in back) == [1800, 5400] and {r.week for r in back} == {"2026-W43"}


def test_intervals_cover_time_once():
    found = schedule.intervals("Australia/Lord_Howe", 1_780_000_000, 1_800_000_000)
    assert found[0][0] == 1_780_000_000 and found[-1][1] == 1_800_000_000 and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert {o for *_, o in found} == {37_800, 39_600} and schedule.intervals("Mars/Olympus", 0, 1) == []


# -- once a week -------------------------------------------------------------


class Post:
    """Delivers to a folder, a file a message, so what was passed on twice would show; owners may be out of reach."""

    def __init__(self, folder, away=(), die=0):
        self.folder, self.away, self.die, self.calls = folder, set(away), die, 0
        folder.mkdir(exist_ok=True)

    def __call__(self, claimed):
        self.calls += 1
        rows = claimed.collect()
        for r in rows:
            if r.owner not in self.away:
                file = self.folder / r.message
                file.write_text(file.read_text() if file.exists() else f"{r.owner} {r.week} {r.tick_s}")
        if self.die == self.calls:
            raise RuntimeError("killed between delivery and record")
        return claimed.withColumn("delivered", ~F.col("owner").isin(*self.away) if self.away else F.lit(True))

    def messages(self):
        return sorted(f.read_text() for f in self.folder.iterdir())


def due_files(spark, folder, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "owner long, week string, tick_s long").coalesce(1).write.parquet(f"{folder}/due/{n}")
    return spark.readStream.schema("owner long, week string, tick_s long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/due/*")


def test_a_killed_run_sends_once(spark, tmp_path):
    batches = [[(1, "w1", 10), (2, "w1", 10), (1, "w1", 20), (None, "w1", 1)], [(1, "w1", 30), (3, "w1", 30)], [(1, "w2", 40), (2, "w1", 50)]]
    source, base = due_files(spark, tmp_path, batches), str(tmp_path / "base")
    post = Post(tmp_path / "post", die=2)
    with pytest.raises(Exception, match="killed"):
        weekly.run(source, base, post)
    assert len(post.messages()) == 3
    weekly.run(source, base, post)
    assert post.messages() == ["1 w1 10", "1 w2 40", "2 w1 10", "3 w1 30"]
    found = weekly.ledger(spark, base).where("delivered").select("owner", "week").collect()
    assert sorted(map(tuple, found)) == [(1, "w1"), (1, "w2"), (2, "w1"), (3, "w1")]


def test_a_replayed_batch_and_a_failed_delivery(spark, tmp_path):
    due = spark.createDataFrame([(1, "w1", 10), (2, "w1", 10)], "owner long, week string, tick_s long")
    base, away = str(tmp_path / "base"), Post(tmp_path / "post", away=[2])
    weekly.send_batch(due, 0, base, away)
    weekly.send_batch(due, 0, base, away)
    assert away.calls == 1 and away.messages() == ["1 w1 10"]
    back = Post(tmp_path / "post")
    weekly.send_batch(due.withColumn("tick_s", F.lit(11)), 1, base, back)  # the failed one was released, the other was not
    weekly.send_batch(due.withColumn("tick_s", F.lit(12)), 2, base, back)
    assert back.messages() == ["1 w1 10", "2 w1 11"]
    assert weekly.ledger(spark, base).where("delivered").count() == 2
