"""Weekly preferences on the clocks of real zones: which fifteen-minute tick serves whom.

A zone is a list of intervals in which its distance from UTC stays the same. Ticks meet local schedules within these
intervals, so days on which the clock skips or repeats an hour need no rule of their own: a moment that is skipped lies
in no interval, one that is repeated lies in two.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import clock

#: Fixed value: seconds between ticks, and how long after the preferred moment it may still be served.
TICK = 900
WEEK = 7 * 86_400


def _offset(zone: ZoneInfo, at: int) -> int:
    return int(dt.datetime.fromtimestamp(at, dt.timezone.utc).astimezone(zone).utcoffset().total_seconds())


def intervals(zone: str, begin: int, end: int) -> list[tuple[int, int, int]]:
    """(from, to, offset) in UTC seconds from ``begin`` to ``end``; none for a zone that this host does not know."""
    try:
        known = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError, OSError, TypeError):
        return []
    out, start, offset = [], begin, _offset(known, begin)
    for day in range(begin, end, 86_400):  # no zone changes its clock twice within a day
        low, high = day, min(day + 86_400, end)
        if _offset(known, high) == offset:
            continue
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if _offset(known, middle) == offset else (low, middle)
        out.append((start, high, offset))
        start, offset = high, _offset(known, high)
    return [*out, (start, end, offset)]


def zone_table(spark: SparkSession, zones: DataFrame, begin: int, end: int) -> DataFrame:
    """(zone, from_s, to_s, offset_s) of the distinct values of ``zones``' column zone; at most the zones there are, some 600.

    What is no zone has no row. Names longer than any zone's are not looked at, so what the driver reads stays small.
    """
    from zoneinfo import available_timezones

    known = spark.createDataFrame([(z,) for z in sorted(available_timezones())], "zone string")
    used = [r.zone for r in zones.select("zone").distinct().join(F.broadcast(known), "zone", "left_semi").collect()]
    rows = [(z, *i) for z in used for i in intervals(z, begin, end)]
    return spark.createDataFrame(rows, "zone string, from_s long, to_s long, offset_s long")


def due_ticks(preferences: DataFrame, begin: int, end: int) -> DataFrame:
    """(owner, tick_s, scheduled_s, week): the ticks in [begin, end) at which each preference is due.

    ``preferences`` are (owner, weekday from Monday 0, hour, minute, zone). A tick serves a preference if its wall clock
    lies less than fifteen minutes after the preferred moment, which is of the preferred day even if the tick falls on the
    next; that day names the ISO week. A moment that the clock skips is not served, unless its fifteen minutes reach the
    hour it skips to; one that is repeated is served twice. A preference with a null or an unknown zone is skipped.

    Preferences meet their zone's intervals (a small table, broadcast), each gives the weekly moments within an interval,
    and each moment the one tick that falls into its fifteen minutes, if the interval has it. No tick meets a preference
    it doesn't serve.
    """
    zones = F.broadcast(zone_table(preferences.sparkSession, preferences, begin - 86_400, end + 86_400))
    rows = preferences.where("weekday between 0 and 6 and hour between 0 and 23 and minute between 0 and 59").join(zones, "zone")
    # in local seconds: the first preferred moment after a quarter of an hour before the interval, then one a week
    wanted = F.col("weekday") * 86_400 + F.col("hour") * 3_600 + F.col("minute") * 60 - 3 * 86_400  # the epoch was a Thursday
    start, stop = F.col("from_s") + F.col("offset_s") - TICK + 1, F.col("to_s") + F.col("offset_s") - 1
    first = start + F.pmod(wanted - start, F.lit(WEEK))
    moments = F.when(first <= stop, F.sequence(first, stop, F.lit(WEEK)))
    each = rows.select("owner", "from_s", "to_s", "offset_s", F.explode(moments).alias("scheduled_s"))
    at = F.col("scheduled_s") - F.col("offset_s")
    tick = F.ceil(F.greatest(at, "from_s") / TICK) * TICK
    served = each.withColumn("tick_s", tick).where((F.col("tick_s") < at + TICK) & (F.col("tick_s") < F.col("to_s")) & (F.col("tick_s") >= begin) & (F.col("tick_s") < end))
    return served.select("owner", "tick_s", "scheduled_s", clock.iso_week(F.col("scheduled_s")).alias("week"))
