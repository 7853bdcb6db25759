"""Time, backoff, histogram and quota expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def backoff(attempt: Column, base: int = 2, most: int = 300) -> Column:
    """Seconds before the next attempt: doubled each time, up to five minutes."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(20))), F.lit(float(most))).cast("long")


def media_delay(attempt: Column) -> Column:
    return backoff(attempt, 30, 3600)


def retry_delay(header: Column, attempt: Column, now: Column, jitter: Column | None = None) -> Column:
    """Seconds until a provider is asked again: what Retry-After says, in seconds or as a date, else doubled from 0.5 up to 8.

    Only a delay that the header doesn't set is spread, by ``jitter`` in [0, 1): from 0.8 of it to 1.2. Seconds that are
    negative or no finite number, and dates that can't be read, are no answer; a date gone by is no wait.
    """
    said = F.trim(header)
    seconds = F.when(said.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), said.try_cast("double"))
    date = F.regexp_extract(said, r"^(?:[A-Za-z]{3}, )?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    at = F.unix_seconds(F.try_to_timestamp(F.when(date != "", F.concat(date, F.lit(" +0000"))), F.lit("d MMM yyyy HH:mm:ss xx")))
    doubled = F.least(F.lit(8.0), F.lit(0.5) * F.pow(F.lit(2.0), attempt - 1)) * (F.lit(0.8) + F.lit(0.4) * (F.rand() if jitter is None else jitter))
    asked = F.when((seconds >= 0) & (seconds < float("inf")), seconds)
    return F.coalesce(asked, F.greatest(F.lit(0), at - now).cast("double") + F.when(at.isNull(), F.lit(None)).otherwise(F.lit(0.0)), doubled)


def local_seconds(utc_seconds: Column, zone: Column) -> Column:
    """Wall-clock seconds in a zone; the zone must be a known one (filter first)."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc_seconds), zone))


def scheduled(local: Column, weekday: Column, hour: Column, minute: Column) -> Column:
    """The latest preferred weekday's date at hour:minute, in local wall-clock seconds; Monday is 0."""
    day = F.floor(local / 86_400)
    back = F.pmod(F.weekday(F.timestamp_seconds(local)) - weekday, F.lit(7))
    return (day - back) * 86_400 + hour * 3600 + minute * 60


def weekly_due(local: Column, weekday: Column, hour: Column, minute: Column, window: int = 900) -> Column:
    gap = local - scheduled(local, weekday, hour, minute)
    return (gap >= 0) & (gap < window)


def iso_week(local: Column) -> Column:
    day = F.timestamp_seconds(local)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def stamp(seconds: Column) -> Column:
    """mm:ss; minutes may exceed 59."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)


def cumulative_buckets(value: Column, bounds: list[float]) -> list[Column]:
    """Counts of values up to each bound, the total, and the sum, as one pass of aggregates."""
    counts = [F.count_if(value <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return [*counts, F.count(value).alias("le_inf"), F.round(F.sum(value), 4).alias("total")]


def nearest_rank(column: str, *shares: float) -> list[Column]:
    """Quantiles by nearest rank, 0 for no rows."""
    return [F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"), F.lit(0)).alias(f"p{int(p * 100)}") for p in shares]


def provider_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6
