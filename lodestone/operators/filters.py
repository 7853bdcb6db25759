"""Predicates over a library of saves. All are null-safe columns; none needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEK = 7 * 86_400


def searchable() -> Column:
    """Finished, not deleted, and not a degraded brief unless only the link is kept."""
    return (F.col("status") == "ready") & F.col("deleted_s").isNull() & (F.col("link_only") | (F.coalesce("brief_source", F.lit("")) != "fallback"))


def display_title() -> Column:
    return F.coalesce("edited_title", "title")


def display_summary() -> Column:
    return F.coalesce("edited_summary", F.when(~F.col("link_only"), F.col("summary")))


def has_topic(topic: str) -> Column:
    return F.exists("topics", lambda x: F.lower(x) == topic.strip().lower())


def has_entity(entity: str) -> Column:
    """A whole-word, case-insensitive match in tools or people; the value is data, never a pattern."""
    quoted = "".join(c if c.isalnum() or c.isspace() else f"\\{c}" for c in entity.strip().lower())
    return F.exists(F.concat("tools", "people"), lambda x: F.lower(x).rlike(rf"(?U)(^|[^\p{{Alnum}}_]){quoted}($|[^\p{{Alnum}}_])"))


def saved_on(day_start: int) -> Column:
    """The UTC half-open day that starts at day_start."""
    return (F.col("created_s") >= day_start) & (F.col("created_s") < day_start + 86_400)


def before_cursor(created: int, item_id: int) -> Column:
    """Rows after the cursor in descending (created, id) order."""
    return (F.col("created_s") < created) | ((F.col("created_s") == created) & (F.col("id") < item_id))


def forgotten(now: int) -> Column:
    """Saved over seven days ago, never opened, not deleted; exactly seven days is not yet over."""
    return (F.col("created_s") < now - WEEK) & F.col("opened_s").isNull() & F.col("deleted_s").isNull()


def allow_list(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the listed ids; an empty list allows nothing. Spark broadcasts the list if it is small."""
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def read_facets(values: dict) -> dict:
    """Checks facet filters: known keys, non-blank strings of at most 512 characters, a date for ``saved``."""
    from datetime import date

    known = {"topic", "type", "entity", "intent", "action", "source", "saved"}
    if set(values) - known or any(not isinstance(v, str) or not v.strip() or len(v) > 512 for v in values.values()):
        raise ValueError("invalid facet filters")
    if "saved" in values:
        date.fromisoformat(values["saved"])
    return values


#: What a failure's reason says, and what the user is told then.
ACCESS_WORDS, ACCESS = ("paywall", "403", "401", "sign-in", "login"), "This page requires access or sign-in."
OUTAGE_WORDS, OUTAGE = ("timeout", "temporarily unavailable", "connection"), "This page was temporarily unavailable. Try again."
UNREADABLE = "This page could not be read. Try again or keep the link."


def failure_message(status: Column, needs_retry: Column, reason: Column) -> Column:
    """What the user is told about a save that failed or is to be retried; null for any other. A null reason says nothing."""
    said = F.lower(F.coalesce(reason, F.lit("")))
    failed = F.coalesce((status == "failed") | needs_retry, F.lit(False))
    return F.when(failed, F.when(said.rlike("|".join(ACCESS_WORDS)), ACCESS).when(said.rlike("|".join(OUTAGE_WORDS)), OUTAGE).otherwise(UNREADABLE))
