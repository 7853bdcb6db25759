"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused, whole_text

#: A line is boilerplate if more than this share of its host's pages contain it ...
RATIO = 0.1
#: ... and so many of them at least.
MIN_PAGES = 5
#: Boilerplate lines of all hosts that are broadcast at most (16 bytes and the host's name each).
BROADCAST_LINES = 200_000


def _column(host: str | Column) -> Column:
    return F.col(host) if isinstance(host, str) else host


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate_lines(docs: DataFrame, host: str | Column = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, n_pages, host_pages): the keys (96-bit hashes) of the lines that exceed the ratio on their host.

    Pages with equal texts count once, above and below the line: a mirrored page says nothing about the template. Lines
    are compared without spaces at either end; empty ones have no key. A null host is a host of its own.
    """
    pages = docs.select(_column(host).alias("host"), F.struct(F.xxhash64(whole_text()).alias("a"), F.hash(whole_text()).alias("b")).alias("page"), whole_text().alias("text"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    counts = lines.select("host", "page", _line_key(F.col("line")).alias("line")).groupBy("host", "line").agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = pages.groupBy(F.col("host").alias("of")).agg(F.countDistinct("page").alias("host_pages"))
    return counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_pages") > ratio * F.col("host_pages")).drop("of")


def drop_boilerplate_lines(
    docs: DataFrame, host: str | Column = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = ("__n_lines", "__n_dropped")
) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``; all columns stay, and n_chars follows the text if present.

    ``host`` is a column or an expression over columns. Adds the lines of the text and those dropped under the names
    ``counts``, in place of columns that are called so; None adds nothing. A null text is treated as empty (one empty
    line) and stays null. A host's lines that exceed the ratio are at most its mean lines a page divided by the ratio, so
    each row meets a bounded list. Empty lines are never dropped; repeated rows are treated alike; an empty table stays empty.
    """
    site, of, known, every, kept, dropped = unused(docs, "__site", "__of", "__known", "__lines", "__kept", "__dropped")
    lines = stored(boilerplate_lines(docs, host, ratio, min_pages).select("host", "line"))
    lists = lines.groupBy(F.col("host").alias(of)).agg(F.collect_set("line").alias(known))
    if lines.count() <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    rows = docs.withColumn(site, _column(host)).join(lists, F.col(site).eqNullSafe(F.col(of)), "left").withColumn(every, F.split(whole_text(), "\n"))
    stays = F.filter(every, lambda x: ~F.array_contains(F.col(known), _line_key(F.trim(x))) | (F.trim(x) == ""))
    rows = rows.withColumn(kept, F.when(F.col(known).isNull(), F.col(every)).otherwise(stays)).withColumn(dropped, (F.size(every) - F.size(kept)).cast("long"))
    rows = rows.withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(dropped) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    if counts:
        rows = rows.withColumns({counts[0]: F.size(every).cast("long"), counts[1]: F.col(dropped)})
    return rows.drop(site, of, known, every, kept, dropped)
