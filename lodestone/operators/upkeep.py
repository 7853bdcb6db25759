"""Keeping stored tables true: reminders merged both ways, shared assets split, guests' leavings swept, long transcripts packed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import stored

# -- reminders ---------------------------------------------------------------


def merge_reminders(local: DataFrame, remote: DataFrame, now: int) -> DataFrame:
    """One sync of a device's reminders with the server's, a row an item that has one on either side.

    ``local`` are (item_id, scheduled_s, dirty, delivered, suspended), where dirty says what the server has yet to hear: set,
    remove, delivered or nothing; ``remote`` are (item_id, scheduled_s). Returns item_id, pushed (what goes to the server: set,
    remove, acknowledge or null), outcome (stored, deleted or kept), and the device's row after it: scheduled_s, dirty,
    delivered. First the device's changes go out: a removal, a new time that is still to come, a delivery, which the server
    takes for the time it has and for none other. Then the server's times come in, unless the device has something to say yet.
    A row that neither side changed and the server lacks goes. What is due is then delivered, and the server is to hear
    of it next time; a new time that passed before it was sent removes the server's. Suspended rows are left alone.
    Ids are unique on each side; null flags are false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    mine = local.where("item_id is not null").select("item_id", F.col("scheduled_s").alias("own_s"), F.coalesce("dirty", F.lit("")).alias("was"), flag("delivered").alias("heard"), flag("suspended").alias("asleep"), F.lit(True).alias("here"))
    theirs = remote.where("item_id is not null").select("item_id", F.col("scheduled_s").alias("server_s"))
    both = mine.join(theirs, "item_id", "full_outer").withColumns({"here": flag("here"), "asleep": flag("asleep")})
    open_ = F.col("here") & ~F.col("asleep")
    pushed = F.when(~open_, None).when(F.col("was") == "remove", "remove").when((F.col("was") == "set") & (F.col("own_s") > now), "set").when(F.col("was") == "delivered", "acknowledge")
    sent = both.withColumn("pushed", pushed)
    server = F.when(F.col("pushed") == "remove", None).when(F.col("pushed") == "set", F.col("own_s"))
    taken = (F.col("pushed") == "acknowledge") & (F.col("server_s") == F.col("own_s")) & (F.col("own_s") <= now)
    sent = sent.withColumn("server_s", server.when(F.coalesce(taken, F.lit(False)), None).otherwise(F.col("server_s")))
    quiet = open_ & (F.col("pushed").isNotNull() | (F.col("was") == ""))  # nothing is left to say
    there = F.col("here") & ~F.coalesce(F.col("pushed") == "remove", F.lit(False))
    came = F.col("server_s").isNotNull() & (~there | (quiet & ~F.col("own_s").eqNullSafe(F.col("server_s"))))
    gone = (F.coalesce(F.col("pushed") == "remove", F.lit(False)) | (quiet & F.col("server_s").isNull())) & ~came
    merged = sent.withColumn("outcome", F.when(came, "stored").when(gone, "deleted").otherwise("kept"))
    at = F.when(F.col("outcome") == "stored", F.col("server_s")).otherwise(F.col("own_s"))
    dirty = F.when((F.col("outcome") == "stored") | F.col("pushed").isNotNull(), "").otherwise(F.col("was"))
    heard = F.when(F.col("outcome") == "stored", False).otherwise(F.col("heard"))
    after = merged.select("item_id", "pushed", "outcome", "asleep", at.alias("scheduled_s"), dirty.alias("dirty"), heard.alias("delivered"))
    due = (F.col("outcome") != "deleted") & ~F.col("asleep") & ~F.col("delivered") & (F.col("dirty") != "remove") & (F.col("scheduled_s") <= now)
    due = F.coalesce(due, F.lit(False))
    left = lambda c: F.when(F.col("outcome") != "deleted", c)
    return after.select(
        "item_id",
        "pushed",
        "outcome",
        left(F.col("scheduled_s")).alias("scheduled_s"),
        left(F.when(due, F.when(F.col("dirty") == "set", "remove").otherwise("delivered")).otherwise(F.col("dirty"))).alias("dirty"),
        left(F.col("delivered") | due).alias("delivered"),
    )


# -- private copies ----------------------------------------------------------


def copy_id(why: str, *of: Column) -> Column:
    """An id that a rerun gives again: a hash of what was copied, why and for whom."""
    return F.md5(F.concat_ws("|", F.lit(why), *(c.cast("string") for c in of)))


def split_shared(assets: DataFrame, memories: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, memories, items) after every asset that is not public and that several users remember became a copy each.

    ``assets`` are (id string, visibility, owner, ...), ``memories`` (content_id, user_id, ...), ``items`` (id, content_id, user_id, ...). A
    user's rows move to their own copy, whose parent is the asset; the asset goes. Rows of users that do not remember it stay
    where they are, without an asset, as they had none to see. Run again, it finds nothing shared and changes nothing.
    """
    private = assets.where(~F.coalesce(F.col("visibility") == "PUBLIC", F.lit(False)))
    members = memories.where("content_id is not null and user_id is not null").select("content_id", "user_id").distinct()
    # users are counted before assets are looked at, so the wide rows meet only shared ones
    shared = members.groupBy("content_id").agg(F.count("*").alias("users")).where("users > 1").join(private.select(F.col("id").alias("content_id")), "content_id").select("content_id")
    moves = members.join(shared, "content_id").withColumn("copy", copy_id("split", F.col("content_id"), F.col("user_id")))
    copies = assets.join(moves.withColumnRenamed("content_id", "id"), "id")
    copies = copies.select(*(F.col("copy").alias("id") if c == "id" else F.col("user_id").alias("owner") if c == "owner" else F.col(c) for c in assets.columns), F.col("id").alias("parent"))
    kept = assets.join(shared.withColumnRenamed("content_id", "id"), "id", "left_anti").withColumn("parent", F.lit(None).cast("string"))

    def moved(rows: DataFrame) -> DataFrame:
        met = rows.join(moves, ["content_id", "user_id"], "left")
        return met.select(*(F.coalesce("copy", "content_id").alias(c) if c == "content_id" else F.col(c) for c in rows.columns))

    return kept.select(*assets.columns, "parent").unionByName(copies), moved(memories), moved(items)


def detach(items: DataFrame, memories: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, memories, new assets) after the saves in ``asked`` (id) each got a private content of their own.

    The user's memory is copied to it; the old one goes once no other save of the user has the old content. New assets are
    (id, owner, item_id, parent). Repeated and unknown ids change nothing more; a save without content gets one, and no memory of it.
    """
    wanted = items.join(asked.select("id").distinct(), "id", "left_semi").select("id", "user_id", F.col("content_id").alias("parent"))
    wanted = stored(wanted.withColumn("copy", copy_id("detach", F.col("id"), F.col("parent"))))
    after = items.join(wanted.select("id", "copy"), "id", "left")
    after = after.select(*(F.coalesce("copy", "content_id").alias(c) if c == "content_id" else F.col(c) for c in items.columns))
    own = memories.join(wanted.select("copy", "user_id", F.col("parent").alias("content_id")), ["content_id", "user_id"])
    copied = own.select(*(F.col("copy").alias(c) if c == "content_id" else F.col(c) for c in memories.columns))
    left = wanted.select(F.col("parent").alias("content_id"), "user_id").distinct().join(after.select("content_id", "user_id").distinct(), ["content_id", "user_id"], "left_anti")
    kept = memories.join(left, ["content_id", "user_id"], "left_anti")
    return after, kept.select(*memories.columns).unionByName(copied), wanted.select(F.col("copy").alias("id"), F.col("user_id").alias("owner"), F.col("id").alias("item_id"), "parent")


# -- guests ------------------------------------------------------------------


def sweep_guests(users: DataFrame, items: DataFrame, memories: DataFrame, assets: DataFrame, jobs: DataFrame, chunks: DataFrame, now: int, hours: int = 24) -> DataFrame:
    """(kind, id): what of guests' things expires: item, memory (user:content), asset and chunk (item:chunk_idx) rows.

    ``users`` are (user_id, subject), guests those whose subject begins with ``guest:``; ``items`` (id, user_id, content_id, created_s,
    deleted_s), ``memories`` (user_id, content_id), ``assets`` (id, owner, visibility, created_s), ``jobs`` (content_id, status, locked_s), ``chunks`` (item_id,
    chunk_idx). A guest's save goes when it is older than ``hours``, was not deleted by hand, and no worker is on its content. A
    memory goes with its user's last save of the content. An asset goes if it is the guest's own, not public, has no save
    and no memory left and no worker, and either lost a save now or is itself older. What anyone else holds stays.
    """
    limit = now - hours * 3_600
    guests = users.where(F.col("subject").startswith("guest:")).select("user_id").distinct()
    busy = jobs.where((F.col("status") == "PROCESSING") | F.col("locked_s").isNotNull()).select("content_id").distinct()
    old = items.where((F.col("created_s") < limit) & F.col("deleted_s").isNull()).join(guests, "user_id", "left_semi")
    # what has content waits for its worker; a null content has none, and never matches
    gone = stored(old.join(busy, "content_id", "left_anti").select("id", "user_id", "content_id"))
    left = stored(items.join(gone.select("id"), "id", "left_anti").select("user_id", "content_id").where("content_id is not null").distinct())
    touched = gone.where("content_id is not null").select("user_id", "content_id").distinct()
    forgotten = stored(memories.select("user_id", "content_id").distinct().join(touched, ["user_id", "content_id"], "left_semi").join(left, ["user_id", "content_id"], "left_anti"))
    remembered = memories.select("user_id", "content_id").distinct().join(forgotten, ["user_id", "content_id"], "left_anti")
    held = left.select("content_id").unionByName(remembered.select("content_id")).unionByName(busy).distinct()
    own = assets.where(~F.coalesce(F.col("visibility") == "PUBLIC", F.lit(False))).join(guests.withColumnRenamed("user_id", "owner"), "owner", "left_semi")
    free = own.join(held.withColumnRenamed("content_id", "id"), "id", "left_anti")
    just_left = touched.select(F.col("content_id").alias("id"), F.col("user_id").alias("owner"), F.lit(True).alias("touched"))
    swept = free.join(just_left, ["id", "owner"], "left").where(F.col("touched") | (F.col("created_s") < limit)).select("id").distinct()
    pair = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    kinds = {
        "item": gone.select(F.col("id").cast("string").alias("id")),
        "memory": forgotten.select(pair("user_id", "content_id").alias("id")),
        "asset": swept.select(F.col("id").cast("string").alias("id")),
        "chunk": chunks.join(gone.select(F.col("id").alias("item_id")), "item_id", "left_semi").select(pair("item_id", "chunk_idx").alias("id")),
    }
    out = None
    for kind, rows in kinds.items():
        rows = rows.select(F.lit(kind).alias("kind"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


# -- transcripts -------------------------------------------------------------

#: Characters of a group of segments, and what a segment and a group add to those of its text.
GROUP_CHARS, BETWEEN, BRACKETS, MARGIN = 12_000, 2, 2, 128


def pack_segments(segments: DataFrame, key: str, order: str, text: str, size: Column, cap: int = GROUP_CHARS) -> DataFrame:
    """``segments`` with group and piece: in order, as many to a group as fit ``cap`` characters, the oversized split.

    ``size`` is the length of a segment as it is sent. One that would not fit a group of its own is cut into pieces of less than
    half a group, which keep its other columns, times included. The rows of a key pass through one task in order, which holds a sum
    and a number, so a transcript may be of any length. Groups and pieces count from 0; a null or empty text is one piece.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    width = max(1, cap // 2 - MARGIN)
    count = F.when(size + BETWEEN + BRACKETS <= cap, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.char_length(body) / width)))
    numbered = segments.withColumn("__chars", F.char_length(body)).withColumn("__size", size).withColumn("__pieces", count.cast("int"))
    pieces = numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)).alias("piece"))
    part = F.when(F.col("__pieces") > 1, F.substring(body, F.col("piece") * width + 1, F.lit(width))).otherwise(F.col(text))
    cut = pieces.withColumns({text: part, "__size": F.col("__size") - F.col("__chars") + F.char_length(F.coalesce(part, F.lit("")))})
    names = [c for c in segments.columns if c != text] + [text]
    rows = cut.select(F.col(key).cast("string").alias("__key"), F.col("__size").cast("long").alias("__size"), "piece", *names).repartition("__key").sortWithinPartitions("__key", order, "piece")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, filled, started = None, 0, BRACKETS, False
        for batch in batches:
            groups = []
            for own, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not started or own != held:
                    held, group, filled, started, empty = own, 0, BRACKETS, True, True
                if not empty and filled + length > cap:
                    group, filled = group + 1, BRACKETS
                empty = False
                filled += length + BETWEEN
                groups.append(group)
            columns = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(groups, pa.int32())], [*batch.schema.names[2:], "group"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(pack, "piece int, " + ", ".join(f"`{c}` {types[c]}" for c in names) + ", group int")


# -- waiting and running -----------------------------------------------------


def durations(jobs: DataFrame) -> DataFrame:
    """``jobs`` (created_s, claimed_s, updated_s, ...) with wait_s and run_s, never below 0 and null where an end is missing."""
    clamp = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(F.lit(0), F.col(b) - F.col(a)))
    return jobs.withColumn("wait_s", clamp("created_s", "claimed_s")).withColumn("run_s", clamp("claimed_s", "updated_s"))


def slice_sketches(values: DataFrame, at: str, value: str, seconds: int) -> DataFrame:
    """(slice_s, n, sketch): a mergeable KLL sketch of the values of each slice of time; nulls are left out."""
    start = F.floor(F.col(at) / seconds) * seconds
    kept = values.where(F.col(value).isNotNull() & F.col(at).isNotNull())
    return kept.groupBy(start.alias("slice_s")).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("long")).alias("sketch"))


def merged_quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """(n, p50, ...) over the sketches of any slices, without their values; a rank is off by 1.7 % of n at most, with 99 % confidence."""
    merged = sketches.agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select("n", *(F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(f"p{round(p * 100)}") for p in shares))
