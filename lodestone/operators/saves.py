"""What users ask of their saves, decided for a whole batch: shares taken, edits, new summaries and retries, and results reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.upkeep import copy_id

#: Shares that a user takes in a day, and new summaries that a save gets in one.
DAY, SHARES_A_DAY, SUMMARIES_A_DAY = 86_400, 100, 3


def redeem(shares: DataFrame, taken: DataFrame, items: DataFrame, asks: DataFrame, now: int, most: int = SHARES_A_DAY) -> DataFrame:
    """(ask_id, outcome, item_id) of a batch of asks (ask_id, user_id, token_hash) to take shares, in the order of their ids.

    ``shares`` are (token_hash, url, expires_s, revoked), ``taken`` earlier redemptions (user_id, token_hash, item_id, at_s), ``items`` (id
    string, user_id, url, deleted_s). gone: no such share, or it is revoked or has expired. again: the user took it and still has
    the save. existing: they have a save of its url, or an earlier ask of the batch made one. limit: they took ``most`` within a day.
    restored: their deleted save of the url comes back with the share's content. created: a new save, whose id is the same if the
    batch is run again. A second redemption of a share does not count towards the limit. Keys of the tables are unique.
    """
    live = shares.where(~F.coalesce("revoked", F.lit(False)) & (F.col("expires_s") > now)).select("token_hash", "url")
    asked = asks.select("user_id", "token_hash", F.lit(True).alias("asks"), "ask_id")
    took = taken.select("user_id", "token_hash", F.lit(True).alias("took"), F.col("item_id").alias("took_id"), F.col("at_s").alias("took_s"))
    of_shares = asked.unionByName(took, True).join(live, "token_hash", "left").withColumn("live", F.col("url").isNotNull())
    own = items.select("user_id", "url", F.col("id").alias("own_id"), "deleted_s")
    return settle(of_shares.unionByName(own, True), now, most)


def settle(facts: DataFrame, now: int, most: int = SHARES_A_DAY, token: Column | None = None) -> DataFrame:
    """What ``redeem`` returns, from one table of asks, redemptions and saves, which is dealt by user once and sorted there.

    ``facts`` are (user_id, token_hash, url, live, asks, ask_id, took, took_id, took_s, own_id, deleted_s), null where a row says nothing: a row may be an
    ask (``asks``), and besides it a redemption (``took``) or a save (``own_id``), not both. ``url`` is the share's or the save's, ``live`` whether
    the share can be taken. Redemptions of a share by a user count as one, with the smallest id and the earliest time, and so do a
    user's saves of a url, of which one with ``deleted_s`` deletes them all. Keys may be of any type; ``token`` is how a share is named in new ids.
    """
    of_user, of_url = W.partitionBy("user_id"), W.partitionBy("user_id", "url")
    took, is_save = F.coalesce("took", F.lit(False)), F.col("own_id").isNotNull()
    rows = facts.repartition("user_id").withColumns({"own": F.min("own_id").over(of_url), "gone_s": F.min("deleted_s").over(of_url)})
    # a save of no url is one by itself
    stands = F.when(F.col("url").isNull(), F.col("deleted_s").isNull()).otherwise((F.col("own_id") == F.col("own")) & F.col("gone_s").isNull())
    rows = rows.withColumn("stands", is_save & stands).withColumn("known_id", F.coalesce("took_id", "own_id"))
    rows = rows.withColumn("has", F.max("stands").over(W.partitionBy("user_id", "known_id")))
    of_share = W.partitionBy("user_id", "url", "token_hash")
    first = F.min(F.when(took, F.struct("took_id", "has"))).over(of_share)
    rows = rows.withColumns({"first": first, "first_s": F.min(F.when(took, F.col("took_s"))).over(of_share)})
    old, kept = F.col("first.took_id"), F.col("own").isNotNull() & F.col("gone_s").isNull()
    fixed = F.when(F.col("url").isNull() | ~F.coalesce("live", F.lit(False)), "gone").when(old.isNotNull() & F.col("first.has"), "again").when(kept, "existing")
    one = took & F.col("took_id").eqNullSafe(old)  # the row that counts among a user's redemptions of a share
    rows = rows.select("user_id", "url", "token_hash", "asks", "ask_id", "own", old.alias("old"), F.col("first").isNotNull().alias("taken"), fixed.alias("fixed"), (one & (F.col("first_s") > now - DAY)).alias("late"))
    open_ = F.col("asks") & F.col("fixed").isNull()
    rows = rows.withColumn("maker", F.min(F.when(open_, F.col("ask_id"))).over(of_url))
    makes = open_ & (F.col("ask_id") == F.col("maker"))
    earlier = F.sum((makes & ~F.col("taken")).cast("int")).over(of_user.orderBy("ask_id").rowsBetween(W.unboundedPreceding, -1))
    lately = F.sum(F.col("late").cast("int")).over(of_user)
    rows = rows.withColumn("over", F.coalesce(lately, F.lit(0)) + F.coalesce(earlier, F.lit(0)) >= most)
    of_maker = lambda c: F.max(F.when(makes, F.col(c))).over(of_url)
    rows = rows.withColumns({"limited": of_maker("over"), "token_hash": of_maker("token_hash")}).where("asks")
    did = F.when(F.col("limited"), "limit").when(F.col("ask_id") != F.col("maker"), "existing").when(F.col("own").isNotNull(), "restored").otherwise("created")
    made = F.coalesce(F.col("own").cast("string"), copy_id("share", F.col("user_id"), F.col("token_hash") if token is None else token))
    item = F.when(F.col("fixed") == "again", F.col("old").cast("string")).when(F.col("fixed") == "existing", F.col("own").cast("string")).when(F.col("fixed").isNull() & ~F.col("limited"), made)
    return rows.select("ask_id", F.coalesce("fixed", did).alias("outcome"), item.alias("item_id"))


def decide(items: DataFrame, jobs: DataFrame, asks: DataFrame, today: int, most: int = SUMMARIES_A_DAY) -> DataFrame:
    """(id, outcome) and the save's columns after a batch of asks, a row an ask.

    ``items`` are (id, user_id, status, needs_retry, link_only, edited_title, edited_summary, under_way, made_on, made), ``jobs`` (id, held) with the saves
    that a worker holds, ``asks`` (id, user_id, kind, replace_edits, sets, title, summary), one a save. edit: the fields named in ``sets``
    are overlaid, null ones cleared, and nothing else changes. regenerate: confirm if the save was edited and the edits are not to be
    replaced, unchanged if it is under way, busy while it is read, quota after ``most`` on one day, else queued: what stands is kept until the new
    summary is there. retry: edited, link, unchanged while it waits, refused if nothing failed, busy, else queued and pending.
    not_found: no such save, or another's. An unknown kind is refused.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    held = jobs.where("held").select("id", F.lit(True).alias("held")).distinct()
    own = items.withColumn("there", F.lit(True))
    rows = asks.join(own, ["id", "user_id"], "left").join(held, "id", "left")
    edited, waits = F.col("edited_title").isNotNull() | F.col("edited_summary").isNotNull(), F.col("status").isin("pending", "processing")
    count = F.when(F.col("made_on") == today, F.coalesce("made", F.lit(0))).otherwise(F.lit(0))
    again = F.when(edited & ~flag("replace_edits"), "confirm").when(flag("under_way"), "unchanged").when(waits | flag("held"), "busy").when(count >= most, "quota").otherwise("queued")
    retry = F.when(edited, "edited").when(flag("link_only"), "link").when(waits, "unchanged").when((F.col("status") != "failed") & ~flag("needs_retry"), "refused").when(flag("held"), "busy").otherwise("queued")
    kind = F.col("kind")
    outcome = F.when(F.col("there").isNull(), "not_found").when(kind == "edit", "edited_now").when(kind == "regenerate", again).when(kind == "retry", retry).otherwise("refused")
    done = rows.withColumn("outcome", outcome).withColumn("count", count)
    queued = F.col("outcome") == "queued"
    fresh, tried = queued & (kind == "regenerate"), queued & (kind == "retry")
    overlay = lambda old, name: F.when((F.col("outcome") == "edited_now") & F.coalesce(F.array_contains("sets", F.lit(name)), F.lit(False)), F.col(name)).otherwise(F.col(old))
    return done.select(
        "id",
        "outcome",
        F.when(tried, "pending").when(fresh, "ready").otherwise(F.col("status")).alias("status"),
        F.when(queued, False).otherwise(F.col("needs_retry")).alias("needs_retry"),
        F.when(fresh, False).otherwise(F.col("link_only")).alias("link_only"),
        overlay("edited_title", "title").alias("edited_title"),
        overlay("edited_summary", "summary").alias("edited_summary"),
        F.when(fresh, True).otherwise(F.col("under_way")).alias("under_way"),
        F.when(fresh, F.lit(today)).otherwise(F.col("made_on")).alias("made_on"),
        F.when(fresh, F.col("count") + 1).otherwise(F.col("made")).alias("made"),
    )


def reuse_sources(items: DataFrame, assets: DataFrame, jobs: DataFrame, chunks: DataFrame, model: str | None, prompt: str) -> DataFrame:
    """(id, source): for each save about to be processed, the finished save of the same content whose results it may take.

    ``items`` are (id, user_id, content_id, created_s, status, needs_retry, link_only, edited, under_way, embedding_model, brief_source, prompt_version,
    evidence_level, is_video), ``assets`` (id, owner, status, version), ``jobs`` (item_id, job_type), ``chunks`` (item_id). The content's asset is the user's own, ready, and made by the same
    job. The source is the earliest other save of it that is ready with results of this embedding model and prompt, neither a fallback
    nor to be retried, and has chunks; if it is that one which a doubt falls on, none is taken, as a later one would be no better known. A video takes nothing from a source with less than its full transcript. Without a model nothing is
    reused. Null flags are false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    if not model:
        return items.select("id", F.col("id").alias("source")).where("false")
    asking = items.where(~flag("edited") & ~flag("under_way") & F.col("content_id").isNotNull()).select("id", "user_id", "content_id", "is_video").join(jobs.select(F.col("item_id").alias("id"), "job_type"), "id")
    ready = assets.where("status = 'READY'").select(F.col("id").alias("content_id"), F.col("owner").alias("user_id"), F.col("version").alias("job_type"))
    asking = asking.join(ready, ["content_id", "user_id", "job_type"])
    made = items.where((F.col("status") == "ready") & ~flag("link_only") & (F.col("embedding_model") == model) & F.col("content_id").isNotNull())
    # of each content the two earliest are enough: one of them may be the save that asks
    two = made.withColumn("place", F.row_number().over(W.partitionBy("content_id").orderBy("created_s", "id"))).where("place <= 2")
    sources = two.select("content_id", "place", F.col("id").alias("source"), "needs_retry", "brief_source", "prompt_version", "evidence_level")
    met = asking.join(sources, "content_id").where("source <> id")
    chosen = met.groupBy("id", "is_video").agg(F.min_by(F.struct("source", "needs_retry", "brief_source", "prompt_version", "evidence_level"), "place").alias("s")).select("id", "is_video", "s.*")
    whole = F.coalesce(F.col("evidence_level") == "full_transcript", F.lit(True))  # one without evidence is no video's
    sure = chosen.where(~flag("needs_retry") & F.col("brief_source").isNotNull() & (F.col("brief_source") != "fallback") & (F.col("prompt_version") == prompt) & (~flag("is_video") | whole))
    return sure.join(chunks.select(F.col("item_id").alias("source")).distinct(), "source", "left_semi").select("id", "source")
