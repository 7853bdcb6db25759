"""Mixing sources to target weights by pivotal dependent rounding.

Each document's copies are a whole part and a fraction. Fractions are made integral in pairs: mass moves from one
document to the other until one of the two is integral, in a direction drawn so that expectations hold, and in amounts
that leave the pair's expected words unchanged. Only documents of similar length are paired. Each chunk of them leaves
one fraction; the residuals of the chunks are combined in further rounds, a reduction tree whose levels shrink by the
chunk size. At its root a source has one residual of each length; these are settled from the longest to the shortest,
drawn while the shorter ones can still make up for it, so the words taken miss the target by a short document's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import numpy as np
import pandas as pd

from .common import WORD, checkpointed, stored, whole_text

#: Fixed values of the contract: weights in order of the sources, repeating, and the most copies of a document.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents that one task rounds together.
CHUNK = 1_024


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size): shares of all words by weight, at most 3 times a source's own.

    Sources are ranked by code point, null last. The excess over a source's limit is shared anew by weight until none is
    above; each round is one aggregation over the sources, and at least one source reaches its limit in it.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = checkpointed(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("double")
    ranked = checkpointed(ranged.join(before, "part").withColumn("weight", weight).select("source", "source_size", "weight"))
    words = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    limit, level = F.col("source_size") * float(MOST), None
    share = lambda: F.col("weight") * F.lit(level)
    while True:
        full = F.lit(False) if level is None else share() >= limit
        taken, weights, n = ranked.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if level is not None and n == known:
            break
        known = n
        if not weights:
            break
        level = (words - (taken or 0.0)) / weights
    return ranked.select("source", "source_size", (F.least(share(), limit) if level is not None else limit).alias("target"))


def _round_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    """One chunk's fractions made integral but for one."""
    rows = rows.sort_values(["size", "draw", "doc_id", "p"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
    p, size = rows["p"].to_numpy().copy(), rows["size"].to_numpy(float)
    key = int(np.bitwise_xor.reduce(rows["draw"].to_numpy().view(np.uint64))) if len(rows) else 0
    random = np.random.default_rng(key).random(len(rows))
    held = -1
    for i in range(len(rows)):
        if held < 0:
            held = i if 0 < p[i] < 1 else -1
            continue
        if not 0 < p[i] < 1:
            continue
        a, b = held, i  # words move between a and b: up(a) or down(a), until one is integral
        up = min((1 - p[a]) * size[a], p[b] * size[b])
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        if random[i] * (up + down) < down:
            full, p[a], p[b] = up == (1 - p[a]) * size[a], p[a] + up / size[a], p[b] - up / size[b]
            p[a], p[b] = (1.0, p[b]) if full else (p[a], 0.0)
        else:
            empty, p[a], p[b] = down == p[a] * size[a], p[a] - down / size[a], p[b] + down / size[b]
            p[a], p[b] = (0.0, p[b]) if empty else (p[a], 1.0)
        p[[a, b]] = np.where(p[[a, b]] < 1e-12, 0.0, np.where(p[[a, b]] > 1 - 1e-12, 1.0, p[[a, b]]))
        held = next((x for x in (a, b) if 0 < p[x] < 1), -1)
    rows["p"] = p
    return rows


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """A source's last residuals, one of each length, made integral from the longest to the shortest."""
    rows = rows.sort_values(["size", "draw", "doc_id", "p"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
    p, size = rows["p"].to_numpy().copy(), rows["size"].to_numpy(float)
    random = np.random.default_rng(int(np.bitwise_xor.reduce(rows["draw"].to_numpy().view(np.uint64)))).random(len(rows))
    words, shorter = float(p @ size), float(size.sum())
    for i in range(len(rows)):
        shorter -= size[i]
        may_take, may_leave = words >= size[i], words <= shorter
        if may_take == may_leave:  # both, or what is nearer
            take = random[i] < p[i] if may_take else size[i] - words < words - shorter
        else:
            take = may_take
        p[i] = float(take)
        words -= size[i] * take
    rows["p"] = p
    return rows


def pivotal_rounding(rows: DataFrame, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Rows (row_id, doc_id, source, size, p) with p in [0, 1] made 0 or 1, keeping each source's expected words.

    Rows that are equal but for row_id are one unit, however many: what they get beyond whole rows is one fraction. Level
    0 rounds chunks of units of one source and one half binary order of size; the next levels round what is left of
    those, until each source has at most one residual of an order, a few dozen, which are settled together.
    """
    open_rows = rows.where("p > 0 and p < 1")
    unit = ["source", "doc_id", "size", "p"]
    units = stored(open_rows.groupBy(*unit).agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")))
    total = F.col("n") * F.col("p")
    split = units.withColumn("whole", F.floor(total + 1e-9)).withColumn("part", F.greatest(total - F.col("whole"), F.lit(0.0)))
    rounded = _round_units(split.select("row_id", "doc_id", "source", "size", F.when(F.col("n") == 1, F.col("p")).otherwise(F.col("part")).alias("p")), seed, chunk)
    done = rows.where("p <= 0 or p >= 1").select("row_id", "p")
    many = units.where("n > 1")
    if many.isEmpty():
        return done.unionByName(rounded)
    extra = split.where("n > 1").join(rounded.select("row_id", F.col("p").alias("one")), "row_id").select(*(F.col(c).alias(f"of_{c}") for c in unit), (F.col("whole") + F.col("one")).alias("extra"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in unit]
    equal = open_rows.join(extra, same).select("row_id", F.shiftright("row_id", 33).alias("part"), *(f"of_{c}" for c in unit), "extra")
    # equal rows are numbered within their input part, and parts by what comes before them: no task meets a whole unit
    keys = [f"of_{c}" for c in unit]
    before = equal.groupBy(*keys, "part").count().withColumn("before", F.sum("count").over(W.partitionBy(*keys).orderBy("part")) - F.col("count"))
    before = before.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col("part").alias("b_part"), "before")
    numbered = equal.withColumn("at", F.row_number().over(W.partitionBy(*keys, "part").orderBy("row_id")))
    met = numbered.join(before, [*(F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys), F.col("part") == F.col("b_part")])
    given = met.select("row_id", (F.col("before") + F.col("at") <= F.col("extra")).cast("double").alias("p"))
    return done.unionByName(rounded.join(many.select("row_id"), "row_id", "left_anti")).unionByName(given)


def _round_units(units: DataFrame, seed: int, chunk: int) -> DataFrame:
    """(row_id, p) of units, of which no two are equal in doc_id, source, size and p, made 0 or 1."""
    schema = "row_id long, doc_id long, source string, size long, p double, draw long, bin int, chunk long"
    own = units.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("bin", F.floor(2 * F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    done, level = own.where("p <= 0 or p >= 1").select("row_id", "p"), 0
    left = own.where("p > 0 and p < 1")
    while True:
        counts = checkpointed(left.groupBy("source", "bin").count()) if level else left.groupBy("source", "bin").count()
        last = level > 0 and (counts.agg(F.max("count")).first()[0] or 1) <= 1
        if last:  # every (source, bin) has one residual: those of all bins meet
            dealt = left.withColumn("bin", F.lit(-1)).withColumn("chunk", F.lit(0).cast("long"))
        else:
            chunks = counts.select(F.col("source").alias("of"), F.col("bin").alias("at"), F.ceil(F.col("count") / chunk).alias("n"))
            number = F.pmod(F.xxhash64("draw", F.lit(level)), F.col("n"))
            dealt = left.join(chunks, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("at"))).withColumn("chunk", number.cast("long"))
        rounded = stored(dealt.select("row_id", "doc_id", "source", "size", "p", "draw", "bin", "chunk").groupBy("source", "bin", "chunk").applyInPandas(_settle if last else _round_chunk, schema))
        done = done.unionByName(rounded.where("p <= 0 or p >= 1").select("row_id", "p"))
        left, level = rounded.where("p > 0 and p < 1").drop("chunk"), level + 1
        if last:
            return done


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns doc_id, source, size (words), source_size, target (the source's), copies (0 to 3), taken (copies x size), a
    row per input row. A null text has size 0 and a null source is a source of its own, ranked last. A document without
    words takes nothing. Of rows that repeat in id, source and size, the number that gets a copy more is rounded, and they
    share it among them; the same input always gives the same mix. An empty table gives an empty result; other columns are ignored.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")).withColumn("row_id", F.monotonically_increasing_id()))
    targets = checkpointed(source_targets(rows)).withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    planned = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("ratio", F.when(F.col("size") > 0, ratio).otherwise(0.0))
    planned = stored(planned.withColumn("whole", F.floor("ratio")).withColumn("p", F.col("ratio") - F.col("whole")))
    rounded = pivotal_rounding(planned.select("row_id", "doc_id", "source", "size", "p"), seed).withColumnRenamed("p", "one_more")
    copies = (F.col("whole") + F.col("one_more")).cast("long")
    return planned.join(rounded, "row_id").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
