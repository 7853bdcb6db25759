"""Filter interaction audit by inclusion-exclusion.

Each document has a flag for each filter that it fails. One aggregation per part sums the product of the flags of every
subset of the filters: how many documents fail all of it together. Everything else follows from these 32 counts, whatever
the order of the filters, without another pass over the documents: survivors and unique failures by Möbius inversion, and
each filter's Shapley value from the Harsanyi dividends of the game whose worth is the number of removed documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, stored, whole_text

#: The filters of the audit, in the order of their bits.
FILTERS = "ABCDE"
#: What is counted for every subset: all documents, those of quality, those that are toxic.
KINDS = ("all", "good", "toxic")


# -- the five filters --------------------------------------------------------


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E): what each document of ``docs`` (doc_id, text, lang) fails, 1 or 0, a row a row.

    A: under 200 words; B: under half of its words are distinct; C: over 3 % of its characters are ``[A-Z]``; D: holds any of
    ``#$%&*|``; E: some smaller doc_id has the same text. A null text is empty, and so is a null lang. A row without an id
    never fails E and makes no other fail it; rows that share id and text do not make each other fail. Texts are compared by
    SHA-256. The texts are read once, into a narrow stored table; the smallest id of each text is then an
    aggregation that combines on the map side, and rows meet it by id and text, so no group of copies meets in one task.
    """
    text = whole_text()
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    flag = lambda c: c.cast("int")
    narrow = stored(
        rows.select(
            "doc_id",
            "part",
            F.unhex(F.sha2("text", 256)).alias("same"),
            flag(n < 200).alias("A"),
            flag(100 * distinct < 50 * n).alias("B"),
            flag(100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.char_length("text")).alias("C"),
            flag(F.col("text").rlike("[#$%&*|]")).alias("D"),
        )
    )
    firsts = narrow.groupBy(F.col("same").alias("text_of")).agg(F.min("doc_id").alias("first")).where("first is not null")
    known = narrow.where("doc_id is not null").join(firsts, (F.col("doc_id") == F.col("first")) & (F.col("same") == F.col("text_of")), "left").drop("text_of")
    without = narrow.where("doc_id is null").withColumn("first", F.lit(None).cast("long"))
    every = known.unionByName(without).drop("same")
    return every.withColumn("E", flag(F.col("doc_id").isNotNull() & F.col("first").isNull())).drop("first")


def label_flags(labels: DataFrame) -> DataFrame:
    """(labelled, good, toxic): a row for each labelled id; it is good if any of its rows has quality 1, toxic likewise."""
    any_of = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))


# -- counts of intersections, and what follows from them ----------------------


def joint_failures(flags: DataFrame, filters: str = FILTERS, kinds: dict[str, str | None] | None = None) -> DataFrame:
    """A row a part with an array a kind: at a subset's bits, how many documents fail all of its filters.

    ``flags`` has a 0/1 column for each filter, ``part``, and one for each kind's column (None: every document counts).
    """
    kinds = kinds or {"all": None}
    sums = []
    for kind, column in kinds.items():
        products = []
        for subset in range(1 << len(filters)):
            product = F.col(column) if column else F.lit(1)
            for bit, name in enumerate(filters):
                if subset >> bit & 1:
                    product = product * F.col(name)
            products.append(F.sum(product.cast("long")))
        sums.append(F.array(*products).alias(kind))
    return flags.groupBy("part").agg(*sums)


def _alternating(counts: Column, within: Column, times: Column, filters: str) -> Column:
    """Sum over the subsets S of ``within`` of (-1)^|S| counts[S + times]: documents that fail all of ``times``, none of ``within``."""
    subsets = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    term = lambda s: F.when(F.bit_count(s) % 2 == 0, F.get(counts, s.bitwiseOR(times))).otherwise(-F.get(counts, s.bitwiseOR(times)))
    return F.aggregate(subsets, F.lit(0).cast("long"), lambda total, s: total + F.when(s.bitwiseAND(within) == s, term(s)).otherwise(F.lit(0).cast("long")))


def _shapley(counts: Column, own: Column, filters: str) -> Column:
    """The filter's Shapley value times the number of orders.

    The Harsanyi dividend of a set of filters in the game of removed documents is its joint failures, negative for an
    even number of filters; each filter of the set has an equal share of it.
    """
    n = len(filters)
    scale, orders = lcm(*range(1, n + 1)), factorial(n)
    subsets = F.sequence(F.lit(1), F.lit((1 << n) - 1))
    share = lambda s: F.get(counts, s) * F.get(F.array(*(F.lit(0 if not k else scale // k).cast("long") for k in range(n + 1))), F.bit_count(s))
    signed = lambda s: F.when(F.bit_count(s) % 2 == 1, share(s)).otherwise(-share(s))
    total = F.aggregate(subsets, F.lit(0).cast("long"), lambda t, s: t + F.when(s.bitwiseAND(own) == own, signed(s)).otherwise(F.lit(0).cast("long")))
    return total * F.lit(orders // scale).cast("long")  # n! is a multiple of every number up to n


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every filter does at every step of every order, from the counts of ``joint_failures`` (all, good, toxic).

    Returns part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each
    part, all orders of the filters and one row a step.
    """
    n = len(filters)
    orders = F.lit(["".join(p) for p in permutations(filters)])
    rows = counts.select("part", *KINDS, F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    rows = rows.withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    bits = lambda text: sum((F.when(F.instr(text, name) > 0, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, name in enumerate(filters)), F.lit(0))
    rows = rows.withColumn("before", bits(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1))).withColumn("own", bits(F.col("filter")))
    none = F.lit(0)
    others = F.lit((1 << n) - 1).bitwiseXOR(F.col("own"))
    here = {kind: _alternating(F.col(kind), F.col("before"), F.col("own"), filters) for kind in KINDS}
    return rows.select(
        "part",
        "filter_order",
        "step",
        "filter",
        _alternating(F.col("all"), F.col("before").bitwiseOR(F.col("own")), none, filters).alias("kept"),
        here["all"].alias("removed"),
        (F.get("all", F.col("own")) - here["all"]).alias("redundant"),
        _alternating(F.col("all"), others, F.col("own"), filters).alias("unique_fails"),
        here["good"].alias("good_lost"),
        here["toxic"].alias("toxic_lost"),
        _shapley(F.col("all"), F.col("own"), filters).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs`` by lang, with what of good and toxic documents they lose.

    A row per part, order and step, as ``audit`` gives them; an empty table gives none. Labels may repeat or be null: see
    ``label_flags``; a document without an id has no label. Other columns are ignored, whatever their names.
    """
    flags = failures(docs)
    known = flags.where("doc_id is not null").join(label_flags(labels), F.col("doc_id") == F.col("labelled"), "left").drop("labelled")
    without = flags.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    rows = known.unionByName(without).withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    return audit(stored(joint_failures(rows, kinds={"all": None, "good": "good", "toxic": "toxic"})))
