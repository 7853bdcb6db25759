"""Quality classifier: an interpolated modified Kneser-Ney word n-gram model of trusted text.

Training counts n-grams in Spark, sharded by key, and joins each order's counts with its contexts' and with the next
lower order's probabilities, from which come discounted probabilities and back-off weights (Chen and Goodman, 1999).
It is fitted on every trusted document but the held-out half. Scoring joins the n-grams of every document of the corpus with the sharded
weights. Both go through the model in parts, so it is never there as a whole. A document's log-perplexity, drawn towards its language's mean by a few pseudo-words so that very short texts
aren't judged by one rare word, is compared with a quantile of its language's held-out trusted documents.

Insults and marks strewn over fluent text hardly change its perplexity. They are learned from the labels: words that are
many times as frequent among documents labelled toxic or of no quality as among trusted ones, by documents. A
document's sum of their log odds is compared with a quantile of its language's held-out trusted documents as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, discard, stored, unused, utf8, whole_text
from .words import mixed, span_hashes

ORDER = 3
#: Bounds of ``trusted_sample``, which no query uses: documents of a language and of all, words of a language and of all,
#: and the longest document.
SAMPLE, SAMPLE_ALL = 600, 6_000
SAMPLE_WORDS, SAMPLE_ALL_WORDS, LONGEST = 600_000, 4_000_000, 20_000
#: A document is kept up to this quantile of its language's held-out trusted documents, plus a margin in nats a word.
QUANTILE, MARGIN = 0.99, 0.25
#: Pseudo-words of the language's mean that every document gets.
SHRINK = 20
#: Held-out documents at which a language's own quantile weighs as much as that of all languages together.
HALF_WEIGHT = 20
#: A word speaks against a document if it occurs in so many of the refused documents fitted on, and is so many times as
#: frequent among them as among trusted ones. Log odds are counted in hundredths.
LEAST_REFUSED, ODDS = 5, 10
#: A run of letters or of marks.
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
#: Log-perplexities are counted in steps of one thousandth, so quantiles are exact to that and do not depend on order.
STEP = 0.001

#: Words that speak against documents and go to every task; if there are more, the others are joined.
AGAINST = 1 << 17
#: Most frequent n-grams of a part of the model whose weights are broadcast (12 bytes each).
HOT = 1 << 19
#: How often an n-gram was seen is told apart up to so many times, and rows that Python hands on at once.
MOST_SEEN, ROWS = 10_000, 10_000
#: Bits of a key (11 at least) that the bitmap of the model's other n-grams tells apart; it has 2^26 bits, 8 MB, for any model.
FILTER_BITS = 26
#: Parts, by the word before the last, in which n-grams are counted, weighted and met by those of the corpus, one after another: one for
#: so many bytes of the texts fitted on, and at most PARTS.
PART_BYTES, PARTS = 16 << 20, 8
#: Bytes of texts that are hashed together, and of the pieces of a longer one; texts that are hashed together at most.
GROUP_BYTES, PIECE, GROUP_TEXTS = 1 << 19, 1 << 20, 1 << 16
#: Shards of a part of the model, by key, one of which is in a task's memory at a time: so many, or one for so many trigrams of the texts fitted on.
SHARDS, SHARD_TRIGRAMS = 128, 1 << 19
#: Bytes of sums that a task holds before it hands them on.
SUMS_BYTES = 32 << 20

#: Ids of documents that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000

_BLANK = re.compile(rb"[ \t\n\v\f\r]")


def _trusted(labels: DataFrame) -> DataFrame:
    """(__id, __fit) of the documents labelled of quality and not toxic. One in two is fitted on; the others set the thresholds."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    return trusted.withColumn("__fit", _fitted_on())


def _fitted_on() -> Column:
    return F.pmod(F.xxhash64("__id", F.lit("fit")), F.lit(2)) == 0


def trusted_documents(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to fit on, ids of all trusted documents with __fit): the whole of the half that is not held out, texts of any length."""
    trusted = checkpointed(_trusted(labels))
    return _texts_of(docs, trusted.where("__fit").select("__id")), trusted


def trusted_sample(docs: DataFrame, labels: DataFrame, per_lang: int = SAMPLE, most: int = SAMPLE_ALL) -> tuple[DataFrame, DataFrame]:
    """``trusted_documents`` within bounds, for trials; the queries fit on all."""
    trusted = _trusted(labels).select("__id")
    langs = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("lang").alias("__lang")).join(trusted, "__id").dropDuplicates(["__id"])
    draw = F.xxhash64("__id", F.lit("fit"))
    # one document in two at most is fitted on, so that every language keeps some for its threshold
    ranked = langs.where(F.pmod(draw, F.lit(2)) == 0).withColumn("__rank", F.row_number().over(W.partitionBy("__lang").orderBy(draw, "__id"))).where(F.col("__rank") <= per_lang)
    drawn = checkpointed(ranked.orderBy("__rank", draw, "__id").limit(most))
    lengths = _texts_of(docs, drawn.select("__id")).select("__id", F.size(_words_of(whole_text())).alias("__n")).join(drawn, "__id").where(F.col("__n") <= LONGEST)
    # both windows run over drawn documents alone, at most `most` rows
    of_lang = F.sum("__n").over(W.partitionBy("__lang").orderBy("__rank"))
    of_all = F.sum("__n").over(W.orderBy("__rank", draw, "__id"))
    chosen = lengths.withColumn("__words", of_lang).where(F.col("__words") <= SAMPLE_WORDS).withColumn("__words", of_all).where(F.col("__words") <= SAMPLE_ALL_WORDS)
    chosen = checkpointed(chosen.select("__id", F.lit(True).alias("__fit")))
    return _texts_of(docs, chosen.select("__id")), trusted.join(F.broadcast(chosen), "__id", "left").select("__id", F.coalesce("__fit", F.lit(False)).alias("__fit"))


def _texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` (__id and others, an id once) with their text; of rows that share an id, the smallest text."""
    small = chosen.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(chosen) if small else chosen, "__id")
    return rows.groupBy(*chosen.columns).agg(F.min("text").alias("text"))


def _words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _kinds(text: str | None) -> set[str]:
    """The tokens of a text. None spans white space, and a word of letters is one; only other words are searched."""
    words = set((text or "").lower().split())
    others = [w for w in words if not w.isalpha()]
    return words.difference(others).union(TOKEN.findall(" ".join(others)))


def refused_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, bad, odds), stored: the words that speak against a document, in how many refused ones they are, and hundredths of their log odds.

    They are counted in every labelled document but the held-out half.
    """
    clean = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    labelled = labels.where(F.col("doc_id").isNotNull() & (clean | bad)).groupBy(F.col("doc_id").cast("long").alias("__id")).agg((~F.max(clean)).alias("__refused"))
    chosen = checkpointed(labelled.where(_fitted_on()))
    there = chosen.join(docs.select(F.col("doc_id").cast("long").alias("__id")), "__id", "left_semi")
    sizes = {r["__refused"]: r["count"] for r in there.groupBy("__refused").count().collect()}
    texts = bounded_batches(_texts_of(docs, chosen)).select("__refused", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(), Counter()
            for refused, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[refused].update(_kinds(text.as_py()))
            kinds = sorted(seen[0].keys() | seen[1].keys())
            counts = [pa.array([c[w] for w in kinds], pa.int64()) for c in seen]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *counts], ["word", "good", "bad"])

    counts = texts.mapInArrow(words, "word string, good long, bad long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = (F.col("bad") + 0.5) / (sizes.get(True, 0) + 1) / ((F.col("good") + 0.5) / (sizes.get(False, 0) + 1))
    return stored(counts.where((F.col("bad") >= LEAST_REFUSED) & (odds >= ODDS)).select("word", "bad", F.round(F.log(odds) * 100).cast("int").alias("odds")))


# -- n-grams -----------------------------------------------------------------


class Grams:
    """The n-grams of a list of texts, a position a word; words are runs of anything but ASCII white space.

    word and history[k - 1] are the hashes of the word at a position and k words before. A text's first words have START before them. ``before`` says how many words at the start of each text are only read as
    context, which is how a very long text is taken in pieces.
    """

    def __init__(self, texts: list[bytes], before: list[int] | None = None):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        first_byte = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        inside = np.zeros(len(data) + 1, bool)
        inside[1:] = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        word = span_hashes(data, starts, ends) if len(starts) else np.array([], np.uint64)
        self.doc = np.searchsorted(first_byte, starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        place = np.arange(len(word)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.word, self.history = word, [np.where(place >= k, np.roll(word, k), START) for k in range(1, ORDER)]
        self.last = place == self.counts[self.doc] - 1
        if before is not None:
            scored = place >= np.array(before)[self.doc]
            self.doc, self.last, self.word, self.history = self.doc[scored], self.last[scored], word[scored], [h[scored] for h in self.history]
            self.counts = np.bincount(self.doc, minlength=len(texts))

    def words(self, n: int, at: np.ndarray) -> list[np.ndarray]:
        """The words, in order, of the n-grams that end at the positions."""
        return [*(h[at] for h in self.history[: n - 1][::-1]), self.word[at]]


def _key(words: list[np.ndarray]) -> np.ndarray:
    """A key of words in order; of n-grams of different lengths too, keys are as good as distinct."""
    key = np.zeros(len(words[0]), np.uint64)
    for n, word in enumerate(words, 1):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(n))
    return key


#: The word that stands before a text.
START = np.uint64(0x2545F4914F6CDD1D)
#: What tells the key of an n-gram as the context of the next word, or as the last of its text, from its own.
CONTEXT, END = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _as(key: np.ndarray, role: np.uint64) -> np.ndarray:
    return mixed(key ^ role)


def _part(word: np.ndarray, parts: int) -> np.ndarray:
    """The part that a word's n-grams belong to; ``_part_of`` is the same on a column."""
    return (word >> np.uint64(33)) % np.uint64(parts)


def _part_of(word: str, parts: int) -> Column:
    return F.shiftrightunsigned(word, 33) % parts


class Parts:
    """The tables of a model, to be gone through once, how many there are, and how many shards each has."""

    def __init__(self, number: int, tables: Iterator[DataFrame], shards: int):
        self.number, self.tables, self.shards = number, tables, shards

    def __iter__(self) -> Iterator[DataFrame]:
        return self.tables


# -- training ----------------------------------------------------------------


def train(sample: DataFrame) -> tuple[Parts, float]:
    """The model of a sample (column text), as weights of n-grams, and the log-probability of a word it has not seen.

    Interpolated Kneser-Ney probabilities add up in logarithms: a word's is that of an unseen word, plus for each n-gram
    ending in it that was seen what this n-gram tells beyond the next shorter one, plus for each context before it that
    was seen the logarithm of its back-off weight. So a text's log-probability is a sum over its n-grams, and scoring is
    a join of counts.

    Every level's counts are sharded by n-gram: occurrences at the highest order, distinct words before at the lower ones.
    A trigram, its context and the bigram below it share the word in the middle, so all are counted and weighted in parts by
    this word, one after another. The weights come as stored tables (shard, key, weight, seen), one a part, made when it is reached, so that
    the model, which is about as long as the sample, need never be there as a whole: whoever is done with a table discards it
    before taking the next. A row has the n-grams that a task found of a shard, in arrays (see ``_shards``), so few rows are shuffled and joined. Weights
    are whole millionths of a nat; seen is how often the sample has the n-gram, MOST_SEEN at most. Keys are those of trigrams and bigrams, of bigrams as the CONTEXT of a word, and of words, with and (END) without what they weigh as contexts.
    """
    texts = stored(sample.select(utf8().alias("text")))
    parts = min(max(-(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES), 1), PARTS)
    trigrams = [stored(_trigrams(texts, part, parts)) for part in range(parts)]
    discard(texts)
    bigrams = [stored(t.groupBy("w2", "w3").agg(F.count("*").alias("c"), F.sum("c").alias("seen")).sortWithinPartitions("w2", "w3")) for t in trigrams]
    words = stored(_union(bigrams).groupBy("w3").agg(F.count("*").alias("c"), F.sum("seen").alias("seen")))
    discounts = [_level_discounts(words), _level_discounts(_union(bigrams)), _level_discounts(_union(trigrams))]
    kinds, total, kept_back = words.agg(F.count("*"), F.sum("c"), F.sum(_discount(discounts[0]))).first()
    spare = (kept_back / total if total else 1.0) / (kinds + 1)
    unseen = float(np.log(spare))
    share = F.greatest(F.col("c") - _discount(discounts[0]), F.lit(0.0)) / F.lit(float(total or 1))
    shards = max(SHARDS, -(-sum(t.count() for t in trigrams) // parts // SHARD_TRIGRAMS))
    return Parts(parts, _weights(trigrams, bigrams, words.select("w3", "seen", (share + spare).alias("p")), discounts, unseen, [words], shards), shards), unseen


def _trigrams(texts: DataFrame, part: int, parts: int) -> DataFrame:
    """(w1, w2, w3, c) of one part, with the continuations of (w1, w2): their sum ``total``, and how many occur once, twice or more; ``first`` in one row of each."""
    names = ["w1", "w2", "w3"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [t.as_py() for t in batch.column(0)]
            yield rows_of(Grams([t for t in short if len(t) <= PIECE]))
            for text in short:
                for piece, before, _ in _pieces(text, PIECE) if len(text) > PIECE else ():
                    yield rows_of(Grams([piece], [before]))

    def rows_of(g: Grams) -> pa.RecordBatch:
        mine = g.words(ORDER, np.flatnonzero(_part(g.history[0], parts) == part))
        _, at, n = np.unique(_key(mine), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.array(w[at].view(np.int64)) for w in mine), pa.array(n.astype(np.int64))], [*names, "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        w1, w2, w3, n = (np.concatenate([b.column(name).to_numpy() for b in held]) for name in (*names, "n"))
        del held
        order = np.lexsort((w3, w1, w2))
        w1, w2, w3, n = w1[order], w2[order], w3[order], n[order]
        context = np.ones(len(n), bool)
        context[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        gram = context.copy()
        gram[1:] |= w3[1:] != w3[:-1]
        at = np.flatnonzero(gram)
        c, first = np.add.reduceat(n, at), context[at]
        starts = np.flatnonzero(first)
        sums = [np.add.reduceat(x.astype(np.int64), starts) for x in (c, c == 1, c == 2, c > 2)]
        sums = [np.repeat(x, np.diff(np.append(starts, len(c)))) for x in sums]
        table = pa.RecordBatch.from_arrays([pa.array(x) for x in (w1[at], w2[at], w3[at], c, *sums, first)], [*names, "c", "total", "once", "twice", "more", "first"])
        for start in range(0, table.num_rows, ROWS):
            yield table.slice(start, ROWS)

    # shuffled once, by context: an n-gram's rows, and all n-grams of a context, are then in one partition, which Spark bounds
    rows = bounded_batches(texts).mapInArrow(grams, "w1 long, w2 long, w3 long, n long").repartition("w1", "w2")
    return rows.mapInArrow(counted, "w1 long, w2 long, w3 long, c long, total long, once long, twice long, more long, first boolean")


def _continuations() -> dict[str, Column]:
    """Aggregates over the n-grams of a context: the sum of their counts, and how many have each of the discounts."""
    return {"total": F.sum("c")} | {name: F.sum(has.cast("int")) for name, has in (("once", F.col("c") == 1), ("twice", F.col("c") == 2), ("more", F.col("c") > 2))}


def _weights(trigrams: list[DataFrame], bigrams: list[DataFrame], words: DataFrame, discounts: list[tuple], unseen: float, last: list[DataFrame], shards: int) -> Iterator[DataFrame]:
    """The tables of ``train``. What a part was made of is deleted with it, and ``last`` at the end."""
    for part, (tri, bi) in enumerate(zip(trigrams, bigrams, strict=True)):
        contexts = bi.groupBy("w2").agg(*(f.alias(name) for name, f in _continuations().items()))
        contexts = stored(contexts.select("w2", "total", _backoff(discounts[1]).alias("backoff")))
        met = bi.join(contexts.hint("shuffle_hash"), "w2").join(words.select("w3", F.col("p").alias("lower")).hint("shuffle_hash"), "w3")
        p = F.greatest(F.col("c") - _discount(discounts[1]), F.lit(0.0)) / F.col("total") + F.col("backoff") * F.col("lower")
        pairs = met.withColumn("p", p).withColumn("weight", _millionths(F.log("p") - F.log("backoff") - F.log("lower")))
        single = words.where(_part_of("w3", len(trigrams)) == part).join(contexts, F.col("w2") == F.col("w3"), "full")
        own, context = F.log("p") - unseen, F.log("backoff")
        single = single.select(F.coalesce("w3", "w2").alias("w"), own.alias("own"), (F.coalesce(own, F.lit(0.0)) + F.coalesce(context, F.lit(0.0))).alias("whole"), F.coalesce("seen", "total").alias("seen"))
        every = [
            _interpolated(tri.withColumn("backoff", _backoff(discounts[2])), pairs, discounts[2], shards),
            _keyed(single.select("w", _millionths(F.col("whole")).alias("weight"), "seen"), ["w"], shards),
            _keyed(single.where("own is not null").select("w", _millionths(F.col("own")).alias("weight"), "seen"), ["w"], shards, END),
        ]
        out = stored(_union(every))
        discard(tri, bi, contexts, *(last if part == len(trigrams) - 1 else []))
        yield out


def _interpolated(trigrams: DataFrame, pairs: DataFrame, discounts: tuple, shards: int) -> DataFrame:
    """``_shards`` of trigrams, of their contexts and of ``pairs``, the next shorter n-grams: they meet by (w2, w3), and a trigram weighs what it tells beyond its pair."""
    longer = trigrams.select("w1", "w2", "w3", "c", "total", F.col("backoff").alias("share"), "first")
    shorter = pairs.select(F.lit(None).cast("long").alias("w1"), "w2", "w3", F.col("seen").alias("c"), F.col("weight").cast("long").alias("total"), F.col("p").alias("share"), F.lit(False).alias("first"))
    discount = np.array([0.0, *discounts])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        rows = pa.Table.from_batches(rows)
        pair = rows.column("w1").is_null().to_numpy(zero_copy_only=False)
        w1 = rows.column("w1").fill_null(0).to_numpy().view(np.uint64)
        w2, w3 = (rows.column(w).to_numpy().view(np.uint64) for w in ("w2", "w3"))
        c, total, share, first = (rows.column(name).to_numpy() for name in ("c", "total", "share", "first"))
        del rows
        below, tri = _key([w2, w3]), ~pair
        known, p = below[pair], share[pair]
        order = np.argsort(known)
        lower = p[order][np.searchsorted(known[order], below[tri])]  # every trigram's pair is there
        backoff = share[tri]
        weight = np.log(np.maximum(c[tri] - discount[np.minimum(c[tri], 3)], 0.0) / total[tri] + backoff * lower) - np.log(backoff) - np.log(lower)
        keys = [_key([w1[tri], w2[tri], w3[tri]]), _as(_key([w1[first], w2[first]]), CONTEXT), known]
        weights = [np.rint(weight * 1e6), np.rint(np.log(share[first]) * 1e6), total[pair]]
        yield from _shards(np.concatenate(keys), np.concatenate(weights), np.concatenate([c[tri], total[first], c[pair]]), shards)

    # a pair's trigrams are in one partition, which Spark bounds
    return longer.unionByName(shorter).repartition("w2", "w3").mapInArrow(weighed, SHARD)


def _backoff(discounts: tuple) -> Column:
    return sum((F.col(name) * F.lit(d) for name, d in zip(("once", "twice", "more"), discounts, strict=True)), F.lit(0.0)) / F.col("total")


def _millionths(c: Column) -> Column:
    return F.round(c * 1e6).cast("int")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _keyed(grams: DataFrame, words: list[str], shards: int, role: np.uint64 | None = None) -> DataFrame:
    """``_shards`` of ``grams`` (and weight, seen), the key being that of their ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _key([batch.column(w).to_numpy().view(np.uint64) for w in words])
            yield from _shards(key if role is None else _as(key, role), batch.column("weight").to_numpy(), batch.column("seen").to_numpy(), shards)

    return bounded_batches(grams.select(*words, "weight", "seen")).mapInArrow(run, SHARD)


#: N-grams of a shard: keys (unsigned 64 bits, in order), weights (32 bits) and how often each was seen (unsigned 16 bits).
SHARD = "shard int, key binary, weight binary, seen binary"


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int32)


def _shards(key: np.ndarray, weight: np.ndarray, seen: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """A row (SHARD) for each shard that the n-grams are of."""
    shard = _shard(key, shards)
    order = np.lexsort((key, shard))
    shard, key, weight, seen = shard[order], key[order], weight[order].astype(np.int32), np.minimum(seen[order], MOST_SEEN).astype(np.uint16)
    rows = [(s, *(x[a:b].tobytes() for x in (key, weight, seen))) for s, a, b in _runs(shard)]
    if rows:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "weight", "seen"])


def _runs(ordered: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.array([], np.int64)
    return list(zip(ordered[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ordered)], strict=False))


def _discount(discounts: tuple) -> Column:
    return F.when(F.col("c") == 1, discounts[0]).when(F.col("c") == 2, discounts[1]).otherwise(discounts[2])


def _level_discounts(level: DataFrame) -> tuple[float, float, float]:
    return _discounts(*(x or 0 for x in level.agg(*(F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))).first()))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


# -- scoring -----------------------------------------------------------------


class _Local:
    """What each task has of a part of the model: weights of the most frequent n-grams, and a bitmap that tells most unseen ones."""

    def __init__(self, part: int, parts: int, keys: np.ndarray, weight: np.ndarray, bits: bytes):
        order = np.argsort(keys)
        self.part, self.parts, self.keys, self.weight = part, parts, keys[order], weight[order]
        self.shift = np.uint64(64 - FILTER_BITS)
        self.bits = np.frombuffer(bits, np.uint8)  # stays packed: a copy goes to every executor

    def rows(self, texts: list[bytes], before: list[int] | None = None, ended: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The known weight of each text, and (text, key) of the n-grams whose weights must be fetched."""
        grams = Grams(texts, before)
        last = grams.last if ended else np.zeros(len(grams.last), bool)
        own, after = (np.flatnonzero(_part(word, self.parts) == self.part) for word in (grams.history[0], grams.word))
        word, context = _key(grams.words(1, after)), after[~last[after]]
        docs = [grams.doc[own], grams.doc[own], grams.doc[after], grams.doc[context]]
        keys = [_key(grams.words(3, own)), _key(grams.words(2, own)), np.where(last[after], _as(word, END), word), _as(_key(grams.words(2, context)), CONTEXT)]
        start = np.array([START])
        if (before is None or not any(before)) and _part(start, self.parts)[0] == self.part:  # the words before the first one are contexts too
            some = np.flatnonzero(grams.counts)
            docs += [some, some]
            keys += [np.repeat(_key([start]), len(some)), np.repeat(_as(_key([start, start]), CONTEXT), len(some))]
        doc, key = np.concatenate(docs), np.concatenate(keys)
        bit = key >> self.shift
        maybe = (self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        doc, key, known = doc[maybe], key[maybe], np.zeros(len(texts), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hot = self.keys[at] == key
            known = np.bincount(doc[hot], weights=self.weight[at[hot]], minlength=len(texts)).astype(np.int64)  # exact: below 2^53
            doc, key = doc[~hot], key[~hot]
        return known, doc, key


def _pieces(text: bytes, size: int) -> Iterator[tuple[bytes, int, bool]]:
    """A text in pieces between words: each with the words before it that are its context, how many, and whether it is the last."""
    text, start, carried = text.strip(b" \t\n\v\f\r"), 0, []
    while True:
        stop = _BLANK.search(text, start + size) if start + size < len(text) else None
        end = stop.start() if stop else len(text)
        yield b" ".join([*carried, text[start:end]]), len(carried), end == len(text)
        if end == len(text):
            return
        carried = [*carried, *text[max(start, end - size) : end].split()][-(ORDER - 1) :]
        start = end


def perplexities(docs: DataFrame, model: tuple[Parts, float], refused: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """``docs`` (columns __id, __lang, text) with __n words, __log, the sum of their log-probabilities, and __odds against them.

    The texts are read once for each part of the model, which is deleted when their sums are written, before the next part
    is made. Weights are whole numbers, so sums do not depend on order. A text's sums of several parts meet by 128 bits of
    hash, as rows need not come in the same order when ``docs`` is read again; equal texts have equal sums. Words of ``refused``
    count alike: AGAINST of them in a map, others by a join. Returns a stored table; the model's and that of ``refused`` are deleted.
    """
    against = {}
    if refused is not None:
        first = refused.orderBy(F.col("bad").desc(), "word").limit(AGAINST).select("word", "odds").toArrow()
        against = dict(zip(*(c.to_pylist() for c in first.columns), strict=True))
    beyond = refused is not None and refused.count() > len(against)
    tables, unseen = model
    known_words = docs.sparkSession.sparkContext.broadcast(against)

    def about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, odds, others = [], [], []
            for text in batch.column(4):
                text = text.as_py() or b""
                kinds = _kinds(text.decode("utf-8", "replace")) if known_words.value else set()
                n.append(len(text.split()))
                odds.append(sum(known_words.value[w] for w in known_words.value.keys() & kinds))
                others.append(sorted(kinds - known_words.value.keys()) if beyond else [])
            arrays = [*batch.columns[:4], pa.array(n, pa.int64()), pa.array(odds, pa.int64()), pa.array(others, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["__id", "__lang", "__a", "__b", "__n", "__odds", "others"])

    hashes = [F.xxhash64(whole_text()).alias("__a"), F.xxhash64(F.lit(1), whole_text()).alias("__b")]
    rows = bounded_batches(docs).select("__id", "__lang", *hashes, utf8().alias("text"))
    base = stored(rows.mapInArrow(about, "__id long, __lang string, __a long, __b long, __n long, __odds long, others array<string>"))
    sums = [_met(rows.select("__a", "__b", "text"), weights, part, tables.number, hot, tables.shards) for part, weights in enumerate(tables)]
    # equal texts have equal weights, and each of them counts once in every part
    fetched = _union(sums).groupBy("__a", "__b").agg(F.expr(f"sum(weight) div (sum(n) div {tables.number})").alias("weight"))
    narrow = base.join(fetched, ["__a", "__b"])
    if beyond:
        met = base.select("__a", "__b", "others").dropDuplicates(["__a", "__b"]).select("__a", "__b", F.explode("others").alias("word")).join(refused, "word")
        narrow = narrow.join(met.groupBy("__a", "__b").agg(F.sum("odds").alias("odds")), ["__a", "__b"], "left").withColumn("__odds", F.col("__odds") + F.coalesce("odds", F.lit(0)))
    out = stored(narrow.select("__id", "__lang", "__n", ((F.col("__n") * round(unseen * 1e6) + F.col("weight")) / 1e6).alias("__log"), "__odds"))
    discard(base, *sums, *([] if refused is None else [refused]))
    return out


def _met(texts: DataFrame, weights: DataFrame, part: int, parts: int, hot: int, shards: int) -> DataFrame:
    """(__a, __b, weight, n), stored: what a part of the model adds to each text, and 1, or 0 in more rows of a long text. Its ``weights`` are deleted.

    A map over the texts adds up the weights of the most frequent n-grams, which are broadcast as they would be hot keys,
    and of the others hands on the keys that a bitmap of fixed size does not rule out. Keys, weights and sums travel in arrays, a row for a group of texts
    and a shard: a task keeps one shard of the model and streams the groups' keys past it, then what each shard adds to a group meets.
    """
    least = _frequent(weights, hot)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, weight, seen = (np.frombuffer(x, kind) for x, kind in zip(row, (np.int64, np.int32, np.uint16), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x[seen >= least]) for x in (key, weight)], ["key", "weight"])

    common = bounded_batches(weights.select("key", "weight", "seen")).mapInArrow(often, "key long, weight int")
    keys, weight = (c.to_numpy() for c in common.toArrow().columns)  # at most ``hot`` rows
    local = texts.sparkSession.sparkContext.broadcast(_Local(part, parts, keys.view(np.uint64), weight, _bitmap(weights)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            group, held = [], 0
            for meta in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
                text = meta[2].as_py() or b""
                if len(text) > PIECE:
                    for piece, before, ended in _pieces(text, PIECE):
                        yield table([meta[:2]], local.value.rows([piece], [before], ended), number, int(ended))
                        number += 1
                    continue
                group.append((*meta[:2], text))
                held += len(text)
                if held >= GROUP_BYTES or len(group) == GROUP_TEXTS:
                    yield table(group, local.value.rows([g[2] for g in group]), number)
                    group, held, number = [], 0, number + 1
            if group:
                yield table(group, local.value.rows([g[2] for g in group]), number)
                number += 1

    def table(meta: list[tuple], found: tuple, number: int, n: int = 1) -> pa.RecordBatch:
        known, doc, keys = found
        shard = _shard(keys, shards)
        order = np.argsort(shard, kind="stable")
        shard, doc, keys = shard[order], doc[order].astype(np.uint16), keys[order]
        about = np.array([[m[0] for m in meta], [m[1] for m in meta], known, [n] * len(meta)], np.int64)
        place = np.uint64(TaskContext.get().partitionId() << 32 | number)
        group = int(mixed(np.bitwise_xor.reduce(_key([about[0].view(np.uint64), about[1].view(np.uint64), np.arange(len(meta), dtype=np.uint64)]), keepdims=True) + place).view(np.int64)[0])
        rows = [(s, 1, group, keys[a:b].tobytes(), doc[a:b].tobytes()) for s, a, b in _runs(shard)]
        return _packed([*rows, (group % shards, 2, group, about.tobytes(), np.int64(len(keys)).tobytes())])

    model = weights.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("group"), F.col("key").alias("x"), F.col("weight").alias("y"))
    wanted = model.unionByName(texts.mapInArrow(score, PACKED)).repartition("shard").sortWithinPartitions("shard", "kind")
    met = bounded_batches(wanted).mapInArrow(_looked_up, PACKED).repartition("group").sortWithinPartitions("group")
    out = stored(met.mapInArrow(_added_up, "__a long, __b long, weight long, n long"))
    discard(weights)
    local.destroy()
    return out


#: What travels between texts and model. Kind 0: a shard's keys and weights; 1: keys that a group of texts has of it, and which text has each; 2: a
#: group's texts (a, b, known weight, n) and how many keys it sent; 3: what shards add to a group's texts, and for how many keys.
PACKED = "shard int, kind int, group long, x binary, y binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["shard", "kind", "group", "x", "y"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (PACKED) by shard and kind: kind 3 for the keys of groups that the shards' weights answer; kind 2 as it came."""
    sums, held = {}, 0

    def handed_on() -> pa.RecordBatch:
        return _packed([(0, 3, group, added.tobytes(), np.int64(n).tobytes()) for group, (added, n) in sums.items()])

    for _, rows in groupby(_rows(batches), lambda row: row[0]):
        model, weight = [], None
        for shard, kind, group, x, y in rows:
            if kind == 0:
                model.append((x, y))
            elif kind == 2:
                yield _packed([(shard, kind, group, x, y)])
            else:
                if weight is None:
                    known, weight = (np.frombuffer(b"".join(m[i] for m in model), t) for i, t in enumerate((np.uint64, np.int32)))
                    order = np.argsort(known)
                    known, weight, model = np.append(known[order], np.uint64(0)), np.append(weight[order], np.int32(0)), []
                key, doc = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint16)
                at = np.searchsorted(known[:-1], key)
                added = np.bincount(doc, weights=np.where(known[at] == key, weight[at], 0)).astype(np.int64)  # exact: below 2^53
                before, n = sums.get(group, (added[:0], 0))
                long, short = (added, before) if len(added) > len(before) else (before, added)
                long[: len(short)] += short
                sums[group] = long, n + len(key)
                held += 8 * (len(long) - len(before))
                if held > SUMS_BYTES:
                    yield handed_on()
                    sums, held = {}, 0
    if sums:
        yield handed_on()


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__a, __b, weight, n) of the texts of groups, whose rows (PACKED) come together."""
    for _, rows in groupby(_rows(batches), lambda row: row[2]):
        texts, parts, answered = [], [], 0
        for _, kind, _, x, y in rows:
            n = int(np.frombuffer(y, np.int64)[0])
            if kind == 2:
                texts.append((np.frombuffer(x, np.int64).reshape(4, -1), n))
            else:
                parts.append(np.frombuffer(x, np.int64))
                answered += n
        if len(texts) != 1 or texts[0][1] != answered:
            raise RuntimeError("texts were not read again in the order of before")
        a, b, weight, n = texts[0][0].copy()
        for added in parts:
            weight[: len(added)] += added
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, weight, n)], ["__a", "__b", "weight", "n"])


def _frequent(weights: DataFrame, most: int) -> int:
    """The smallest number of times seen, 2 at least, that at most so many n-grams reach."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MOST_SEEN + 1, np.int64)
        for batch in batches:
            for seen in batch.column(0):
                total += np.bincount(np.frombuffer(seen.as_py(), np.uint16), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seen", "n"])

    reached, least = 0, MOST_SEEN + 1
    counts = weights.select("seen").mapInArrow(counted, "seen long, n long").where("seen > 1").groupBy("seen").agg(F.sum("n"))
    for seen, count in sorted(map(tuple, counts.collect()), reverse=True):
        reached += count
        if reached > most:
            break
        least = seen
    return least


def _bitmap(weights: DataFrame) -> bytes:
    """A bit for each value of a key's first FILTER_BITS bits, set if a key has it; built in segments, of one size for any model."""
    bits, segments = FILTER_BITS, 1 << 8

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for batch in batches:
            for keys in batch.column(0):
                own[np.frombuffer(keys.as_py(), np.uint64) >> np.uint64(64 - bits)] = True
        packed = np.packbits(own, bitorder="little").reshape(segments, -1)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["segment", "bits"])

    def together(key: tuple, rows: pa.Table) -> pa.Table:
        every = np.stack([np.frombuffer(some.as_py(), np.uint8) for some in rows.column("bits")])  # as many as tasks before
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.bitwise_or.reduce(every).tobytes()], pa.binary())})

    parts = weights.select("key").mapInArrow(seen, "segment long, bits binary").groupBy("segment").applyInArrow(together, "segment long, bits binary")
    parts = stored(parts)  # so the shuffle of all keys goes at once; collected, it would stay beside the texts' keys
    out = bytearray((1 << FILTER_BITS) // 8)
    size = len(out) >> 8
    for number, bits in parts.collect():
        out[number * size : (number + 1) * size] = bits
    discard(parts)
    return bytes(out)


# -- verdicts ----------------------------------------------------------------


def _judged(scored: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(means, rows): (lang, mean) in nats a word, and the documents with words but those fitted on, with __step and __trusted."""
    known = trusted.select("__id", "__fit", F.lit(True).alias("__trusted"))
    rows = scored.where("__n > 0").join(known, "__id", "left").where("not coalesce(__fit, false)").withColumnRenamed("__lang", "lang")
    means = rows.groupBy("lang").agg(F.round(-F.sum("__log") / F.sum("__n"), 6).alias("mean"))
    means = checkpointed(means)  # a row a language
    near = rows.join(F.broadcast(means.withColumnRenamed("lang", "__of")), F.col("lang").eqNullSafe(F.col("__of")))
    steps = near.select("lang", F.coalesce("__trusted", F.lit(False)).alias("trusted"), F.floor(_shrunk(F.col("mean")) / STEP).alias("step"), F.ceil(F.col("__odds") / 10).alias("tenths"))
    return means, steps


def _quantile(counts: DataFrame, of: str, share: float, name: str) -> DataFrame:
    """(lang, name, n): the smallest value of ``of`` that so large a share of a language's ``count`` does not exceed, and their number."""
    reach = F.sum("count").over(W.partitionBy("lang").orderBy(of))  # as many rows as values that occur
    total = F.sum("count").over(W.partitionBy("lang"))
    placed = counts.withColumn("reach", reach).withColumn("total", total).where(F.col("reach") >= share * F.col("total"))
    return placed.groupBy("lang").agg(F.min(of).alias(name), F.first("total").alias("n"))


def _thresholds(means: DataFrame, steps: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(lang, mean, threshold, odds_limit), a row a language; none if no trusted document is held out.

    A language's place is the median of its documents, which junk hardly moves. How far above it trusted documents go is
    its own held-out quantile, drawn towards the one of all languages' held-out documents by their distance from their
    medians. So a language with few labels, or none, is judged by how trusted text elsewhere spreads about its own place, and
    each further label changes little. Odds are drawn alike.
    """
    if not steps.where("trusted").head(1):
        return means.select("lang", "mean", F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("odds_limit")).where("false")
    places = checkpointed(_quantile(steps.groupBy("lang", "step").count(), "step", 0.5, "place").drop("n"))
    held = steps.where("trusted").join(F.broadcast(places.withColumnRenamed("lang", "__of")), F.col("lang").eqNullSafe(F.col("__of"))).select("lang", (F.col("step") - F.col("place")).alias("above"), "tenths")
    above, tenths = checkpointed(held.groupBy("lang", "above").count()), checkpointed(held.groupBy("lang", "tenths").count())
    every = lambda counts, of: _quantile(counts.groupBy(F.lit("").alias("lang"), of).agg(F.sum("count").alias("count")), of, quantile, "q").first()["q"]
    own_above, own_odds = _quantile(above, "above", quantile, "q_above").alias("a"), _quantile(tenths, "tenths", quantile, "q_odds").alias("o")
    rows = means.alias("m").join(places.alias("p"), F.col("m.lang").eqNullSafe(F.col("p.lang")))
    rows = rows.join(own_above, F.col("m.lang").eqNullSafe(F.col("a.lang")), "left").join(own_odds, F.col("m.lang").eqNullSafe(F.col("o.lang")), "left")
    n = F.coalesce("a.n", F.lit(0))
    weight = n / (n + HALF_WEIGHT)
    drawn = lambda own, together: weight * F.coalesce(own, F.lit(0)) + (1 - weight) * F.lit(together)
    threshold = (F.col("place") + 1 + drawn("q_above", every(above, "above"))) * STEP + margin
    return rows.select("m.lang", "mean", threshold.alias("threshold"), (drawn("q_odds", every(tenths, "tenths")) * 10).alias("odds_limit"))


def _shrunk(mean: Column) -> Column:
    return (SHRINK * mean - F.col("__log")) / (F.col("__n") + SHRINK)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """A verdict on each document.

    Returns doc_id, lang, n_words, log_perplexity (nats a word, shrunk), threshold, fluent, odds, odds_limit, keep, a row per
    input row. ``fluent`` is the perplexity's verdict: within its language's threshold. ``keep`` departs from that alone: a
    document goes as well if words of refused documents speak against it (``odds``, log odds in hundredths) beyond the limit
    of its language, as perplexity does not tell insults among fluent words; README.md has what both find. Null and empty
    texts have no words and are kept, as nothing speaks against them; so is everything if no trusted documents
    are labelled. A null language is a language of its own. Repeated rows are judged alike; whole texts are scored; an
    empty table gives an empty result and other columns are ignored.
    """
    names = {"__id": "doc_id", "__lang": "lang", "__n": "n_words", "__odds": "odds"}
    return _verdicts(docs, labels, quantile, margin).select(*(F.col(c).alias(names.get(c, c)) for c in ("__id", "__lang", "__n", "log_perplexity", "threshold", "fluent", "__odds", "odds_limit", "keep")))


def _verdicts(docs: DataFrame, labels: DataFrame, quantile: float, margin: float) -> DataFrame:
    sample, trusted = trusted_documents(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("lang").cast("string").alias("__lang"), "text")
    scored = perplexities(rows, train(sample), refused_words(docs, labels))
    limits = F.broadcast(checkpointed(_thresholds(*_judged(scored, trusted), quantile, margin)))  # a row a language
    judged = scored.join(limits, F.col("__lang").eqNullSafe(F.col("lang")), "left")
    judged = judged.withColumn("log_perplexity", F.when(F.col("__n") > 0, _shrunk(F.col("mean"))))
    within = lambda c: F.coalesce(c, F.lit(True))
    judged = judged.withColumn("fluent", within(F.col("log_perplexity") <= F.col("threshold")))
    return judged.withColumn("keep", F.col("fluent") & (within(F.col("__odds") <= F.col("odds_limit")) | (F.col("__n") == 0)))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``docs`` without those that the classifier rejects; all columns stay. A null doc_id is never rejected."""
    (bad,) = unused(docs, "__bad_id")
    rejected = stored(_verdicts(docs, labels, quantile, margin).where("not keep and __id is not null").select(F.col("__id").alias(bad)).distinct())
    small = rejected.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rejected) if small else rejected, F.col("doc_id").cast("long") == F.col(bad), "left_anti")
