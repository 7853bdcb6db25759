"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is a query set that is taken in blocks of bounded size against all documents. A first, narrow pass counts
in how many documents each word 3-gram of a block occurs. Grams that are rare, judged within their item, are seeds. A
second pass looks up the grams that may lead to an item, and aligns the places they lead to with it, so copies with words
changed, added or left out are scored as well.

What is copied often is not rare, so common grams lead to their items too, as long as few items share them. Grams that
many items share (stock phrases) lead to an item only as far as its other grams leave so many of its words that a copy of
these alone could reach the score. So what a document is held against does not grow with the items that share a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, unused
from .words import Words, chunks, lowered, mixed

GRAM = 3
#: An alignment counts if it reaches this share of the score of the item aligned with itself.
MIN_SCORE = 0.5
#: Fixed values of the alignment: scores of equal words, of a changed word and of an extra or missing word.
MATCH, CHANGE, GAP = 2, -1, -1
#: A gram that is more than so many times as frequent as the median of its item's grams that occur is no seed ...
RARE = 10
#: ... nor is one that more items share; but an item's rarest grams, so many, counted in documents and items, always are.
SHARED_ITEMS, LEAST_SEEDS = 8, 3
#: Words of benchmark items that are broadcast together.
BLOCK_WORDS = 1_000_000

RESULT = "doc_id long, item_id long, score double, n_seeds int, start_word long, end_word long"


class _Items:
    """A block of benchmark items as word hashes, with their grams in a sorted table."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        words = Words([lowered(t or "") for t in texts])
        self.ids = ids
        self.words = [words.hash[a:b] for a, b in zip(words.first_word[:-1], words.first_word[1:], strict=True)]
        grams, whole = words.shingles(GRAM)
        pairs = np.unique(np.stack([grams[whole], words.doc[: len(grams)][whole].astype(np.uint64)], axis=1), axis=0) if whole.any() else np.empty((0, 2), np.uint64)
        self.grams, self.first = np.unique(pairs[:, 0], return_index=True)  # a gram's items: item[first[g]:first[g + 1]]
        self.item = pairs[:, 1].astype(np.int64)
        self.first = np.append(self.first, len(pairs))
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def gram_places(self, item: int) -> dict[int, np.ndarray]:
        """By gram, where an item's words are that it covers."""
        value = self.words[item][: len(self.words[item]) - GRAM + 1]
        for i in range(1, GRAM):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + self.words[item][i : i + len(value)])
        which = np.searchsorted(self.grams, value)
        return {int(g): (np.flatnonzero(which == g)[:, None] + np.arange(GRAM)).ravel() for g in np.unique(which)}

    def find(self, grams: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known grams, and which they are."""
        at = np.flatnonzero(self.bits[(grams >> np.uint64(44)).astype(np.int64)] & usable)
        which = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[which] == grams[at]
        return at[same], which[same]


class _Search:
    """What leads to which item: the pairs of grams and items that are looked up, and each item's seeds."""

    def __init__(self, block: _Items, frequency: np.ndarray, min_score: float):
        self.block, self.min_score, self.seeds = block, min_score, _seeds(block, frequency)
        gram = np.repeat(np.arange(len(block.grams)), np.diff(block.first))
        shared = np.diff(block.first)[gram]
        leads = (shared <= SHARED_ITEMS) | (frequency[gram] == 0)
        order = np.argsort(block.item, kind="stable")
        bounds = np.searchsorted(block.item[order], np.arange(len(block.ids) + 1))
        for item, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own = order[a:b]
            leads[own] |= np.isin(gram[own], list(self.seeds[item]))
            if leads[own].all():
                continue
            places = block.gram_places(item)
            left = np.ones(len(block.words[item]), bool)
            for pair in own[leads[own]]:
                left[places[gram[pair]]] = False
            for pair in sorted(own[~leads[own]], key=lambda x: (frequency[gram[x]] * shared[x], x)):
                if left.sum() < min_score * len(left):
                    break
                left[places[gram[pair]]] = False
                leads[pair] = True
        self.item = block.item[leads]
        self.first = np.append(0, np.cumsum(np.bincount(gram[leads], minlength=len(block.grams))))

    def places(self, ids: list, texts: list[bytes]) -> Iterator[tuple]:
        """(id, item, first word, seeds met, words) of every place that looked-up grams lead to."""
        words = Words(texts)
        grams, usable = words.shingles(GRAM)
        if not len(grams) or not len(self.block.grams):
            return
        at, which = self.block.find(grams, usable)
        counts = self.first[which + 1] - self.first[which]
        at, which, counts = at[counts > 0], which[counts > 0], counts[counts > 0]
        if not len(at):
            return
        items = self.item[np.repeat(self.first[which], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        at, which = np.repeat(at, counts), np.repeat(which, counts)
        order = np.lexsort((at, items, words.doc[at]))
        at, which, items = at[order], which[order], items[order]
        docs = words.doc[at]
        length = self.block.length[items]
        new = np.ones(len(at), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (items[1:] != items[:-1]) | (at[1:] - at[:-1] > length[1:])
        first = np.flatnonzero(new)
        for a, b in zip(first, np.append(first[1:], len(at)), strict=True):
            doc, item = int(docs[a]), int(items[a])
            low = max(words.first_word[doc], at[a] - length[a])
            high = min(words.first_word[doc + 1], at[b - 1] + GRAM + length[a])
            yield ids[doc], item, int(low - words.first_word[doc]), len(self.seeds[item].intersection(which[a:b].tolist())), words.hash[low:high]

    def leaks(self, ids: list, texts: list[bytes]) -> Iterator[tuple]:
        """Rows of RESULT."""
        for doc_id, item, first, n_seeds, words in self.places(ids, texts):
            own = self.block.words[item]
            enough = self.min_score * MATCH * len(own)
            if most_points(own, words) < enough:
                continue
            points, end = align(own, words)
            if points >= enough:
                start = end - align(own[::-1], words[:end][::-1])[1]
                yield doc_id, self.block.ids[item], points / (MATCH * len(own)), n_seeds, first + start, first + end


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and the end of it within words."""
    step = np.arange(len(words) + 1) * -GAP
    row, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for word in item:
        above = np.maximum(row + GAP, 0)
        above[1:] = np.maximum(above[1:], row[:-1] + np.where(words == word, MATCH, CHANGE))
        row = np.maximum.accumulate(above + step) - step  # extra words: the best cell to the left, less the gaps
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def most_points(item: np.ndarray, words: np.ndarray) -> int:
    """What the best local alignment's score can't exceed.

    Each match uses up a word of either side, and a word that the other side has not costs a point wherever it is spanned.
    """
    kinds, own = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(kinds, words), len(kinds) - 1)
    known = kinds[at] == words
    there = np.bincount(at[known], minlength=len(kinds))
    bound = MATCH * int(np.minimum(own, there).sum())
    for same in (known, there[np.searchsorted(kinds, item)] > 0):
        total = np.append(0, np.cumsum(np.where(same, MATCH, max(CHANGE, GAP))))
        bound = min(bound, int((total - np.minimum.accumulate(total)).max()))
    return bound


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents that hold a copy of a benchmark item, exact or edited.

    Returns doc_id, item_id, score (1 for an exact copy), n_seeds (the item's seeds in the place, 0 if it was found by
    common grams alone), start_word, end_word (the copy's words in the document), a row per document and item: the best
    place. Null and empty texts match nothing, and neither do items
    of fewer than three words. Items without an id are sought like any other; of all these a document has one row, with
    a null item_id. Repeated rows of either table give one row for each pair of ids. Texts of any length are
    searched whole. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates())
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = int(total // block_words) + 1
    found = spark.createDataFrame([], RESULT)
    for number in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).orderBy("item_id", "text").collect()  # bounded by block_words
        if rows:
            found = found.unionByName(_block_leaks(docs, _Items([r.item_id for r in rows], [r.text for r in rows]), min_score))
    best = F.max_by(F.struct("score", "n_seeds", "start_word", "end_word"), F.struct("score", -F.col("start_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def _block_leaks(docs: DataFrame, block: _Items, min_score: float) -> DataFrame:
    context, rows = docs.sparkSession.sparkContext, bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = context.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value.grams)
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, texts in chunks(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))):
                words = Words(texts)
                grams, usable = words.shingles(GRAM)
                if len(grams) and size:
                    at, which = shared.value.find(grams, usable)
                    total += np.bincount(np.unique(words.doc[at] * size + which) % size, minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["gram", "n"])

    frequency = np.zeros(len(block.grams), np.int64)
    for gram, n in rows.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():  # at most one row a gram of the block
        frequency[gram] = n
    search = context.broadcast(_Search(block, frequency, min_score))

    def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))):
                found = list(search.value.leaks(ids, texts))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "n_seeds", "start_word", "end_word"])

    return rows.mapInArrow(leaks, RESULT)


def _seeds(block: _Items, frequency: np.ndarray) -> list[set[int]]:
    """Each item's seed grams."""
    gram = np.repeat(np.arange(len(block.grams)), np.diff(block.first))
    shared = np.diff(block.first)[gram]
    out: list[set[int]] = [set() for _ in block.ids]
    order = np.argsort(block.item, kind="stable")
    bounds = np.searchsorted(block.item[order], np.arange(len(block.ids) + 1))
    for item, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own = order[a:b]
        own = own[frequency[gram[own]] > 0]
        if len(own):
            common = frequency[gram[own]]
            rare = (common <= RARE * max(1.0, float(np.median(common)))) & (shared[own] <= SHARED_ITEMS)
            rarest = own[np.argsort(common * shared[own], kind="stable")[:LEAST_SEEDS]]
            out[item] = {int(g) for g in np.concatenate([gram[own][rare], gram[rarest]])}
    return out


#: Flagged documents whose ids are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that hold a copy of a benchmark item; all columns stay. A null doc_id is never flagged."""
    (bad,) = unused(docs, "__bad_id")
    flagged = stored(find_leaks(docs, benchmark, min_score).where("doc_id is not null").select(F.col("doc_id").alias(bad)).distinct())
    small = flagged.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(flagged) if small else flagged, F.col("doc_id").cast("long") == F.col(bad), "left_anti")
