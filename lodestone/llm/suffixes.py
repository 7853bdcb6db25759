"""Removal of repeated byte strings with suffix arrays built shard by shard.

A corpus-wide suffix array would sort every byte. Anchors leave only what can matter: each window of LENGTH bytes picks,
by its content alone, one anchor (the least hash among its ANCHOR-byte substrings), so equal windows share an anchor.
Neighbouring windows with one anchor form a block.

1. Blocks are counted by anchor and content, which two independent hashes stand for, 128 bits in all. All windows of a
   block that occurs twice are repeated.
2. A block that occurs once, but whose anchor occurs elsewhere, may hold some repeated windows. Such blocks, with one
   copy of each block they could match, are dealt to shards by anchor; a shard's suffix array is built by
   Larsson-Sadakane refinement in numpy, and Kasai's common prefixes of neighbours say which windows are repeated.
3. Anchors with too many different blocks for one shard are split over several. Every such shard counts its windows, the
   counts are added up, and the shards merge what is repeated with their own sorted windows by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, stored, utf8
from .words import CHUNK_BYTES, mixed, powers

LENGTH = 200
ANCHOR = 100
#: Bytes of a very long text that are searched for blocks together.
PIECE = 4 << 20
#: Different blocks of one anchor that a shard takes, and bytes of blocks that a shard is meant to hold.
SHARD_BLOCKS, SHARD_BYTES = 4_096, 2 << 20

BLOCKS = "doc_id long, text_key long, start long, size int, anchor long, block long, proof long"
RANGES = "doc_id long, text_key long, start long, stop long"


# -- blocks ------------------------------------------------------------------


class _Sums:
    """Running sums of a byte array, from which two independent 64-bit hashes of any stretch of it follow.

    The second one takes eight bytes at a time through a mixing function before it sums, so texts on which the first, a
    plain polynomial, collides by their structure are told apart.
    """

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.plain = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.plain[1:])
        m = max(len(data) - 7, 0)
        eights = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8").ravel() if m else np.array([], np.uint64)
        self.wide = np.zeros(m + 1, np.uint64)
        np.cumsum(mixed(eights + np.uint64(1)) * self.up[:m], out=self.wide[1:])

    def key(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mixed((self.plain[high] - self.plain[low]) * self.down[low] + (high - low).astype(np.uint64))

    def proof(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of stretches of eight bytes or more."""
        return mixed((self.wide[high - 7] - self.wide[low]) * self.down[low] + (high - low).astype(np.uint64))


def span_keys(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = _Sums(data)
    return sums.key(low, high), sums.proof(low, high)


def _blocks(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of the texts data[begin:end]: text, first window, last window, anchor hash and both content hashes of each block."""
    sums = _Sums(data)
    n = len(data) - anchor + 1
    hashes = mixed((sums.plain[anchor:] - sums.plain[:n]) * sums.down[:n])
    places = np.uint64((1 << 26) - 1)
    least = (hashes & ~places) | np.arange(n, dtype=np.uint64)
    width, span = 1, length - anchor + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    chosen = (least & places).astype(np.int64)
    some = ends - begins >= length
    begins, ends, texts = begins[some], ends[some], np.flatnonzero(some)
    windows = ends - begins - length + 1
    at = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    text = np.repeat(np.arange(len(begins)), windows)
    chosen = chosen[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    low, high = at[first], at[last] + length
    return texts[text[first]], low, high, hashes[chosen[first]], sums.key(low, high), sums.proof(low, high)


def text_blocks(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text_key, text as bytes): where they lie, their anchor and their content hash."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, held = [], 0
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                for start in range(0, max(len(text) - length + 1, 0), PIECE):
                    part = text[start : start + PIECE + length - 1]
                    group.append((doc_id, key, start, part))
                    held += len(part)
                    if held >= CHUNK_BYTES:
                        yield rows(group)
                        group, held = [], 0
            if group:
                yield rows(group)

    def rows(group: list[tuple]) -> pa.RecordBatch:
        ids, keys, starts, parts = zip(*group, strict=True)
        sizes = np.array([len(p) for p in parts])
        begins = np.cumsum(sizes) - sizes
        text, low, high, *hashes = _blocks(np.frombuffer(b"".join(parts), np.uint8), begins, begins + sizes, length, anchor)
        where = pa.array(text)
        columns = [pa.array(ids, pa.int64()).take(where), pa.array(keys, pa.int64()).take(where), pa.array(low - begins[text] + np.array(starts)[text]), pa.array((high - low).astype(np.int32)), *(pa.array(h.view(np.int64)) for h in hashes)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "start", "size", "anchor", "block", "proof"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(build, BLOCKS)


# -- suffix arrays -----------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Where the suffixes of ``text`` (bytes) start, in their order.

    Larsson and Sadakane's refinement: suffixes sorted by h bytes are sorted by 2h by the ranks h further on, and groups
    of one, which are in place already, are left alone.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    done = 8
    while done < n:
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        own = order[slots]
        keys = rank[own] * np.int64(n + 1) + rank[np.minimum(own + done, n)] + 1
        by = np.argsort(keys, kind="stable")
        order[slots] = own[by]
        keys = keys[by]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        new[slots] = fresh
        rank[order[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0))
        done *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """By position: bytes that its suffix shares with the one before it in the order, up to ``most``.

    Kasai's rule: a step to the right in the text loses at most one byte of the common prefix (which holds as the
    suffixes are in full order). All blocks take their steps together.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(most + 1, np.uint8)])
    out = np.zeros(n, np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[by_size], sizes[by_size]
    shared = np.zeros(len(begins), np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        going = int(np.searchsorted(-sizes, -step, side="left"))  # blocks with a byte at this step
        at = begins[:going] + step
        shared = np.maximum(shared[:going] - 1, 0)
        other = before[at]
        shared[other < 0] = 0
        open_ = np.flatnonzero((other >= 0) & (shared < most))
        while len(open_):
            equal = padded[at[open_] + shared[open_]] == padded[np.minimum(other[open_] + shared[open_], n + most)]
            open_ = open_[equal]
            shared[open_] += 1
            open_ = open_[shared[open_] < most]
        out[at] = shared
    return out


def repeated_windows(blocks: list[bytes], length: int) -> list[np.ndarray]:
    """For each block, whether each of its windows of ``length`` bytes also starts elsewhere in the blocks."""
    sizes = np.array([len(b) for b in blocks])
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(blocks), np.uint8)
    order = suffix_array(text)
    before = common_prefixes(text, order, begins, sizes, length)
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text))
    left = np.repeat(begins + sizes, sizes) - np.arange(len(text))  # bytes to the end of the block
    fits = left >= length
    # neighbours in the order that fit, with prefixes between them long enough all the way
    prefix = before[order]
    group = np.cumsum(prefix < length)  # suffixes of one group share ``length`` bytes, ends of blocks aside
    counts = np.bincount(group, weights=fits[order], minlength=int(group[-1]) + 1 if len(group) else 0)
    repeated = np.zeros(len(text), bool)
    repeated[order] = fits[order] & (counts[group] > 1)
    return [repeated[b : b + max(s - length + 1, 0)] for b, s in zip(begins, sizes, strict=True)]


# -- the operator ------------------------------------------------------------


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, scratch: list[DataFrame] | None = None) -> DataFrame:
    """(doc_id, text_key, start, stop): byte ranges whose union is what repeated windows cover. docs: doc_id, text_key, text (bytes).

    The stored tables that the result still reads are added to ``scratch``, for the caller to discard.
    """
    blocks = stored(text_blocks(docs, length, anchor))
    content = ["anchor", "block", "proof"]
    counts = stored(blocks.groupBy(*content).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start", "size")).alias("one")))
    anchors = counts.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).where("total > 1")
    kinds = stored(counts.join(anchors, "anchor").drop("total"))
    discard(counts)
    twice = kinds.where("n > 1").select(*content)
    whole = blocks.join(twice, content).select("doc_id", "text_key", "start", (F.col("start") + F.col("size")).alias("stop"))

    sought = kinds.where("kinds > 1 and singles > 0").select(*content, "n", "kinds", "one.*")
    per_text = sought.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*content, "n", "kinds", "start", "size")).alias("cut"))
    met = docs.alias("d").join(per_text.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key")))
    cut = met.select("d.doc_id", "d.text_key", F.col("d.text").alias("text"), F.explode("c.cut").alias("cut")).select("doc_id", "text_key", "cut.*", F.expr("substring(text, cast(cut.start as int) + 1, cut.size)").alias("data"))
    cut = stored(cut.dropDuplicates(content))
    volume = cut.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    shards = int(volume // SHARD_BYTES) + 1
    parts = F.ceil(F.col("kinds") / SHARD_BLOCKS).cast("int")
    shard = F.when(parts > 1, F.xxhash64("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    dealt = cut.withColumn("parts", parts).withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("long"))
    found = stored(dealt.groupBy("shard", "part").applyInArrow(lambda rows: _shard_ranges(rows, length), RANGES))
    merged = _merged_ranges(dealt.where("parts > 1"), length)
    if scratch is not None:
        scratch += [blocks, kinds, cut, found, merged]
    return whole.unionByName(found).unionByName(merged)


def _shard_ranges(rows: pa.Table, length: int) -> pa.Table:
    own = rows.select(["doc_id", "text_key", "start", "n", "data"]).to_pylist()
    out = []
    for row, flags in zip(own, repeated_windows([r["data"] for r in own], length), strict=True):
        if row["n"] == 1:
            out += [(row["doc_id"], row["text_key"], row["start"] + a, row["start"] + b - 1 + length) for a, b in _runs(flags)]
    return _range_table(out)


def _range_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "text_key", "start", "stop"), columns, strict=True)})


def _windows(rows: pa.Table, length: int) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The blocks, and of each of their windows both keys, its block's number and where it starts in it, in order of the keys."""
    own = rows.select(["doc_id", "text_key", "start", "n", "data"]).to_pylist()
    found = []
    for i, row in enumerate(own):
        at = np.arange(max(len(row["data"]) - length + 1, 0))
        found.append((*span_keys(np.frombuffer(row["data"], np.uint8), at, at + length), np.full(len(at), i), at))
    keys, proofs, of, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((proofs, keys))
    return own, keys[order], proofs[order], of[order], at[order]


def _merged_ranges(dealt: DataFrame, length: int) -> DataFrame:
    """Windows of anchors that are split over shards.

    Each shard gives its distinct windows with their counts, Spark adds these up, and a shard gets back, in order, those
    of its windows that occur twice in all; its own sorted windows are merged with them by binary search. However many
    blocks share a window, a shard counts it once, so no group grows with a window's occurrences.
    """

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        own, keys, proofs, of, _ = _windows(rows, length)
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (proofs[1:] != proofs[:-1])))
        times = np.add.reduceat(np.array([r["n"] for r in own], np.int64)[of], first)
        where = [np.full(len(first), k.as_py(), np.int64) for k in key]
        return pa.table({n: pa.array(c) for n, c in zip(("shard", "part", "key", "proof", "n"), (*where, keys[first].view(np.int64), proofs[first].view(np.int64), times), strict=True)})

    def ranges(rows: pa.Table, repeated: pa.Table) -> pa.Table:
        if not rows.num_rows or not repeated.num_rows:
            return _range_table([])
        own, keys, proofs, of, at = _windows(rows, length)
        wanted, proven = (repeated.column(c).to_numpy().view(np.uint64) for c in ("key", "proof"))
        order = np.argsort(wanted, kind="stable")
        wanted, proven = wanted[order], proven[order]
        low, high = (np.searchsorted(wanted, keys, side=s) for s in ("left", "right"))
        hit = np.zeros(len(keys), bool)
        for shift in range(int((high - low).max())):  # once, but for windows that only the second key tells apart
            hit |= (low + shift < high) & (proven[np.minimum(low + shift, len(proven) - 1)] == proofs)
        met = ((own[i], start) for i, start in zip(of[hit].tolist(), at[hit].tolist(), strict=True))
        return _range_table([(r["doc_id"], r["text_key"], r["start"] + a, r["start"] + a + length) for r, a in met if r["n"] == 1])

    windows = stored(dealt.groupBy("shard", "part").applyInArrow(counted, "shard long, part long, key long, proof long, n long"))
    twice = windows.groupBy("key", "proof").agg(F.sum("n").alias("total")).where("total > 1").select("key", "proof")
    back = windows.select("shard", "part", "key", "proof").join(twice, ["key", "proof"])
    merged = stored(dealt.groupBy("shard", "part").cogroup(back.groupBy("shard", "part")).applyInArrow(ranges, RANGES))
    discard(windows)
    return merged


def gathered_ranges(ranges: DataFrame) -> DataFrame:
    """(doc_id, text_key, ranges): each range once, though rows that are equal throughout have given it many times."""
    return ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Whole texts as UTF-8 without the bytes that a ``length``-byte string covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs as start and stop), kept (the remaining bytes), a row
    per input row. A null text counts as empty; texts shorter than ``length`` keep everything; of equal rows each is a
    document of its own, so all they share goes. Very long texts are searched in pieces that overlap by length - 1
    bytes. An empty table gives an empty result; other columns are ignored.
    """
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), utf8().alias("text"))
    scratch: list[DataFrame] = []
    gathered = stored(gathered_ranges(repeated_ranges(rows, length, anchor, scratch)))
    discard(*scratch)
    met = rows.alias("d").join(gathered.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_key") == F.col("r.text_key")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                text, spans = text.as_py(), _spans(ranges)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                out.append((len(text), sum(b - a for a, b in spans), spans, b"".join([*kept, text[at:]])))
            sizes, removed, spans, kept = zip(*out, strict=True) if out else ([], [], [], [])
            listed = pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), listed, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return met.select("d.doc_id", "d.text", "r.ranges").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: bigint, stop: bigint>>, kept binary")


def _spans(ranges: pa.ListScalar) -> list[tuple[int, int]]:
    """Ranges as maximal runs in order."""
    if not ranges.is_valid:
        return []
    start, stop = (x.to_numpy() for x in ranges.values.flatten())
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
    return list(zip(start[first].tolist(), stop[np.append(first[1:], len(start)) - 1].tolist(), strict=True))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
