"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a value that lies within r bits of both. So every distinct
fingerprint emits all values of its ball of radius r, the values are shuffled, and fingerprints that meet in a value are
linked; each link is verified by counting bits. A value's holders all lie within 2r bits of each other, hence linking
each to one of them loses nothing and no group is expanded into its pairs.

The ball of a 64-bit fingerprint at r = 2 has 2,081 values. To keep the shuffle small, a value travels as eight bytes in
a block of values of the same bucket: an invertible mix makes the buckets even, the bucket carries the mix's high bits,
and the position within the ball (12 bits) gives back the fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, unused, utf8
from .graph import connected_components

SHINGLE, SEED = 4, 42
MAX_BITS = 4
#: Fingerprints whose balls are built together: about 260 values of 8 bytes each in a phase.
BATCH = 4_096
#: Parts of the ball values that are shuffled one after another.
PHASES = 8
#: Links that a task holds before it reduces them to a forest.
LINKS = 1_000_000
#: Ball values that a bucket is meant to hold; the number of buckets follows the input.
BUCKET_VALUES = 200_000
#: Shingles whose bits are counted together.
BLOCK = 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SLOT_BITS = 12


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of the 4-word shingles of a text, or of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-SHINGLE].tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    if not hashes:
        return 0
    values, counts = np.array(hashes, np.uint64), np.zeros(64, np.int64)
    for start in range(0, len(values), BLOCK):
        block = values[start : start + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): a hash that names the text, and its SimHash as a signed long, of each whole text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(text.as_py())) for text in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), utf8().alias("text"))
    return rows.mapInArrow(build, "doc_id long, text_key long, fp long")


def _masks(radius: int) -> np.ndarray:
    """The bit patterns of weight 0 to radius."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)], np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * _MIX
    return (values ^ (values >> np.uint64(32))) * _MIX


def _unmixed(values: np.ndarray) -> np.ndarray:
    values = values * _UNMIX
    return (values ^ (values >> np.uint64(32))) * _UNMIX


def _phase(values: np.ndarray) -> np.ndarray:
    """Which of the PHASES a value belongs to: parities of fixed sets of its bits, so that _phase(x ^ y) is _phase(x) ^ _phase(y)."""
    sets = [np.uint64(sum(1 << b for b in range(64) if (b % 7 + 1) >> i & 1)) for i in range(3)]
    return sum((np.bitwise_count(values & s) & 1).astype(np.int64) << i for i, s in enumerate(sets))


def ball_links(distinct: DataFrame, count: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of column fp, enough to connect all that differ in max_bits or fewer.

    count is the number of fingerprints; the bucket count is derived from it and is at least 4,096, as 12 bits of each
    value stand in its bucket's number. The values are shuffled in PHASES parts one after another, each of which is
    deleted when its links are written, so the disk holds one part at a time.
    """
    if max_bits % 2 or max_bits > 4:
        raise ValueError("max_bits must be 2 or 4")  # the ball's size: 65 and 2,081 values
    masks = _masks(max_bits // 2)
    bits = max(_SLOT_BITS, int(count * len(masks) / PHASES / BUCKET_VALUES).bit_length())
    links = [stored(_phase_links(distinct, masks, bits, max_bits, phase)) for phase in range(PHASES)]
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return every.distinct()


def _phase_links(distinct: DataFrame, masks: np.ndarray, bits: int, max_bits: int, phase: int) -> DataFrame:
    low, slot_mask = np.uint64(64 - bits), np.uint64((1 << _SLOT_BITS) - 1)
    of_masks = _phase(masks)

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(prints), BATCH):
                part = prints[start : start + BATCH]
                own = _phase(part)
                values, slots = [], []
                for kind in range(PHASES):
                    fitting = np.flatnonzero(of_masks == kind ^ phase)
                    balls = _mixed(part[own == kind][None, :] ^ masks[fitting][:, None])
                    values.append(balls.ravel())
                    slots.append(np.repeat(fitting.astype(np.uint64), balls.shape[1]))
                values, slots = np.concatenate(values), np.concatenate(slots)
                bucket = values >> low
                order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
                records = ((values << np.uint64(bits)) >> np.uint64(bits) << np.uint64(_SLOT_BITS) | slots)[order]
                found, first = np.unique(bucket[order], return_index=True)
                offsets = np.append(first, len(records)).astype(np.int32) * 8
                blocks = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(records)])
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), blocks], ["bucket", "block"])

    def meet(bucket: int, blocks: list[bytes]) -> np.ndarray:
        records = np.sort(np.frombuffer(b"".join(blocks), np.uint64))
        keys = records >> np.uint64(_SLOT_BITS)
        same = keys[1:] == keys[:-1]
        met = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        if not len(met):
            return np.empty((0, 2), np.int64)
        keys, slots = keys[met], (records[met] & slot_mask).astype(np.int64)
        prints = (_unmixed(keys | np.uint64(bucket) << low) ^ masks[slots]).view(np.int64)
        first = np.flatnonzero(np.insert(keys[1:] != keys[:-1], 0, True))
        leader = np.repeat(np.minimum.reduceat(prints, first), np.diff(np.append(first, len(keys))))
        near = np.bitwise_count(leader.view(np.uint64) ^ prints.view(np.uint64)) <= max_bits
        return np.stack([prints, leader], axis=1)[near & (prints != leader)]

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, found = None, [], [np.empty((0, 2), np.int64)]
        for batch in batches:
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key != bucket and blocks:
                    found.append(meet(bucket, blocks))
                    blocks = []
                bucket = key
                blocks.append(block.as_py())
            if sum(map(len, found)) > LINKS:
                found = [_forest(np.unique(np.concatenate(found), axis=0))]
                if len(found[0]) > LINKS // 2:
                    yield _links(found.pop())
                    found = [np.empty((0, 2), np.int64)]
        if blocks:
            found.append(meet(bucket, blocks))
        yield _links(_forest(np.unique(np.concatenate(found), axis=0)))

    values = distinct.select("fp").mapInArrow(balls, "bucket long, block binary")
    return values.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meetings, "u long, v long")


def _links(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Links of the same components as ``pairs``, at most one for each node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for u, v in pairs.tolist():
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    out = [(x, root(x)) for x in parent]
    return np.array([p for p in out if p[0] != p[1]], np.int64).reshape(-1, 2)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Each document's fingerprint and near-duplicate group.

    Returns doc_id, fp (signed long), component_id (the smallest doc_id reachable over links of max_bits or fewer
    differing bits), a row per input row. Null and empty texts have fingerprint zero and link like any other; repeated
    rows stay. A null doc_id is carried through and never names a group unless all of it is null. Very long texts are
    hashed shingle by shingle. An empty table gives an empty result; other columns are ignored.
    """
    return _groups(docs, max_bits).select("doc_id", "fp", "component_id")


def _groups(docs: DataFrame, max_bits: int) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id): root is the group's smallest fingerprint."""
    own = stored(fingerprints(docs))
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    roots = connected_components(ball_links(distinct, distinct.count(), max_bits))
    grouped = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return own.join(grouped.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest doc_id; all columns stay.

    Ids that are null come last. Of rows that repeat the kept id and text one stays.
    """
    kept_id, kept_key, own_key = unused(docs, "__kept_id", "__kept_key", "__own_key")
    groups = stored(_groups(docs, max_bits))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    kept = stored(groups.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_key"), order).alias("k")).select(F.col("k.doc_id").alias(kept_id), F.col("k.text_key").alias(kept_key)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64("text") == F.col(kept_key))
    rows = docs.join(kept, same, "left_semi")
    repeated = groups.groupBy("doc_id", "text_key").count().where("count > 1")
    return rows if repeated.isEmpty() else rows.withColumn(own_key, F.xxhash64("text")).dropDuplicates(["doc_id", own_key]).drop(own_key)
