"""Media columns: texts stored as WAV samples, read back, and fingerprinted by spectral-peak pairs."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, sha256_hex, utf8

#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64
RATE = 8_000
FRAME, HOP = 128, 64
#: Frames that are transformed together; bounds memory on long payloads.
BLOCK = 4_096
#: A peak is the strongest bin of its frame and of this many frames to either side; it is paired with the next ones.
NEIGHBOURS, FAN_OUT = 1, 2
#: Rows of stored media that are handed to Spark together.
MEDIA_BYTES = 4 << 20

SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, peak_time array<int>, peak_hash array<long>"


def write_wav(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks of a short-time Fourier transform with a Hann window."""
    signal = np.frombuffer(samples, np.uint8)
    if len(signal) < FRAME:
        signal = np.concatenate([signal, np.full(FRAME - len(signal), 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    strength, best = [], []
    for start in range(0, len(frames), BLOCK):
        block = (frames[start : start + BLOCK].astype(np.float32) - 128) * window
        power = np.abs(np.fft.rfft(block, axis=1)[:, 1:])
        best.append(power.argmax(axis=1))
        strength.append(power.max(axis=1))
    strength, best = np.concatenate(strength), np.concatenate(best)
    around = np.pad(strength, NEIGHBOURS, constant_values=-1)
    around = np.lib.stride_tricks.sliding_window_view(around, 2 * NEIGHBOURS + 1).max(axis=1)
    at = np.flatnonzero((strength == around) & (strength > 1e-3))
    return at.astype(np.int32), (best[at] + 1).astype(np.int32)


def peak_pairs(time: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded fingerprints: the first peak's frame, and a hash of both bins and the distance between the frames."""
    times, hashes = [], []
    for step in range(1, FAN_OUT + 1):
        gap = (time[step:] - time[:-step]).astype(np.int64)  # 31 bits: any distance there is
        times.append(time[:-step])
        hashes.append((bins[:-step].astype(np.int64) << 40) | (bins[step:].astype(np.int64) << 32) | gap)
    times, hashes = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((hashes, times))
    return times[order].astype(np.int32), hashes[order]


def store_as_media(docs: DataFrame) -> DataFrame:
    """Each whole text as a WAV file with the payload read back from it and its spectral-peak fingerprints.

    Returns doc_id, n_bytes (unpadded), media, payload, peak_time, peak_hash, a row per input row. A null text counts
    as empty; an empty text is 64 zero bytes. Equal texts give equal values; repeated rows stay. Texts of any length are
    transformed in blocks of bounded size. Other columns are ignored.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                media = write_wav(text + bytes(-len(text) % UNIT if text else UNIT))
                payload = read_wav(media)
                times, hashes = peak_pairs(*spectral_peaks(payload))
                rows.append((doc_id, len(text), media, payload, times, hashes))
                held += len(media)
                if held >= MEDIA_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(store, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, sizes, media, payloads, times, hashes = zip(*rows, strict=True)
    offsets = np.cumsum([0, *map(len, times)]).astype(np.int32)
    arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(payloads, pa.binary())]
    arrays += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x))) for x in (times, hashes)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media", "payload", "peak_time", "peak_hash"])


def media_digest(media: DataFrame) -> DataFrame:
    """What identifies each stored text: sizes, digests of payload and stored form, and its fingerprint as a string."""
    feature = F.concat_ws(":", F.size("peak_hash").cast("string"), F.md5(F.concat_ws(",", F.col("peak_time").cast("array<string>"), F.col("peak_hash").cast("array<string>"))))
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha256_hex(F.col("payload")).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        sha256_hex(F.col("media")).alias("media_sha256"),
        feature.alias("feature"),
    )
