"""Words of many texts at once, hashed in numpy: what the window and n-gram operators work on.

A word is a run of ASCII letters, digits and any bytes beyond ASCII, lower-cased; everything else separates. A word's
hash is a polynomial of its bytes modulo 2^64, mixed; equal words have equal hashes, and what hashes find is verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are hashed together. Bounds memory: about 60 bytes of arrays a byte of text.
CHUNK_BYTES = 1 << 19

_BASE = 0x100000001B3
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit values (the finalizer of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < size."""
    if not _powers or len(_powers[0][0]) < size:
        size = max(size, CHUNK_BYTES * 2)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end) of data; equal bytes, equal hash."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a list of texts: hash, document and byte span of each, in order."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
        self.first_byte = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        inside = np.zeros(len(self.data) + 1, bool)
        inside[1:] = _WORD_BYTE[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hash = span_hashes(self.data, self.starts, self.ends) if len(self.starts) else np.array([], np.uint64)
        self.doc = np.searchsorted(self.first_byte, self.starts, side="right") - 1
        self.first_word = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the size words from each position on, and whether they lie in one document."""
        if len(self.hash) < size:
            return np.array([], np.uint64), np.array([], bool)
        n = len(self.hash) - size + 1
        value = self.hash[:n]
        for i in range(1, size):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + self.hash[i : i + n])
        return value, self.doc[:n] == self.doc[size - 1 :]


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def chunks(ids: list, texts: Iterable[str | None]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in groups of about CHUNK_BYTES, texts lower-cased and encoded; null counts as empty."""
    own, group, held = [], [], 0
    for key, text in zip(ids, texts, strict=True):
        data = lowered(text or "")
        own.append(key)
        group.append(data)
        held += len(data)
        if held >= CHUNK_BYTES:
            yield own, group
            own, group, held = [], [], 0
    if own:
        yield own, group
