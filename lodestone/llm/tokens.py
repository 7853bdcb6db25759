"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table from frequent pre-tokens to their token counts: the vocabulary's own entries, whose
number is fixed by the tokenizer file. Tier two is a cache in each Python worker: pre-tokens that the table misses are
encoded once per worker by the library and remembered. No pre-token is ever shuffled; the plan is one scan and one map.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole_text

#: Fixed value: how byte-level BPE splits text before its merges.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker's cache holds before it starts anew, and the characters of the longest one it keeps.
CACHE_SIZE, LONGEST = 1 << 20, 64
#: Texts that are looked up together, so that misses are encoded in one call.
GROUP = 64
#: Between ASCII characters and before a space that stands alone every pre-token ends.
_SURE_BOUNDARY = regex.compile(r"(?<=[!-~])(?= [!-~])")

_workers: dict[int, Counter] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE uses for bytes: itself if printable, else from U+0100 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def frequent_lengths(tokenizer_json: str) -> dict[str, int]:
    """Token counts of the vocabulary's entries that are text, as the library itself gives them."""
    from tokenizers import Tokenizer

    tokenizer, alphabet = Tokenizer.from_str(tokenizer_json), _byte_alphabet()
    entries = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if all(c in alphabet for c in entry):
            try:
                entries.append(bytes(alphabet[c] for c in entry).decode())
            except UnicodeDecodeError:  # part of a character
                continue
    encoded = tokenizer.encode_batch(entries, add_special_tokens=False)
    return {text: len(e.ids) for text, e in zip(entries, encoded, strict=True)}


def checked(tokenizer_json: str) -> None:
    """Raises if the file is no plain byte-level tokenizer, whose pre-tokens PRE_TOKEN gives."""
    spec = json.loads(tokenizer_json)
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    odd = [t["content"] for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
    if spec.get("normalizer") or not plain or odd:
        raise ValueError("count_tokens takes byte-level BPE without normalizer, prefix space or stripping special tokens")


class Counter:
    """Counts tokens within one worker."""

    def __init__(self, tokenizer_json: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.frequent = frequent
        self.known = dict(frequent)
        self.split = regex.compile(PRE_TOKEN).findall
        self.tried, self.unlike = set(map(chr, range(128))), set()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def counts(self, texts: list[str]) -> list[int]:
        known = self.known
        specials = [len(self.special.findall(t)) if self.special else 0 for t in texts]
        pieces = [self._pieces(text, bool(n)) for text, n in zip(texts, specials, strict=True)]
        wanted = set().union(*pieces)
        missing = wanted.difference(known)
        if missing and len(known) + len(missing) > CACHE_SIZE + len(self.frequent):
            known = self.known = dict(self.frequent)
            missing = wanted.difference(known)
        words = list(missing)
        known.update(zip(words, (len(e.ids) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)), strict=True))
        found = [sum(map(known.__getitem__, p)) + n for p, n in zip(pieces, specials, strict=True)]
        for word in words:
            if len(word) > LONGEST:
                del known[word]
        return found

    def unsure(self, text: str) -> bool:
        """Whether the text has a character that the library takes for another class (letter, number, space) than ``regex``.

        Both follow some version of Unicode. A character is tried beside one of each class when it is first met.
        """
        for c in set(text).difference(self.tried):
            probe = f"a{c} 1{c} !{c} x"
            if [x[1] for x in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] != [m.span() for m in regex.finditer(PRE_TOKEN, probe)]:
                self.unlike.add(c)
            self.tried.add(c)
        return not self.unlike.isdisjoint(text)

    def _pieces(self, text: str, specials: bool) -> list[str]:
        """The text's pre-tokens; where a character's class is unsure, the stretch up to the next sure boundaries instead."""
        parts = [p for p in self.special.split(text) if p] if specials else [text]
        if text.isascii() or not self.unsure(text):
            return [piece for part in parts for piece in self.split(part)]
        stretches = (s for part in parts for s in _SURE_BOUNDARY.split(part))
        return [piece for s in stretches for piece in ([s] if self.unsure(s) else self.split(s))]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Tokens of each whole text as the library counts them, without begin or end tokens.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row per input row. A null text counts as empty
    (0 tokens); repeated rows are counted alike; strings of special tokens inside a text are matched as the library does
    by default. Characters on whose class Unicode versions differ leave their stretch of text to the library. Very long
    pre-tokens are encoded but not remembered. Raises ValueError for a tokenizer of another kind. Other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:  # a small file on the driver; executors get it broadcast
        tokenizer_json = file.read()
    checked(tokenizer_json)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, frequent_lengths(tokenizer_json)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value[0])
        counter = _workers.get(key) or _workers.setdefault(key, Counter(*shared.value))
        for batch in batches:
            texts, found = batch.column(1), []
            for start in range(0, batch.num_rows, GROUP):
                found += counter.counts(texts.slice(start, GROUP).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
