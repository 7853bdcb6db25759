"""BPE encoding by speculation and verification, and decoding.

A greedy longest match proposes the tokens of each word. Byte-pair merging would give the same tokens exactly if every
token is what merging makes of its own characters and no merge would have crossed the border between two neighbours first.
The first is settled once for the vocabulary; the second is tested for all neighbours of all new words of a batch
at once, by undoing the later of the two merges at the border again and again. Only words with a border that fails are
merged exactly. Workers remember words; texts are never shuffled: the plan is one scan and one map.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole_text
from .tokens import _byte_alphabet

#: Fixed value: how this kind of tokenizer splits a normalised text into words; what the pattern leaves is white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker remembers before it starts anew, and the characters of the longest one that it keeps.
CACHE_SIZE, LONGEST = 1 << 19, 64
#: Symbols of a word up to which merging looks at all of its pairs each time.
SHORT = 40
#: Texts that are encoded together, so that the borders of their new words are tested in one call.
GROUP = 256

_workers: dict[int, Encoder] = {}


def checked(tokenizer_json: str) -> dict:
    """The file's contents; raises ValueError if it is no BPE tokenizer with word ends of the kind that this module encodes."""
    spec = json.loads(tokenizer_json)
    model, split = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    plain = model.get("type", "BPE") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    words = split[0].get("type") == "Split" and split[0]["pattern"].get("Regex") == WORDS and split[0].get("invert") and split[0].get("behavior") == "Removed"
    raw = split[-1].get("type") == "ByteLevel" and not split[-1].get("use_regex") and not split[-1].get("add_prefix_space")
    odd = [t["content"] for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
    if not plain or not words or not raw or odd or steps != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") or spec.get("post_processor"):
        raise ValueError("encode takes byte-level BPE with word ends, lower-cased and split by WORDS, without decoder or post-processor")
    return spec


class Merges:
    """The merge rules as arrays over token ids: what each token was merged from, and at which rank; base tokens have rank -1."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        size = max(vocabulary.values()) + 1
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.size, self.made, self.made_list = size, made, made.tolist()
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        ranks = np.arange(len(pairs))
        self.rank[made], self.left[made], self.right[made] = ranks, left, right
        if len(np.unique(made)) != len(made) or (self.rank[left] >= ranks).any() or (self.rank[right] >= ranks).any():
            raise ValueError("every merge must make a token of its own from tokens made before")
        order = np.argsort(left * size + right)
        self.pair_keys, self.pair_ranks = (left * size + right)[order], ranks[order]
        self.rank_of = dict(zip(zip(left.tolist(), right.tolist(), strict=True), ranks.tolist(), strict=True))
        self.vocabulary, self.suffix = vocabulary, suffix

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: whether merging never crosses the border between them.

        Goes back in time. Up to ``limit`` the tokens at the border were ``left`` and ``right``; had they a merge that comes
        before that, it would have been done. Otherwise the later of the two is taken apart, and its part at the border
        stands there until its own merge. Of equal merges the one further to the left comes first, so a left token's merge
        comes before that of the border, and that of the border before a right token's.
        """
        good, at = np.ones(len(left), bool), np.arange(len(left))
        left, right, limit = left.copy(), right.copy(), np.full(len(left), len(self.made) + 1, np.int64)
        while len(at):
            key = left * self.size + right
            found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[found] == key) & (self.pair_ranks[found] < limit)
            good[at[crossed]] = False
            a, b = self.rank[left], self.rank[right]
            going = ~crossed & ((a >= 0) | (b >= 0))
            at, left, right, a, b = at[going], left[going], right[going], a[going], b[going]
            undo_left = a > b
            limit = np.where(undo_left, a, b + 1)
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
        return good

    def exact(self, symbols: str, ends: bool = True) -> list[int]:
        """The tokens of a word (or, if it does not end, of a part of one) by merging: the pair of the lowest rank, the leftmost of equals, until none is left."""
        ids = [self.vocabulary[c] for c in symbols[:-1]] + [self.vocabulary[symbols[-1] + (self.suffix if ends else "")]]
        return self._merged_short(ids) if len(ids) <= SHORT else self._merged_long(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        """By looking at all ranks before each merge: for a few symbols the fastest."""
        find, never = self.rank_of.get, len(self.made)
        ranks = [find(pair, never) for pair in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < never:
            i = ranks.index(rank)
            ids[i : i + 2] = [self.made_list[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = find((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = find((ids[i], ids[i + 1]), never)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """By a heap of the pairs there are."""
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two is gone
            ids[i], ids[j], after[i] = self.made_list[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.rank_of.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]


class Encoder:
    """Encodes texts within one worker."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = checked(tokenizer_json)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.merges = Merges(model["vocab"], model["merges"], suffix)
        # greedy matching may only propose tokens that merging makes of their own characters
        self.inner = {t: i for t, i in model["vocab"].items() if not t.endswith(suffix) and self.merges.exact(t, False) == [i]}
        self.final = {w: i for t, i in model["vocab"].items() if t.endswith(suffix) and (w := t.removesuffix(suffix)) and self.merges.exact(w) == [i]}
        self.longest = max(map(len, self.inner))
        self.stand_ins = {b: c for c, b in _byte_alphabet().items()}
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(WORDS).findall
        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.tried, self.unlike = set(map(chr, range(128))) - set(map(chr, range(28, 32))), set()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = {t: int(i).to_bytes(4, "little") for t, i in special.items()}
        names = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    def words_of(self, text: str) -> list[str]:
        """The words of a text between special tokens. Where a character is one that the library treats otherwise, the library splits it."""
        if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            if self._unsure(text):
                normal = self.library.normalizer.normalize_str(text)
                return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a capital sigma is lowered alike wherever it stands
        return self.split(text.lower())

    def _unsure(self, text: str) -> bool:
        """Whether the text has a character that the library normalises or classes otherwise than Python; each is tried when first met."""
        for c in set(text).difference(self.tried):
            probe = f"a{c} 1{c} !{c} x"
            own = self.split(unicodedata.normalize("NFC", probe).replace("Σ", "σ").lower())
            normal = self.library.normalizer.normalize_str(probe)
            if own != [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]:
                self.unlike.add(c)
            self.tried.add(c)
        return not self.unlike.isdisjoint(text)

    def propose(self, symbols: str) -> list[int]:
        """Tokens by greedy longest match; the last one ends the word."""
        out, at, n = [], 0, len(symbols)
        inner, final = self.inner, self.final
        while (end := final.get(symbols[at:])) is None:
            for size in range(min(self.longest, n - 1 - at), 0, -1):
                token = inner.get(symbols[at : at + size])
                if token is not None:
                    out.append(token)
                    at += size
                    break
        out.append(end)
        return out

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words, each as little-endian 32-bit integers."""
        symbols = [w if w.isascii() and w.isprintable() else "".join(map(self.stand_ins.__getitem__, w.encode("utf-8", "replace"))) for w in words]
        proposed = [self.propose(s) for s in symbols]
        sizes = np.array([len(p) for p in proposed])
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        border = word[1:] == word[:-1]
        failing = np.zeros(len(words), bool)
        failing[word[1:][border][~self.merges.compatible(flat[:-1][border], flat[1:][border])]] = True
        for i in np.flatnonzero(failing).tolist():
            proposed[i] = self.merges.exact(symbols[i])
        return {w: np.array(p, "<u4").tobytes() for w, p in zip(words, proposed, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        pieces = [[p if p in self.special else self.words_of(p) for p in (self.cut(t) if self.cut else [t])] for t in texts]
        wanted = {w for parts in pieces for p in parts if not isinstance(p, str) for w in p}
        missing = wanted.difference(self.known)
        if len(self.known) + len(missing) > CACHE_SIZE:
            self.known, missing = {}, wanted
        self.known.update(self.learn(list(missing)) if missing else {})
        find, special = self.known.__getitem__, self.special
        out = [b"".join([special[p] if isinstance(p, str) else b"".join(map(find, p)) for p in parts]) for parts in pieces]
        for w in missing:
            if len(w) > LONGEST:
                del self.known[w]
        return out


def _read(tokenizer_path: str) -> str:
    with open(tokenizer_path, encoding="utf-8") as file:  # a small file on the driver; executors get it broadcast
        return file.read()


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text as the library gives them without special tokens added, a row a row.

    ids is binary: unsigned 32-bit integers, little-endian. A null text counts as empty and has no ids; repeated rows are
    encoded alike; strings of special tokens inside a text are matched as the library does by default. Words of any
    length are encoded whole; long ones aren't remembered. Characters whose class or case Unicode versions tell apart
    leave the splitting of their text to the library. Raises ValueError for a tokenizer of another kind. An
    empty table gives an empty result; other columns are ignored.
    """
    tokenizer_json = _read(tokenizer_path)
    checked(tokenizer_json)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        encoder = _workers.get(key) or _workers.setdefault(key, Encoder(shared.value))
        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, GROUP):
                found += encoder.encode(batch.column(1).slice(start, GROUP).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "ids"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids as ``encode`` gives them) with the text that the library decodes, special tokens included.

    This kind of tokenizer has no decoder: tokens stand as the vocabulary has them, word ends included, with spaces between.
    Null ids give a null text; ids that the vocabulary lacks are left out, as the library does.
    """
    tokenizer_json = _read(tokenizer_path)
    checked(tokenizer_json)
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = json.loads(shared.value)
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = [None] * (max(names.values()) + 1)
        for name, number in names.items():
            vocabulary[number] = name
        known, vocabulary = np.array([v is not None for v in vocabulary] + [False]), pa.array(vocabulary, pa.string())
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                numbers = np.frombuffer(ids.as_py() or b"", "<u4").astype(np.int64)
                numbers = numbers[known[np.minimum(numbers, len(known) - 1)]]
                tokens = pa.LargeListArray.from_arrays(pa.array([0, len(numbers)], pa.int64()), vocabulary.take(pa.array(numbers)).cast(pa.large_string()))
                texts.append(pc.binary_join(tokens, pa.scalar(" ", pa.large_string()))[0].as_py() if ids.is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return bounded_batches(encoded).select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ids and decoded texts."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
