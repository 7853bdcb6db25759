"""Porter's suffix-stripping algorithm (Porter, 1980) as an Arrow UDF, for stems that are stored with an index."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The algorithm's suffix tables.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _pattern(word: str) -> str:
    """The word's letters as c and v; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or letter == "y" and out.endswith("c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _pattern(word)))


def _short(word: str) -> bool:
    return _pattern(word).endswith("cvc") and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    suffix = max((s for s in table if word.endswith(s)), key=len, default=None)
    if suffix is None or _measure(word[: -len(suffix)]) < least:
        return word
    return word[: -len(suffix)] + table[suffix]


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    """The stem of a lower-case English word; other words pass unchanged."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if "v" in _pattern(word[: -len(suffix)]):
                    word = word[: -len(suffix)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _pattern(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _pattern(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP_2, 1), STEP_3, 1)
    suffix = max((s for s in [*STEP_4, "ion"] if word.endswith(s)), key=len, default=None)
    if suffix and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or m == 1 and not _short(word[:-1]) else word
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: [porter(x) for x in w] if w is not None else None)
