"""Measures of a brief: whether its source supports it, whether it helps to remember, whether it was read as what it is."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import light_stem

#: What a word is, words that say nothing, words that a statement needs, and the share of them that supports it.
WORD = "[0-9A-Za-zÀ-ɏЀ-ӿ぀-ヿ一-鿿가-힯]+"
SILENT = ("a", "an", "the", "this", "that", "these", "those", "is", "are", "was", "were", "be", "been", "being", "of", "in", "on", "at", "to", "for", "with", "from", "by", "as", "and", "or", "but", "if", "then", "than", "so", "such", "it", "its", "it's")
LEAST_WORDS, SUPPORT = 3, 0.6


def _folded(text: str | None) -> str:
    plain = unicodedata.normalize("NFKD", text or "").casefold()
    return "".join(c for c in plain if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Texts without case and accents: no built-in decomposes characters."""
    return texts.map(_folded)


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: None if x is None else [_folded(t) for t in x])


def groundedness(briefs: DataFrame, key: str, statements: str, body: str, kind: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(key, checked, supported, unsupported, score): which of a brief's statements its body supports.

    A statement is supported if it stands in the body, white space aside, or if 0.6 of the stems of its words that say
    something do; with under three such words it is not checked. With ``kind``, the brief's own label is one more check: whether
    it is one of ``kinds``. Nothing checked scores 1. Null statements and bodies are empty ones.
    """
    said = F.transform(F.coalesce(F.col(statements), F.array().cast("array<string>")), lambda s: F.trim(F.coalesce(s, F.lit(""))))
    rows = briefs.withColumn("__said", said).withColumn("__flat", folded_each("__said")).withColumn("__body", folded(F.col(body)))
    stems_of = lambda words: F.transform(words, lambda w: light_stem(w))
    words_of = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    bound = lambda values, f: F.get(F.transform(F.array(F.struct(*values)), f), F.lit(0))

    def judged(flat: Column, body: Column) -> Column:
        said = [_squeezed(flat).alias("plain"), stems_of(F.filter(words_of(flat), lambda w: ~w.isin(*SILENT))).alias("stems")]
        missing = lambda x: [x["plain"].alias("plain"), x["stems"].alias("stems"), F.array_except(x["stems"], body["stems"]).alias("missing")]
        return bound(said, lambda x: bound(missing(x), lambda y: verdict(y, body)))

    def verdict(said: Column, body: Column) -> Column:
        there = (said["plain"] != "") & F.contains(body["plain"], said["plain"])
        share = F.size(F.filter(said["stems"], lambda w: ~F.array_contains(said["missing"], w))) / F.size(said["stems"])
        return F.when(there, "yes").when(F.size(said["stems"]) < LEAST_WORDS, "unchecked").when(share >= SUPPORT, "yes").otherwise("no")

    # what is used several times is bound to a variable: as a column, Spark would make a body's stems anew for each word of a statement
    bodies = [_squeezed(F.col("__body")).alias("plain"), F.array_distinct(stems_of(words_of(F.col("__body")))).alias("stems")]
    rows = rows.withColumn("__verdicts", bound(bodies, lambda b: F.transform("__flat", lambda flat: judged(flat, b))))
    rows = rows.withColumn("__judged", F.zip_with("__said", "__verdicts", lambda s, j: F.struct(s.alias("s"), j.alias("j"))))
    label = F.col(kind) if kind else F.lit(None).cast("string")
    labelled = F.when(label.isNotNull(), F.array(F.struct(F.concat(F.lit("content_type "), label).alias("s"), F.when(label.isin(*kinds) if kinds else F.lit(False), "yes").otherwise("no").alias("j")))).otherwise(F.array().cast("array<struct<s:string,j:string>>"))
    rows = rows.withColumn("__judged", F.concat("__judged", labelled))
    of = lambda *j: F.filter("__judged", lambda x: x["j"].isin(*j))
    checked, supported = F.size(of("yes", "no")), F.size(of("yes"))
    score = F.when(checked > 0, F.round(supported / checked, 6)).otherwise(F.lit(1.0))
    return rows.select(key, checked.alias("checked"), supported.alias("supported"), F.transform(of("no"), lambda x: x["s"]).alias("unsupported"), score.alias("score"))


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def usefulness(overview: Column, title: Column, highlights: Column, topics: Column, content_type: Column, kind: Column, timestamps: Column, items: Column, keys: Column, required: tuple[str, ...] = ()) -> Column:
    """struct(checks map<string,boolean>, score): named checks of what one wants back, and the share that holds.

    A video's brief must also give times and list its items; each key of ``required`` must be among the structured ``keys``.
    """
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    plain = {"has_overview": said(overview), "has_title": said(title), "has_highlights": some(highlights), "has_topics": some(topics), "declares_content_type": said(content_type)}
    plain |= {f"has_{k}": F.coalesce(F.array_contains(keys, k), F.lit(False)) for k in required}
    video = {"has_timestamps": some(timestamps), "lists_items": some(items)}
    as_map = lambda checks: F.create_map(*(x for n, c in checks.items() for x in (F.lit(n), c)))
    checks = F.when(kind == "video", F.map_concat(as_map(plain), as_map(video))).otherwise(as_map(plain))
    held = F.size(F.filter(F.map_values(checks), lambda x: x)) / F.size(checks)
    return F.struct(checks.alias("checks"), F.round(held, 6).alias("score"))


def extracted_rightly(actual: Column, expected: Column, keys: Column, expected_keys: Column) -> Column:
    """Whether a brief has the profile that was expected, general if it names none, and all of its keys."""
    return (F.coalesce(actual, F.lit("general")) == expected) & (F.size(F.array_except(expected_keys, F.coalesce(keys, F.array().cast("array<string>")))) == 0)
