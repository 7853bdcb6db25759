"""Briefs: validation as ordered column rules, tolerant JSON, flattening, segments and slots."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of a brief's lists and title, and the hedges that an intent starts with.
TAGS, PHRASES, TITLE_LENGTH = (15, 30), (5, 8), 80
HEDGES = r"^(You may have saved this to|قد|ربما|لعل)"
#: Fixed value: what a brief must not say about its own extraction.
COMMENTARY = r"(?i)\bno (captions?|transcripts?|ocr)\b|this video discusses|this post is about|only the caption was available"
#: Serialized characters of the segments that one model call takes.
GROUP_CHARS = 12_000


def plain(text: Column) -> Column:
    """Words of a text in lower case, one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", " "))


def says(text: Column, name: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), plain(text), F.lit(" ")), F.concat(F.lit(" "), plain(name), F.lit(" ")))


def repaired_title(title: Column) -> Column:
    """A title within its bound, cut between words, without trailing punctuation."""
    one = F.trim(F.regexp_replace(title, r"\s+", " "))
    head = F.substring(one, 1, TITLE_LENGTH)
    whole = F.when((F.substring(one, TITLE_LENGTH + 1, 1) != " ") & F.contains(head, F.lit(" ")), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.char_length(one) <= TITLE_LENGTH, one).otherwise(F.regexp_replace(whole, r"[ ,;:\-–—]+$", ""))


def broken_rules(tags: Column, phrases: Column, points: Column, names: Column, segments: Column, written: Column, level: Column, confidence: Column, missing: Column, intent: Column, prose: Column) -> Column:
    """All rules that a brief breaks, in the order in which they are looked at; a rule that a null keeps open is not broken.

    points: array of (point, segment_ids); segments: array of (id, text). Named entities need a written source, as speech
    recognition mishears names; points must not copy a sentence of three words or more.
    """
    ids = F.transform(segments, lambda s: s["id"])
    sentences = F.flatten(F.transform(segments, lambda s: F.transform(F.split(s["text"], r"[.!?]+"), plain)))
    full = level == "full_transcript"
    bad_citation = F.exists(points, lambda p: (full & (F.size(p["segment_ids"]) <= 0)) | (F.size(F.array_except(p["segment_ids"], ids)) > 0))
    copied = F.exists(points, lambda p: (F.size(F.split(plain(p["point"]), " ")) >= 3) & F.array_contains(sentences, plain(p["point"])))
    rules = {
        "tag_count": ~F.size(tags).between(*TAGS),
        "schema": ~F.size(phrases).between(*PHRASES),
        "timestamp": bad_citation,
        "unsupported_name": F.exists(names, lambda n: ~says(written, n)),
        "copied_transcript": copied,
        "grounding": prose.rlike(COMMENTARY) | (intent.isNotNull() & ~intent.rlike(HEDGES)) | (~full & ((confidence == "high") | F.coalesce(missing == "", F.lit(True)))),
    }
    return F.array_compact(F.array(*(F.when(broken, code) for code, broken in rules.items())))


def rejection(*brief: Column) -> Column:
    """Why a brief is rejected, the first rule that fails, or null; arguments as ``broken_rules`` takes them."""
    return F.get(broken_rules(*brief), F.lit(0))


def array_text(values: Column, separator: str) -> Column:
    """Elements joined; null for a null array or a null element, empty for an empty array."""
    return F.when(~F.exists(values, lambda x: x.isNull()), F.array_join(values, separator))


def segment_groups(segments: Column, most: int = GROUP_CHARS) -> Column:
    """Group number of each segment (text): filled in order up to ``most`` characters, never split here."""
    start = F.struct(F.lit(0).alias("group"), F.lit(2).alias("size"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, segment: Column) -> Column:
        length = F.char_length(segment)
        over = (F.size(acc["out"]) > 0) & (acc["size"] + length > most)
        group = acc["group"] + F.when(over, 1).otherwise(0)
        return F.struct(group.alias("group"), (F.when(over, 2).otherwise(acc["size"]) + length + 2).alias("size"), F.concat(acc["out"], F.array(group)).alias("out"))

    return F.aggregate(segments, start, add)["out"]


def flatten_json(text: str | None) -> str:
    """Every leaf's key path and value, in order."""
    try:
        value = json.loads(text or "null")
    except ValueError:
        return ""
    out, rest = [], [("", value)]
    while rest:
        path, value = rest.pop()
        if isinstance(value, dict):
            rest += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            rest += [(path, v) for v in reversed(value)]
        elif value is not None:
            out += [path, str(value)]
    return " ".join(x for x in out if x)


@F.pandas_udf(T.StringType())
def flattened(texts: pd.Series) -> pd.Series:
    return texts.map(flatten_json)


def tolerant_object(text: str | None) -> str | None:
    """The JSON object in a model's answer, or null: within prose or fences, encoded twice, or cut off.

    The first object that says anything counts; braces that open no object are prose. One that the text ends within is
    closed where it stands, else after its last whole part.
    """
    body, empty = text or "", None
    while body.lstrip().startswith('"'):
        try:
            inner = json.loads(body)
        except (ValueError, RecursionError):
            break
        if not isinstance(inner, str) or inner == body:
            return None
        body = inner
    decoder, at = json.JSONDecoder(), 0
    while found := _OBJECT.search(body, at):
        at = found.start()
        try:
            value, end = decoder.raw_decode(body, at)
        except RecursionError:
            return None
        except ValueError:
            value, end = _closed(body, at), at + 1
        if value:
            return json.dumps(value, ensure_ascii=False)
        if value is not None:
            empty = "{}"
        at = end
    return empty


_OBJECT = re.compile(r'\{\s*["}]')
_STEP = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}\[\],]', re.S)


def _closed(body: str, start: int) -> dict | None:
    """The object from ``start`` on if the text ends within it, else None."""
    closers, whole, quote = [], None, ""
    for step in _STEP.finditer(body, start):
        sign = step.group()
        if sign[0] == '"':
            quote = "" if _STRING.fullmatch(sign) else '"'
        elif sign in "{[":
            closers.append("}" if sign == "{" else "]")
            whole = (step.end(), "".join(reversed(closers)))
        elif sign == ",":
            whole = (step.start(), "".join(reversed(closers)))
        elif not closers or closers.pop() != sign or not closers:
            return None
    ends = "".join(reversed(closers))
    rest = body[start:].rstrip()
    half = bool(quote) and (len(rest) - len(rest.rstrip("\\"))) % 2 == 1  # an escape that lacks its second character
    for piece in (rest[: len(rest) - half] + quote + ends, body[start : whole[0]] + whole[1]):
        try:
            value = json.loads(piece)
        except (ValueError, RecursionError):
            continue
        return value if isinstance(value, dict) else None
    return None


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


@F.pandas_udf(T.StringType())
def json_object(texts: pd.Series) -> pd.Series:
    return texts.map(tolerant_object)


def reminder_slots(local: Column) -> Column:
    """Offered times (label, at) in local seconds: this evening if over an hour away, the next morning, Saturday."""
    day = F.floor(local / 86_400) * 86_400
    hour = F.floor((local - day) / 3600)
    ahead = F.pmod(F.lit(5) - F.weekday(F.timestamp_seconds(local)), F.lit(7))
    slot = lambda label, at: F.struct(label.alias("label"), at.cast("long").alias("at"))
    evening = F.when(day + 19 * 3600 - local > 3600, F.array(slot(F.lit("This evening"), day + 19 * 3600))).otherwise(F.array().cast("array<struct<label:string,at:bigint>>"))
    morning = slot(F.when(hour < 5, "Today").otherwise("Tomorrow"), day + F.when(hour < 5, 0).otherwise(86_400) + 9 * 3600)
    saturday = slot(F.when(ahead == 0, "Next Saturday").otherwise("Saturday"), day + F.when(ahead == 0, 7).otherwise(ahead) * 86_400 + 10 * 3600)
    return F.concat(evening, F.array(morning, saturday))
