"""Measures of briefs against plain versions."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from lodestone.operators import evaluate

KINDS = ("general", "recipe", "list")


def plain_groundedness(statements, body, label):
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t or "").casefold() if not unicodedata.combining(c))
    stem = lambda w: next((w[: -len(s)] for s in ("ings", "ing", "ies", "ied", "ed", "es", "s") if w.endswith(s) and len(w) - len(s) >= 4), w)
    words = lambda t: re.findall(evaluate.WORD, fold(t))
    squeeze = lambda t: re.sub(r"\s+", "", fold(t))
    stems, checked, bad = {stem(w) for w in words(body)}, 0, []
    for s in statements or []:
        s = (s or "").strip()
        own = [stem(w) for w in words(s) if w not in evaluate.SILENT]
        if squeeze(s) and squeeze(s) in squeeze(body):
            checked += 1
        elif len(own) >= 3:
            checked += 1
            if sum(w in stems for w in own) / len(own) < 0.6:
                bad.append(s)
    if label is not None:
        checked += 1
        bad += [] if label in KINDS else [f"content_type {label}"]
    return checked, checked - len(bad), bad, round((checked - len(bad)) / checked, 6) if checked else 1.0


def test_groundedness_equals_plain(spark):
    rng = random.Random(1)
    vocabulary = ["lentil", "lentils", "cooking", "cooked", "Café", "the", "of", "a", "berries", "日本語", "テスト", "naïve", "walks", "ΑΣ", "soup", "it's", "Straße", "red", "stories", "one"]
    text = lambda n: rng.choice([" ", "  ", "\n"]).join(rng.choices(vocabulary, k=n))
    rows = [(i, [text(rng.randrange(7)) for _ in range(rng.randrange(5))], text(rng.randrange(30)), rng.choice([None, "recipe", "poem"])) for i in range(200)]
    rows += [(900, None, None, None), (901, [None, "", "  "], "body", None), (902, ["日 本 語"], "日本語です", None), (903, ["cafe was cooked by walks"], "Cafés cooking walk", "list")]
    frame = spark.createDataFrame(rows, "i long, said array<string>, body string, label string")
    found = {r.i: (r.checked, r.supported, r.unsupported, r.score) for r in evaluate.groundedness(frame, "i", "said", "body", "label", KINDS).collect()}
    assert found == {i: plain_groundedness(s, b, k) for i, s, b, k in rows}
    assert {x[1] < x[0] for x in found.values()} == {True, False}


def test_usefulness_and_extraction(spark):
    rows = [(1, "o", "t", ["h"], ["x"], "recipe", "article", None, None, ["steps"]), (2, " ", None, [], None, None, "video", ["0:01"], [], None), (3, "o", "t", ["h"], ["x"], "list", "video", ["0:01"], ["i"], ["steps", "items"])]
    frame = spark.createDataFrame(rows, "i long, overview string, title string, highlights array<string>, topics array<string>, content_type string, kind string, timestamps array<string>, items array<string>, keys array<string>")
    columns = [F.col(c) for c in ("overview", "title", "highlights", "topics", "content_type", "kind", "timestamps", "items", "keys")]
    found = {r.i: r.u for r in frame.select("i", evaluate.usefulness(*columns, required=("steps",)).alias("u")).collect()}
    assert found[1].score == 1.0 and len(found[1].checks) == 6 and found[3].score == 1.0 and len(found[3].checks) == 8
    assert found[2].score == round(1 / 8, 6) and found[2].checks["has_timestamps"] and not found[2].checks["has_steps"]
    right = {r.i: r.x for r in frame.select("i", evaluate.extracted_rightly(F.col("content_type"), F.lit("recipe"), F.col("keys"), F.array(F.lit("steps"))).alias("x")).collect()}
    assert right == {1: True, 2: False, 3: False}
    assert frame.where("i = 2").select(evaluate.extracted_rightly(F.col("content_type"), F.lit("general"), F.col("keys"), F.array().cast("array<string>"))).first()[0]
