"""The quality model is fitted on all labelled documents but the held-out half."""

import random

from lodestone.llm import quality


def tables(spark, n=80):
    rng = random.Random(4)
    fluent = [f"word{i}" for i in range(60)]
    text = lambda i: " ".join(rng.choice(fluent) for _ in range(40)) + (" " + " ".join(f"slur{x}" for x in rng.sample("abcdefgh", 4)) if i % 4 == 0 else "")
    docs = spark.createDataFrame([(i, text(i), "en") for i in range(n)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


def test_all_but_the_held_out_half_is_fitted_on(spark, monkeypatch):
    docs, labels = tables(spark)
    for name in ("SAMPLE", "SAMPLE_ALL", "SAMPLE_WORDS", "SAMPLE_ALL_WORDS", "LONGEST"):
        monkeypatch.setattr(quality, name, 5)
    fitted, real = [], quality.train
    monkeypatch.setattr(quality, "train", lambda sample: (fitted.extend(r.text for r in sample.collect()), real(sample))[1])
    quality.classify(docs, labels)
    half = labels.where("toxic = 0").selectExpr("doc_id as __id").where(quality._fitted_on())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(fitted) == sorted(texts[r["__id"]] for r in half.collect()) and len(fitted) > 20


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    docs, _ = tables(spark)
    weights = lambda: sorted(tuple(r) for table in quality.train(docs)[0] for r in table.collect())
    whole = weights()
    monkeypatch.setattr(quality, "PIECE", 50)
    assert weights() == whole


def test_words_beyond_the_broadcast_count_alike(spark, monkeypatch):
    docs, labels = tables(spark)
    monkeypatch.setattr(quality, "LEAST_REFUSED", 2)
    verdicts = lambda: sorted(map(tuple, quality.classify(docs, labels).collect()))
    whole = verdicts()
    assert any(r[6] for r in whole)
    monkeypatch.setattr(quality, "AGAINST", 3)
    assert verdicts() == whole
