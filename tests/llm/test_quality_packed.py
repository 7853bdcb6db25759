"""The model's n-grams and the keys of texts are shuffled and joined in arrays, a row for many of them."""

import random

from lodestone.llm import quality


def test_many_ngrams_are_a_row(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(400)) for _ in range(60)]
    parts, _ = quality.train(spark.createDataFrame(list(enumerate(texts)), "__id long, text string"))
    rows = [r for table in parts for r in table.collect()]
    trigrams = {t for text in texts for words in [["<", "<", *text.split()]] for t in zip(words, words[1:], words[2:], strict=False)}
    assert len(rows) < len(trigrams) / 5
    assert all(len(r.key) == 2 * len(r.weight) == 4 * len(r.seen) for r in rows)
    assert sum(len(r.key) // 8 for r in rows) > len(trigrams)


def test_sums_handed_on_early_and_equal_texts_count_alike(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(60))) for _ in range(50)]
    sample = spark.createDataFrame(list(enumerate(texts[:25])), "__id long, text string")
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate([*texts, *texts[:9]])], "__id long, __lang string, text string")
    scores = lambda: {r["__id"]: (r["__n"], r["__log"]) for r in quality.perplexities(docs, quality.train(sample), hot=0).collect()}
    whole = scores()
    assert len(whole) == 59 and all(whole[i] == whole[50 + i] for i in range(9))
    monkeypatch.setattr(quality, "SUMS_BYTES", 100)
    assert scores() == whole


def test_tokens_of_words_are_those_of_texts():
    words = ["Slur!!", "fine", "x1y", "ΑΣ", "ΑΣ.Σ", "a\u3000b", "é--é", "!!", "12", "²ab", "_a_b", "İx", "\x1cq", "e\u0301x"]
    rng = random.Random(13)
    for text in (None, *(" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(300))):
        assert quality._kinds(text) == set(quality.TOKEN.findall((text or "").lower()))
