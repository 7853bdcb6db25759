"""The quality model is counted, weighted and met by the corpus in parts, so it never lies on disk as a whole."""

import random

from lodestone.llm import common, quality


def test_parts_are_there_one_after_another_and_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    speak = lambda: " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(60)))
    texts = [speak() for _ in range(60)]
    sample = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:30])], "__id long, text string")
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate([*texts, *texts[:3], "", None])], "__id long, __lang string, text string")
    scores = lambda: sorted((r["__id"], r["__n"], r["__log"], r["__odds"]) for r in quality.perplexities(docs, quality.train(sample), hot=20).collect())
    whole = scores()
    monkeypatch.setattr(quality, "PART_BYTES", 2_000)
    assert 1 < quality.train(sample)[0].number <= quality.PARTS
    there, met = [], quality._met

    def counted(*args):
        there.append(sum("weight" in f.columns and "key" in f.columns for f in common._folders))
        return met(*args)

    before = sum("weight" in f.columns and "key" in f.columns for f in common._folders)
    monkeypatch.setattr(quality, "_met", counted)
    assert scores() == whole
    assert len(there) > 1 and set(there) == {before + 1}
