"""The filter audit, centroid clustering and BPE against plain versions, SQL and the library."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import audit, bpe, centroids, registry

# -- filter audit ------------------------------------------------------------


def plain_audit(docs, labels):
    """Applies the filters of every order to rows (doc_id, text, lang) one after another."""
    split = lambda t: [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
    rows = []
    for doc_id, text, lang in docs:
        text, fails = text or "", set()
        w = split(text)
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
        fails |= {"D"} if set("#$%&*|") & set(text) else set()
        fails |= {"E"} if doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _ in docs) else set()
        good = doc_id is not None and any(i == doc_id and q == 1 for i, q, _ in labels)
        toxic = doc_id is not None and any(i == doc_id and x == 1 for i, _, x in labels)
        rows.append((lang or "", fails, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in gone)
                alone = sum(r[1] == {f} for r in rows if r[0] == part)
                out[part, "".join(order), step] = [f, len(left), len(lost), redundant, alone, sum(r[2] for r in lost), sum(r[3] for r in lost)]
                gone += lost
                shapley[f] += len(lost)
        for key, value in out.items():
            if key[0] == part:
                value.append(shapley[value[0]])
    return {k: tuple(v) for k, v in out.items()}


def audited(frame):
    rows = frame.collect()
    found = {(r.part, r.filter_order, r.step): (r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_equals_applying_filters(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Word", "b", "c#", "d\t\te", "é", *(f"w{k}" for k in range(900))]) for _ in range(n)) for n in (0, 3, 150, 199, 200, 201, 400, 800)]
    texts += ["A" * 3 + "a" * 97, "A" * 4 + "a" * 96, "x " * 300, "x|", "Ω" * 10, "  \n ", None, "w" * 40_000]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [docs[7], docs[7], (None, texts[3], "en"), (None, texts[3], "en"), (None, "only here", "fr"), (900, "only here", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    for name in ("part", "A", "same", "good", "words", "first", "n"):
        frame = frame.withColumn(name, F.lit("clash"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1)).withColumn("E", F.lit(1))
    assert audited(audit.filter_audit(frame, table)) == plain_audit(docs, labels)
    assert audit.filter_audit(frame.where("false"), table).count() == 0
    assert audited(audit.filter_audit(frame, table.where("false"))) == plain_audit(docs, [])


def test_orders_follow_from_counts_of_any_filters(spark):
    rng = random.Random(4)
    rows = [("p", *(rng.randrange(2) for _ in range(3)), 1, 0) for _ in range(60)]
    flags = spark.createDataFrame(rows, "part string, X int, Y int, Z int, good int, toxic int")
    counts = audit.joint_failures(flags, "XYZ", {"all": None, "good": "good", "toxic": "toxic"})
    found = audit.audit(counts, "XYZ").collect()
    assert len(found) == 18
    for r in found:
        place = {n: i for i, n in enumerate("XYZ", 1)}
        before = [place[f] for f in r.filter_order[: r.step - 1]]
        removed = [row for row in rows if row[place[r["filter"]]] and not any(row[i] for i in before)]
        assert (r.removed, r.good_lost, r.toxic_lost) == (len(removed), len(removed), 0)
    for f in "XYZ":
        assert {r.shapley for r in found if r["filter"] == f} == {sum(r.removed for r in found if r["filter"] == f)}


def same_as_sql(name, spark, data, duck):
    columns = sorted(registry.queries()[name](spark, data).columns)
    result = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    found = registry.queries()[name](spark, data).select(columns).collect()
    assert sorted(map(tuple, found)) == sorted(result) and found


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_centroids"])
def test_queries_equal_sql(name, spark, data, duck):
    same_as_sql(name, spark, data, duck)


# -- centroid clustering -----------------------------------------------------


def plain_clusters(rows, k, rounds):
    """(id, cluster, distance) and centroids by Lloyd's rounds over every row (id, whole numbers)."""
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    centres = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in rows]
        for n in range(len(centres)):
            some = [v for (_, v), m in zip(rows, mine, strict=True) if m == n]
            if some:
                centres[n] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in rows], centres


def test_clusters_equal_plain_rounds(spark):
    rng = random.Random(5)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(3)] for i in range(300)}
    vectors |= {1000 + i: [0.5, -0.25, 0.125] for i in range(400)} | {2000: [1e5, 0.0, 0.0], 2001: [-1.0, 0.0, 0.0]}
    rows = [(i, v) for i, v in vectors.items()] + [(7, vectors[7])] * 3 + [(None, [0.1, 0.2, 0.3])]
    odd = [(3000, [1.0, 2.0]), (3001, None), (3002, [1.0, None, 2.0]), (3003, [1.0, float("nan"), 2.0]), (3004, [1.0, float("inf"), 2.0]), (3005, []), (3006, [1.0] * 4)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(6)
    for name in ("__id", "__vector", "n", "vector", "cluster", "__of"):
        frame = frame.withColumn(name, F.lit("clash"))
    found, table = centroids.cluster(frame, k=5, rounds=4, dimensions=3)
    expected, centres = plain_clusters([(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows], 5, 4)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r.vec_id, r["__cluster"], r["__distance"]) for r in found.collect()]
    assert sorted(got, key=key) == sorted(expected, key=key) and "__id" in found.columns
    facts = {r["__cluster"]: r for r in table.collect()}
    assert [facts[n]["__centroid"] for n in range(5)] == centres
    assert all(facts[n]["__inertia"] == sum(d for _, c, d in expected if c == n) and facts[n]["__all"] == sum(d for *_, d in expected) for n in range(5))


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    empty = centroids.cluster(spark.createDataFrame([], schema))
    assert centroids.digest(*empty).count() == 0 and empty[1].count() == 0
    one = centroids.digest(*centroids.cluster(spark.createDataFrame([(1, [0.25] * 64), (1, [0.25] * 64), (2, [0.5])], schema))).collect()
    text = ",".join(["256"] * 64)
    assert [tuple(r) for r in one] == [(1, 0, 0, 0, 0, hashlib.sha256(text.encode()).hexdigest())] * 2
    with pytest.raises(Exception, match="beyond"):
        centroids.digest(*centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema))).collect()


def test_weighted_sums_are_exact():
    weights, values = np.array([1 << 40, 3]), np.array([[1 << 30, -1], [5, 7]])
    assert centroids._weighted(weights, values).tolist() == [(1 << 70) + 15, -(1 << 40) + 21]


# -- BPE ---------------------------------------------------------------------

PATH = public_tokenizers.path(registry.WORD_TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Encoder(file.read())


def odd_texts():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield from (" ".join("".join(rng.choice(letters[:k]) for _ in range(rng.randrange(1, 40))) for _ in range(80)) for k in (1, 2, 3, 26, 26))
    ranges = ((1, 0x250), (0x20, 0x7F), (0x300, 0x3000), (0x3000, 0xD800), (0xE000, 0x1FBFF))
    yield from ("".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(300)) for _ in range(40))
    yield from ["", " ", "\x1c\x1f a\x1cb", "ΟΔΟΣ Σ aΣb İstanbul", "é é ﬁ", "it's DON'T we'll 'S", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|endof", "a" * 4001, "ab" * 3000, "!?" * 999, "word word x", "123 ４５ ½"]


def test_encoding_equals_the_library(encoder, library):
    texts = list(odd_texts())
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode(texts[::-1]) == encoder.encode(texts)[::-1]
    assert max(map(len, encoder.known)) <= bpe.LONGEST


def test_borders_that_pass_need_no_merging(encoder):
    """Words whose proposal passes every border are what exact merging gives, and others are not."""
    rng = random.Random(7)
    words = {"".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 14))) for _ in range(4000)}
    passed = 0
    for w in words:
        tokens = np.array(encoder.propose(w))
        good = bool(encoder.merges.compatible(tokens[:-1], tokens[1:]).all())
        assert good == (encoder.merges.exact(w) == tokens.tolist())
        passed += good
    assert 400 < passed < len(words)


def test_words_are_learned_anew_when_the_cache_is_full(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SIZE", 5)
    texts = ["one two three", "four five six seven", "one eight", "nine one two"]
    for t in texts:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_bpe_query_equals_the_library(spark, library, tmp_path):
    texts = [*odd_texts(), None, "same", "same", "word " * 30_000]
    docs = spark.createDataFrame([(i % 60, t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string")
    docs.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(0)).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.op13_bpe(spark, str(tmp_path)).collect()
    expected = []
    for i, t in [(i % 60, t) for i, t in enumerate(texts)] + [(None, "x")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    empty = bpe.encode(docs.where("false"), PATH)
    assert bpe.digest(bpe.decode(empty, PATH)).count() == 0


def test_decoding_follows_the_library(spark, library):
    pack = lambda ids: bytearray(np.array(ids, "<u4").tobytes())
    rows = [(1, pack([49406, 320, 49407])), (2, pack([320, 99_999, 1])), (3, None), (4, pack([]))]
    found = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), PATH).collect()}
    assert found == {1: library.decode([49406, 320, 49407], skip_special_tokens=False), 2: library.decode([320, 99_999, 1], skip_special_tokens=False), 3: None, 4: ""}


def test_other_tokenizers_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
