"""Decontamination, the quality classifier, SimHash groups, suffix arrays, mixing and the pipeline against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontamination, graph, mixing, quality, simhash, suffixes


def frame(spark, rows, schema="doc_id long, text string, source string, lang string"):
    return spark.createDataFrame(rows, schema).withColumn("size", F.lit("clash")).withColumn("fp", F.lit("clash")).withColumn("start", F.lit(0))


def words(rng, n, kinds=4000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


# -- decontamination ---------------------------------------------------------


def edited(rng, item, share):
    out = []
    for w in item:
        x = rng.random()
        out += [] if x < share / 3 else [f"new{rng.randrange(99)}"] if x < 2 * share / 3 else [w, "more"] if x < share else [w]
    return out


def plain_alignment(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_plain():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        assert decontamination.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == plain_alignment(a, b)


def test_points_are_never_above_their_bound():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        assert plain_alignment(a, b) <= decontamination.most_points(np.array(a, np.uint64), np.array(b, np.uint64))


@pytest.mark.parametrize("copies", [11, 1000])
def test_equal_edited_copies_are_found_however_many_there_are(spark, copies):
    rng = random.Random(5)
    item = [f"item{i}" for i in range(37)]
    edit = " ".join("other" if i % 4 == 3 else w for i, w in enumerate(item))
    texts = [edit] * copies + [" ".join(words(rng, 60)) for _ in range(50)]
    docs = frame(spark, [(i, t, "s", "en") for i, t in enumerate(texts)])
    found = decontamination.find_leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    rows = found.collect()
    assert {r.doc_id for r in rows} == set(range(copies)) and len(rows) == copies
    assert {round(r.score, 3) for r in rows} == {round((2 * 28 - 9) / 74, 3)}


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_leaks_are_found_and_clean_documents_left_alone(spark, block_words):
    rng = random.Random(4)
    items = [words(rng, 30) for _ in range(8)] + [words(rng, 2)]
    texts, leaked = [], set()
    for i in range(60):
        before, after = words(rng, rng.randrange(80)), words(rng, rng.randrange(80))
        if i % 3 == 0:
            item = i // 3 % 8
            copy = items[item] if i % 2 else edited(rng, items[item], 0.2)
            before += [w.upper() + "," for w in copy]
            leaked.add((i, item))
        texts.append(" ".join(before + after))
    docs = frame(spark, [(i, t, "s", "en") for i, t in enumerate(texts)] + [(100, None, "s", "en"), (101, "", None, None), (None, texts[0], "s", "en"), (0, texts[0], "s", "en")])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, ""), (0, " ".join(items[0])), (None, "x")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = decontamination.find_leaks(docs, benchmark, block_words=block_words).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id is not None} == leaked
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})
    exact = next(r for r in found if (r.doc_id, r.item_id) == (3, 1))
    assert exact.score == 1 and texts[3].lower().replace(",", "").split()[exact.start_word : exact.end_word] == items[1]
    kept = decontamination.drop_leaks(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i in range(60) if i % 3} | {100, 101, None} and kept.columns == docs.columns
    assert decontamination.find_leaks(docs.where("false"), benchmark).count() == 0
    assert decontamination.find_leaks(docs, benchmark.where("false")).count() == 0


def test_items_without_an_id_are_sought(spark):
    rng = random.Random(14)
    items = [words(rng, 20) for _ in range(3)]
    docs = frame(spark, [(i, " ".join(words(rng, 30) + (items[i] if i < 3 else []) + words(rng, 9)), "s", "en") for i in range(6)])
    benchmark = spark.createDataFrame([(None, " ".join(items[0])), (None, " ".join(items[1])), (7, " ".join(items[2])), (None, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.score) for r in decontamination.find_leaks(docs, benchmark).collect()}
    assert found == {(0, None, 1.0), (1, None, 1.0), (2, 7, 1.0)}
    assert {r.doc_id for r in decontamination.drop_leaks(docs, benchmark).collect()} == {3, 4, 5}


def test_leaks_equal_all_pairs_aligned(spark):
    rng = random.Random(12)
    items = [words(rng, rng.randrange(4, 30), 300) for _ in range(7)]
    texts = [words(rng, rng.randrange(60), 300) + (edited(rng, items[i % 7], rng.random() * 0.4) if i % 2 else []) + words(rng, rng.randrange(40), 300) for i in range(70)]
    expected, shared = set(), set()
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            if plain_alignment(item, text) >= len(item):
                expected.add((i, j))
                if {tuple(item[a : a + 3]) for a in range(len(item) - 2)} & {tuple(text[a : a + 3]) for a in range(len(text) - 2)}:
                    shared.add((i, j))
    docs = frame(spark, [(i, " ".join(t), "s", "en") for i, t in enumerate(texts)])
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")).collect()}
    assert shared == found <= expected and len(found) >= 0.9 * len(expected)


def test_stock_phrases_lead_to_no_item_but_their_copies_are_found():
    rng = random.Random(13)
    stock = words(rng, 8)
    items = [[*words(rng, 12), *stock, *words(rng, 8)] for _ in range(500)] + [[*stock, f"own{i}"] for i in range(20)]
    block = decontamination._Items(list(range(520)), [" ".join(i) for i in items])
    other = lambda: [f"t{rng.randrange(4000)}" for _ in range(20)]
    texts = [" ".join([*other(), *stock, *other()]).encode() for _ in range(50)]
    frequency = np.full(len(block.grams), 50)
    search = decontamination._Search(block, frequency, 0.5)
    assert {x[1] for x in search.places(list(range(50)), texts)} <= set(range(500, 520))
    assert {x[:2] for x in search.leaks(list(range(50)), texts)} == {(i, j) for i in range(50) for j in range(500, 520)}
    assert {x[1] for x in search.leaks([0], [" ".join(items[77]).encode()])} >= {77}


# -- quality -----------------------------------------------------------------


def plain_kneser_ney(texts):
    """The log-probability of a text by the interpolated modified Kneser-Ney formulas, on tuples of words."""
    grams = Counter(tuple(padded[i - 2 : i + 1]) for t in texts for padded in [["<s>", "<s>", *t.split()]] for i in range(2, len(padded)))
    levels = {3: grams}
    for n in (2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discounts, totals, held = {}, {}, {}
    for n, level in levels.items():
        n1, n2, n3, n4 = (sum(c == k for c in level.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts[n] = [0.5] * 3 if not (n1 and n2 and n3) else [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        for g, c in level.items():
            totals[g[:-1]] = totals.get(g[:-1], 0) + c
            held[g[:-1]] = held.get(g[:-1], 0) + discounts[n][min(c, 3) - 1]

    def probability(gram):
        if not gram:
            return 1 / (len(levels[1]) + 1)
        lower, context = probability(gram[1:]), gram[:-1]
        if context not in totals:
            return lower
        c = levels[len(gram)].get(gram, 0)
        return (max(c - discounts[len(gram)][min(c, 3) - 1], 0) if c else 0) / totals[context] + held[context] / totals[context] * lower

    def score(text):
        padded = ["<s>", "<s>", *text.split()]
        return sum(math.log(probability(tuple(padded[i - 2 : i + 1]))) for i in range(2, len(padded)))

    return score


@pytest.mark.parametrize(("hot", "bits", "piece"), [(1 << 17, 26, 1 << 20), (0, 12, 1 << 20), (7, 26, 40)])
def test_scores_equal_plain_kneser_ney(spark, monkeypatch, hot, bits, piece):
    monkeypatch.setattr(quality, "FILTER_BITS", bits)
    monkeypatch.setattr(quality, "PIECE", piece)
    monkeypatch.setattr(quality, "GROUP_BYTES", 500)
    rng = random.Random(0)
    speak = lambda n: " ".join(f"c{int(rng.paretovariate(0.7))}" for _ in range(n))
    sample = [speak(rng.randrange(40)) for _ in range(60)]
    texts = [*(speak(rng.randrange(60)) for _ in range(40)), *sample[:9], "", None, "é never seen", "c1", " c1\tc1  c2\n", "c1 " * 200]
    docs = spark.createDataFrame([(i if i != 3 else None, "en", t) for i, t in enumerate(texts)], "__id long, __lang string, text string")
    model = quality.train(spark.createDataFrame(list(enumerate(sample)), "__id long, text string"))
    found = quality.perplexities(docs, model, hot=hot).collect()
    score = plain_kneser_ney(sample)
    assert len(found) == len(texts)
    for r in found:
        text = texts[r["__id"] if r["__id"] is not None else 3] or ""
        assert r["__n"] == len(text.split())
        assert r["__log"] == pytest.approx(score(text), abs=1e-5 * (1 + r["__n"]))


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(3)
    kinds = {"en": [f"e{i}" for i in range(60)], "fr": [f"f{i}" for i in range(60)]}
    rows, labels = [], []
    for i in range(400):
        lang = "en" if i % 2 else "fr"
        junk = i % 10 == 0
        text = " ".join(f"{rng.randrange(10**9)}!!" for _ in range(60)) if junk else " ".join(rng.choices(kinds[lang], k=rng.randrange(1, 120)))
        rows.append((i, text, "s", lang))
        if i % 3:
            labels.append((i, int(not junk), 0))
    rows += [(900, None, "s", "en"), (901, "", "s", None), (None, rows[1][1], "s", "xx"), (1, rows[1][1], "s", "en")]
    label_table = spark.createDataFrame([*labels, (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int").withColumn("lang", F.lit("clash"))
    docs = frame(spark, rows)
    found = quality.classify(docs, label_table).collect()
    assert len(found) == len(rows)
    verdicts = {r.doc_id: r.keep for r in found}
    assert [i for i in range(0, 400, 10) if verdicts[i]] == []
    assert sum(not verdicts[i] for i in range(400) if i % 10) <= 4
    assert verdicts[900] and verdicts[901] and verdicts[None]
    kept = quality.keep_good(docs, label_table)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert all(r.keep for r in quality.classify(docs, label_table.where("false")).collect())
    assert quality.classify(docs.where("false"), label_table).count() == 0


def test_toxic_text_goes_on_held_out_labels(spark):
    rng = random.Random(6)
    kinds = {lang: ["".join(rng.choices("abcdefghijklm", k=7)) for _ in range(400)] for lang in ("en", "fr")}
    insults, rows, labels = ["vile", "rotten", "odious"], [], []
    for i in range(800):
        lang = "en" if i % 2 else "fr"
        text = rng.choices(kinds[lang], k=100)
        if i % 8 < 2:
            for _ in range(3):
                text[rng.randrange(100)] = rng.choice(insults)
        rows.append((i, " ".join(text), "s", lang))
        if i < 600:
            labels.append((i, 1, int(i % 8 < 2)))
    found = {r.doc_id: r.keep for r in quality.classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert not any(found[i] for i in range(600, 800) if i % 8 < 2)
    assert sum(not found[i] for i in range(600, 800) if i % 8 >= 2) <= 6


def test_a_language_without_labels_is_not_judged_by_others(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"e{j}" for j in range(60)], k=60)), "s", "en") for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choices([f"x{j}" for j in range(500)], k=60)), "s", "xx" if i < 100 else None) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    found = quality.classify(frame(spark, rows), labels).collect()
    assert sum(not r.keep for r in found if r.doc_id >= 1000) <= 4


def test_one_more_label_moves_a_threshold_little(spark):
    """Thresholds of a language with 0 to 60 held-out documents, of which the first 60 in each test are the same."""
    rng = random.Random(10)
    big = [("en", True, 8_000 + rng.randrange(200), rng.randrange(3)) for _ in range(200)] + [("en", False, 8_000 + rng.randrange(200), 0) for _ in range(200)]
    clean = [("de", 9_000 + rng.randrange(300), rng.randrange(2)) for _ in range(80)]
    junk = [("de", False, 11_000 + rng.randrange(100), 90) for _ in range(30)]
    found = {}
    for n in (0, 1, 18, 19, 20, 21, 22, 60):
        rows = big + junk + [(lang, i < n, step, odds) for i, (lang, step, odds) in enumerate(clean)]
        steps = spark.createDataFrame(rows, "lang string, trusted boolean, step long, tenths long")
        means = spark.createDataFrame([("en", 8.1), ("de", 9.2)], "lang string, mean double")
        found[n] = {r.lang: (r.threshold, r.odds_limit) for r in quality._thresholds(means, steps, 0.99, 0.25).collect()}
    assert len({x["en"] for x in found.values()}) <= 4
    for a, b in ((0, 1), (18, 19), (19, 20), (20, 21), (21, 22)):
        assert abs(found[a]["de"][0] - found[b]["de"][0]) < 0.02 and abs(found[a]["de"][1] - found[b]["de"][1]) <= 1
    assert all(9.3 < x["de"][0] < 9.8 and x["de"][1] < 40 for x in found.values())  # junk sets neither
    nothing = quality._thresholds(means, steps.withColumn("trusted", F.lit(False)), 0.99, 0.25)
    assert nothing.count() == 0 and set(nothing.columns) == {"lang", "mean", "threshold", "odds_limit"}


# -- near duplicates ---------------------------------------------------------


def plain_fingerprint(text):
    tokens = [w for w in text.encode().lower().split()]
    parts = [b" ".join(tokens[i : i + 4]) for i in range(max(1, len(tokens) - 3))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_groups_equal_brute_force(spark):
    rng = random.Random(8)
    texts = ["", None, " \t\n", "One word", "one WORD", "a b c", "Ä ä", "Ä Ä"]
    for _ in range(25):
        base = words(rng, rng.randrange(5, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("  ".join(copy))
    rows = [(i * 7 % 101, t, "s", "en") for i, t in enumerate(texts)] + [(3, texts[9], "s", "en"), (3, texts[9], "s", "en")]
    docs = frame(spark, rows)
    found = simhash.near_duplicates(docs).collect()
    prints = np.array([plain_fingerprint(t or "") for _, t, _, _ in rows], np.uint64)
    expected = Counter(zip([r[0] for r in rows], prints.view(np.int64).tolist(), plain_components(prints, [r[0] for r in rows]).tolist(), strict=True))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in found) == expected
    kept = simhash.keep_one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in expected}) and kept.columns == docs.columns
    nameless = frame(spark, [(None, t, "s", "en") for t in (texts[8], texts[8], "another text of five words", None)] + [(1, texts[8], "s", "en")])
    assert sorted(repr((r.doc_id, r.text)) for r in simhash.keep_one_of_each(nameless).collect()) == sorted(repr(x) for x in [(1, texts[8]), (None, "another text of five words"), (None, None)])
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_ball_links_connect_all_within_the_radius(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centres for k in (0, 0, 1, 2, 2, 3, 3, 4, 4, 5)]
    chain = [int(centres[0]) ^ ((1 << 4 * n) - 1) for n in range(1, 16)]
    distinct = np.array(sorted(set(prints + chain)), np.uint64)
    for count in (len(distinct), 10_000_000):  # more fingerprints give more buckets
        links = simhash.ball_links(spark.createDataFrame([(int(x),) for x in distinct.view(np.int64)], "fp long"), count)
        roots = {r.node: r.root for r in graph.connected_components(links).collect()}
        label = plain_components(distinct, distinct.view(np.int64).tolist())
        got = [roots.get(int(x), int(x)) for x in distinct.view(np.int64)]
        same = {}
        assert all(same.setdefault(a, b) == b for a, b in zip(label, got, strict=True)) and len(set(got)) == len(set(label))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (7, None)]
    found = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(50)}


# -- suffix arrays -----------------------------------------------------------


def plain_removal(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts(rng):
    passages = [" ".join(words(rng, 60)) for _ in range(3)]
    texts = []
    for i in range(50):
        parts = [" ".join(words(rng, rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += [p[cut:] if rng.random() < 0.5 else p, " ".join(words(rng, rng.randrange(20)))]
        texts.append(" ".join(parts))
    return [*texts, texts[0], texts[1] + "é", "", "short", "ab" * 300, "x" * 199, "y" * 200, "z" * 201]


@pytest.mark.parametrize(("shard_blocks", "piece"), [(4096, 4 << 20), (3, 4 << 20), (4096, 500)])
def test_repeats_equal_brute_force(spark, monkeypatch, shard_blocks, piece):
    monkeypatch.setattr(suffixes, "SHARD_BLOCKS", shard_blocks)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    texts = repeating_texts(random.Random(6))
    rows = [(i, t, "s", "en") for i, t in enumerate(texts)] + [(900, None, "s", "en"), (None, texts[3], "s", "en"), (5, texts[5], "s", "en")]
    found = suffixes.digest(suffixes.remove_repeats(frame(spark, rows))).collect()
    expected = plain_removal([(t or "").encode() for _, t, _, _ in rows], 200)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == Counter((row[0], *e) for row, e in zip(rows, expected, strict=True))


def test_equal_rows_stay_linear(spark):
    rng = random.Random(3)
    shared = " ".join(words(rng, 60))
    text = " ".join(words(rng, 40)) + shared + " ".join(words(rng, 40))
    rows = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(6, "x" + shared + "y"), (None, text)], "doc_id long, text string"))
    own = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    most = suffixes.gathered_ranges(suffixes.repeated_ranges(own)).agg(F.max(F.size("ranges"))).first()[0]
    assert most < len(text)
    found = suffixes.digest(suffixes.remove_repeats(rows)).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert {(r.doc_id, r.n_removed, r.n_spans, r["count"]) for r in found} == {(5, len(text), 1, 20_000), (None, len(text), 1, 1), (6, len(shared), 1, 1)}


def test_a_passage_of_very_many_surroundings_is_counted_by_shard(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BLOCKS", 20)
    rng = random.Random(4)
    shared = " ".join(words(rng, 70))
    texts = [f"{' '.join(words(rng, 9))} {shared} {' '.join(words(rng, 9))}" for _ in range(300)]
    found = suffixes.digest(suffixes.remove_repeats(frame(spark, [(i, t, "s", "en") for i, t in enumerate(texts)]))).collect()
    expected = plain_removal([t.encode() for t in texts], 200)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == Counter((i, *e) for i, e in enumerate(expected))


def test_blocks_that_differ_differ_in_the_check():
    """Texts on which a polynomial hash modulo 2^64 collides for any odd base: the Thue-Morse word and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    a, b = (np.frombuffer(bytes(97 + (x ^ flip) for x in bits), np.uint8) for flip in (0, 1))
    hashes = [suffixes.span_keys(x, np.array([0]), np.array([2048])) for x in (a, b)]
    assert hashes[0][0] == hashes[1][0] and hashes[0][1] != hashes[1][1]


def test_suffix_array_and_prefixes_equal_plain():
    rng = random.Random(9)
    for _ in range(40):
        blocks = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        text = b"".join(blocks)
        order = suffixes.suffix_array(np.frombuffer(text, np.uint8))
        assert list(order) == sorted(range(len(text)), key=lambda i: text[i:])
        seen = Counter(b[i : i + 7] for b in blocks for i in range(len(b) - 6))
        assert [x.tolist() for x in suffixes.repeated_windows(blocks, 7)] == [[seen[b[i : i + 7]] > 1 for i in range(len(b) - 6)] for b in blocks]


def test_no_rows_no_repeats(spark):
    assert suffixes.remove_repeats(frame(spark, []).where("false")).count() == 0


# -- mixing ------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def test_mix(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "a", "b", "é", "Z", "tiny", None]) if i > 5 else "tiny"
        rows.append((i if i % 50 else None, " ".join(words(rng, int(rng.paretovariate(1.1) * 9) % 3000)) if source != "tiny" else "one", source, "en"))
    rows += [(5000, None, "b", "en"), (5001, "", "none", "en"), (8, rows[8][1], rows[8][2], "en")]
    docs = frame(spark, rows)
    found = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = plain_targets(sizes)
    assert len(found) == len(rows) and sum(targets.values()) == pytest.approx(sum(sizes.values()))
    taken = Counter()
    for r in found:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(30, 0.01 * t)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, found))
    assert mixing.mix(docs.where("false")).count() == 0


def test_rounding_keeps_expectations(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    rows = [(i, i, "s", 10 + i % 40, 0.3, "x") for i in range(200)]
    table = spark.createDataFrame(rows, "row_id long, doc_id long, source string, size long, p double, extra string").drop("extra")
    for seed in range(2):
        found = mixing.pivotal_rounding(table, seed, chunk=8).collect()
        assert len(found) == 200 and {r.p for r in found} <= {0.0, 1.0}
        assert abs(sum(rows[r.row_id][3] * r.p for r in found) - 0.3 * sum(r[3] for r in rows)) <= 15


def test_equal_rows_are_one_unit(spark, monkeypatch):
    most = []
    rows = spark.range(100_000, numPartitions=8).select(F.col("id").alias("row_id"), F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(7).cast("long").alias("size"), F.lit(0.37).alias("p"))
    rows = rows.withColumn("row_id", F.monotonically_increasing_id()).unionByName(spark.createDataFrame([(-1 - i, i, None, 3 + i, 0.5) for i in range(50)], "row_id long, doc_id long, source string, size long, p double"))
    real = mixing._round_units
    monkeypatch.setattr(mixing, "_round_units", lambda units, *a: (most.append(units.count()), real(units, *a))[1])
    found = mixing.pivotal_rounding(rows).collect()
    assert most == [51] and len(found) == len({r.row_id for r in found}) == 100_050
    taken = [r.p for r in found if r.row_id >= 0]
    assert set(taken) == {0.0, 1.0} and sum(taken) == 37_000
    assert abs(sum((3 - 1 - r.row_id) * r.p for r in found if r.row_id < 0) - sum(0.5 * (3 + i) for i in range(50))) <= 5


def test_residuals_of_many_chunks_meet_in_the_tree(spark):
    rows = spark.createDataFrame([(i, i, "s", 20 + i % 3, 0.37) for i in range(3_000)], "row_id long, doc_id long, source string, size long, p double")
    for chunk in (16, 1_024):  # all of one bin, in several levels
        found = mixing.pivotal_rounding(rows, chunk=chunk).collect()
        assert len(found) == 3_000 and {r.p for r in found} == {0.0, 1.0}
        assert abs(sum((20 + r.row_id % 3) * r.p for r in found) - sum((20 + i % 3) * 0.37 for i in range(3_000))) <= 22


# -- the pipeline ------------------------------------------------------------


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, data).cache()
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert kept.columns == docs.columns and after <= before, name
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, data)
    assert {r.doc_id for r in mixed.collect()} == after
    labels = spark.read.parquet(f"{data}/labels.parquet")
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    judged = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, data).select("doc_id").collect()}
    assert len(judged & junk) <= 0.4 * len(junk) and len(clean - judged) <= 0.03 * len(clean) + 1


def odd_tables(spark, folder):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 60)), "en", "a") for i in range(12)]
    rows += [(None, " ".join(words(rng, 50)), "en", "a"), (None, None, None, None), (20, None, "en", None), (21, "", None, "b"), (22, " \n ", "de", "b")]
    rows += [rows[3]] * 5 + [(30, rows[4][1], None, "b"), (31, " ".join(words(rng, 30_000)), "fr", "a"), (32, "x" * 50_000, "en", None)]
    rows += [(40 + i, f"the menu of this site\n{' '.join(words(rng, 40))}", "de", "b") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    for name in ("__id", "__bad_id", "__kept_id", "__KEY", "__site", "__known", "__n_lines", "__n_dropped", "size", "fp", "root", "page", "score"):
        docs = docs.withColumn(name, F.lit("clash"))
    item = rows[7][1]
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_the_pipeline_takes_odd_tables(spark, tmp_path):
    rows = odd_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        kept = out.collect()
        assert out.columns == docs.columns and all(r["__known"] == r["__n_lines"] == r["__bad_id"] == "clash" for r in kept), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        if name == "line dedup":
            assert len(kept) == len(rows) and not any("menu" in (r.text or "") for r in kept)
            assert {r.doc_id: r.text for r in kept if r.doc_id == 3} == {3: rows[3][1]}
        if name == "near duplicates":  # equal texts, and those without words, are one group each
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, x) for x in (*range(12), 20, 31, 32, *range(40, 46))] + [(True, 0)]
        if name == "decontamination":
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept} == {7}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(mixed) == len({r.doc_id for r in mixed}) and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in mixed)


def test_lines_of_a_language_are_counted_by_themselves(spark):
    rows = [(i, f"english {i}", "en", "hot") for i in range(200)] + [(300 + i, f"toute la une\nligne {i}", "fr", "hot") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert found == {i: t.removeprefix("toute la une\n") for i, t, _, _ in rows}


def test_sample_holds_whole_documents_within_its_bounds(spark, monkeypatch):
    texts = {i: "w " * (30 if i % 3 == 0 else 5) for i in range(40)}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "LONGEST", 20)
    monkeypatch.setattr(quality, "SAMPLE_WORDS", 22)
    sample, trusted = quality.trusted_sample(docs, labels)
    rows = sample.collect()
    assert 0 < len(rows) <= 4 and all(r.text == texts[r["__id"]] and len(r.text.split()) == 5 for r in rows)
    fit = {r["__id"]: r["__fit"] for r in trusted.collect()}
    assert len(fit) == 40 and {i for i, f in fit.items() if f} == {r["__id"] for r in rows}
