"""What round 4 found: texts without words, short passages, shares taken at size."""

import hashlib
import re

import duckdb

from lodestone import session
from lodestone.operators import saves as operators
from lodestone.plans import briefs, retrieval, saves, search


def documents(spark, folder, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_a_save_without_words_has_too_few_tags(spark, tmp_path):
    blank = ["", " ", "\n\n \n", "\t"]
    folder = documents(spark, tmp_path, [*enumerate([t for t in blank for _ in range(7)], 1), (99, None)])
    found = {r.id: r.code for r in briefs.QUERIES["brief_validation"](spark, folder).collect()}
    assert len(found) == 29 and {code for i, code in found.items() if i != 99} == {"tag_count"}


def test_passages_of_any_length_have_their_documents(spark, tmp_path):
    texts = ["the seamless bread is baked", "less breadth; (whole) day", "seamless Bread", "no... such", "", "ab", "x (AS.B)", "less bread", None, "the long passage, baked daily, stands here"] + ["bread and day"] * 60
    passages = ["less bread", "bread", "less", " ", "...", "", "(whole)", "whole", "s B", "(AS.", "ab", "long passage, baked daily", "long passage, baked", "day, never, said", "bread", None, "d"]
    folder = documents(spark, tmp_path, enumerate(texts))
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    held = {(q, i) for q, p in enumerate(passages) for i, t in enumerate(texts) if p is not None and t is not None and p in t}
    found = [tuple(r) for r in search.gold_documents(spark, folder).collect()]
    assert len(found) == len(set(found)) and set(found) == held

    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet/*.parquet'")
    for query, sql in ((retrieval.QUERIES["fixture_report"], retrieval.SQL["fixture_report"]), (search.QUERIES["recall_and_mrr"], search.SQL["recall_and_mrr"])):
        assert [tuple(map(str, r)) for r in query(spark, folder).collect()] == [tuple(map(str, r)) for r in connection.execute(sql).fetchall()]


def test_a_passage_is_found_as_it_is_written(spark, tmp_path):
    folder = documents(spark, tmp_path, [(1, "x (ΑΣ.Β)"), (2, "x (ας.β)")])  # in lower case the sigma depends on what follows
    spark.createDataFrame([(1, "(ΑΣ."), (2, "x (Α"), (3, "(ας.β")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert sorted(map(tuple, search.gold_documents(spark, folder).collect())) == [(1, 1), (2, 1), (3, 2)]


def test_shares_are_dealt_by_user_once(spark, data):
    df = saves.QUERIES["shares_taken"](spark, data)
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())
    assert dealt.count("user_id") == 1 and len(dealt) <= 3  # the others: lines and parts where they meet


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    kept = session.stored(spark.range(1000).repartition(4, "id"))
    assert not shuffled() - before and spark.conf.get(setting, None) == was
    assert kept.count() == 1000


def test_redemptions_and_saves_of_one_kind_count_as_one(spark):
    facts = [
        # user 1 took share 7 with saves 4 and 5, the first of which stands: again; saves 4 and 9 of url a are one
        (1, 7, "a", True, True, 10, True, 5, 50, None, None), (1, 7, "a", True, True, 11, True, 4, 60, None, None), (1, None, "a", None, None, None, None, None, None, 4, None), (1, None, "a", None, None, None, None, None, None, 9, None),
        # user 2 has one deleted save of url a: restored, then existing; a dead share is gone, one without redemption is created
        (2, 7, "a", True, True, 12, None, None, None, 20, 3), (2, 8, "a", True, True, 13, None, None, None, 21, None), (2, 9, "b", False, True, 14, None, None, None, None, None), (2, 6, "c", True, True, 15, None, None, None, None, None),
        # a redemption whose save is another user's is none that the user still has
        (3, 6, "c", True, True, 16, True, 4, 60, None, None),
    ]
    schema = "user_id long, token_hash long, url string, live boolean, asks boolean, ask_id long, took boolean, took_id long, took_s long, own_id long, deleted_s long"
    found = {r.ask_id: (r.outcome, r.item_id) for r in operators.settle(spark.createDataFrame(facts, schema), 100_000).collect()}
    made = lambda user, share: hashlib.md5(f"share|{user}|{share}".encode()).hexdigest()
    assert found == {10: ("again", "4"), 11: ("again", "4"), 12: ("restored", "20"), 13: ("existing", "20"), 14: ("gone", None), 15: ("created", made(2, 6)), 16: ("created", made(3, 6))}
