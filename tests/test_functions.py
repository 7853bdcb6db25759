"""Literal cases of the identity, text and time functions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import clock, identity, text
from lodestone.operators import captures, ranking


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("http://www.Example.com/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
        ("example.com", "https://example.com/"),
        ("https://example.com:8443/P/?q=&FBCLID=1", "https://example.com:8443/P?q="),
        ("https://youtu.be/abcdefghijk?t=4", "https://youtube.com/watch?v=abcdefghijk"),
        ("https://m.youtube.com/shorts/abcdefghijk", "https://youtube.com/watch?v=abcdefghijk"),
        ("https://youtube.com.evil.org/watch?v=abcdefghijk", "https://youtube.com.evil.org/watch?v=abcdefghijk"),
        ("http://[bad", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert parts(spark, url).canonical == expected


def parts(spark, url):
    return spark.createDataFrame([(url,)], "url string").select(identity.url_parts("url").alias("p")).first().p


def test_credentials_and_safety(spark):
    assert parts(spark, "https://a.org/?api_key=1").has_credentials and parts(spark, "https://u:p@a.org/").has_credentials
    assert not parts(spark, "https://a.org/?q=1").has_credentials
    safe = ["https://a.org/", "a.org", "http://8.8.8.8/", "http://a-b.example.com.:443/x", "http://[2606:4700::1111]/", "https://deadbeef.org"]
    unsafe = [
        "http://127.0.0.1/", "http://localhost/", "http://u:p@a.org/", "http://a.org:99/", "http://127.1/", "http://0x7f.0.0.1/", "http://2130706433/",
        "http://[::ffff:8.8.8.8]/", "http://[::1]/", "http://[fe80::1]/", "http://[2001:db8::1]/", "http://a_b.c/", "http://intranet/", "http://x.local/", "http://x.localhost./",
        "http://10.0.0.1/", "http://172.31.0.1/", "http://192.168.1.1/", "http://169.254.169.254/", "http://100.64.0.1/", "http://240.0.0.1/", "ftp://a.org/", "javascript://a.org/", "", None,
    ]
    rows = spark.createDataFrame([(u, True) for u in safe] + [(u, False) for u in unsafe], "url string, ok boolean")
    assert [r.url for r in rows.where(identity.url_parts("url")["safe"] != F.col("ok")).collect()] == []


def test_queries_are_put_in_one_form(spark):
    assert parts(spark, "http://a.org/x?b=%C3%A9+1&a=~*&c=%zz&b=2&e").canonical == "https://a.org/x?a=~%2A&b=2&b=%C3%A9+1&c=%25zz&e="
    assert parts(spark, "https://www.youtube.com/watch?list=1&v=abcdefghijk").platform_id == "youtube:abcdefghijk"
    assert parts(spark, "https://youtube.com/watch?v=short").platform_id is None
    assert parts(spark, "https://a.org:80").canonical == "https://a.org/"


def test_claims_fail_closed(spark):
    cases = {"true": True, "false": False, '"TRUE"': True, '" no "': False, '"unverified"': False, '"2026-01-01T00:00:00Z"': True, "1": False, "null": False, "{}": False, '""': False, None: False}
    rows = spark.createDataFrame([(c, v) for c, v in cases.items()], "claim string, v boolean")
    assert rows.where(identity.email_verified(F.col("claim")) != F.col("v")).count() == 0


def test_logins_reach_one_account(spark):
    logins = [(1, "s1", "a", "false"), (2, "new", "legacy", "false"), (3, "new", "legacy", "true"), (4, "other", "legacy", "true"), (5, "s9", "a", "true"), (6, "n1", "fresh", None), (7, "n2", "fresh", "true"), (8, "n1", "fresh", None), (9, "gone", "x", "true"), (10, None, "y", "true"), (11, "new", "legacy", "true")]
    accounts = spark.createDataFrame([(100, "a", "s1"), (101, "legacy", None)], "account_id long, email string, subject string")
    found = identity.resolve_logins(spark.createDataFrame(logins, "login_id long, subject string, email string, claim string"), accounts, spark.createDataFrame([("gone",)], "subject string"))
    assert {r.login_id: (r.outcome, r.account_id) for r in found.collect()} == {
        1: ("already bound", 100), 2: ("unproven", None), 3: ("bound", 101), 4: ("refused", None), 5: ("refused", None), 6: ("created", None), 7: ("refused", None),
        8: ("already bound", None), 9: ("deleted", None), 10: ("no subject", None), 11: ("already bound", 101),
    }


def test_normalized_text():
    assert identity.normalize_text("  Café —  ÉTÉ! ") == "cafe ete"
    assert identity.normalize_text(None) == ""


def one(spark, column, schema=None, **values):
    return spark.createDataFrame([tuple(values.values())], schema or list(values)).select(column.alias("x")).first().x


def test_terms_and_reasons(spark):
    terms = one(spark, text.query_terms(F.col("q")), q="The C++ deploy, for MY Deploy _x_ أهلا")
    assert terms == ["c++", "deploy", "x", "أهلا"]
    matched = one(spark, text.matched(F.col("t"), F.col("d")), t=["deploy", "ploy", "c++"], d="a Deployment in C++")
    assert matched == ["deploy", "c++"]
    reason = text.evidence_reason(F.col("t"), F.lit("none"), F.lit("we deploy now"), F.lit("14:02"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert one(spark, reason, t=["deploy"], d="") == "deploy (at 14:02)"


def test_chunks(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = spark.createDataFrame([(1, "  two  words "), (2, words(801)), (3, words(1440)), (4, None), (5, words(1441))], "id long, t string")
    chunks = {(r.id, r.chunk_idx): r.chunk_text for r in text.word_chunks(rows, "id", "t").collect()}
    assert chunks[1, 0] == "  two  words " and chunks[4, 0] == ""
    assert sorted(k for k in chunks if k[0] == 2) == [(2, 0), (2, 1)] and chunks[2, 1].split()[0] == "w640"
    assert len([k for k in chunks if k[0] == 3]) == 2 and len([k for k in chunks if k[0] == 5]) == 3


def test_sections(spark):
    rows = spark.createDataFrame([(1, "intro [00:10] first (1:02:03) second 7:5 x"), (2, "no marks"), (3, "  "), (4, None)], "id long, t string")
    found = sorted((r.id, r.start_timestamp or "", r.start_seconds or 0, r.body) for r in text.timed_sections(rows, "id", "t").collect())
    assert found == [(1, "", 0, "intro"), (1, "00:10", 10, "first"), (1, "1:02:03", 3723, "second 7:5 x"), (2, "", 0, "no marks")]


def test_tags_profile_intent(spark):
    assert one(spark, text.clean_tags(F.col("t")), t=[" Deep  Learning ", "the best", "saved", "a b c d", "deep learning", "x"]) == ["deep learning", "x"]
    assert one(spark, text.profile(F.col("a"), F.col("b")), a="5 tools", b="") == "list"
    assert one(spark, text.profile(F.col("a"), F.col("b")), a="x", b="the baker") == "recipe"
    assert one(spark, text.profile(F.col("a"), F.col("b")), a="x", b="plain words") == "general"
    assert one(spark, text.infer_intent(F.col("a")), a="I might buy it for my project") == "project"
    assert text.close_tags(["kubernetes"], ["kubernets", "the"]) == ["kubernets", "the", "kubernetes"]


def test_sources_are_cleaned(spark):
    page = "Title: x\nMarkdown Content:\n# Heading {0}\n![i](u) Real [prose](https://a.b) here {0}\n** Log in **\n12K views · 3 likes\nKept words {0}\r\nSuivre\n"
    rows = [(i, "s", page.format(i)) for i in range(6)] + [(10 + i, None, "Suivre\nLog in\nown") for i in range(4)] + [(20, "s", None), (21, "s", "log in\n5 comments"), (22, "t", "Log in\nSuivre, encore une fois")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.doc_id: r.prose for r in captures.prose(docs, "doc_id", "source", "text").collect()}
    assert {i: found[i] for i in range(6)} == {i: f"Heading {i}\nReal prose here {i}\nKept words {i}" for i in range(6)}
    assert found[10] == "Suivre\nLog in\nown" and found[20] == found[21] == "" and found[22] == "Log in\nSuivre, encore une fois"
    assert captures.prose(docs.where("false"), "doc_id", "source", "text").count() == 0


def test_captures_have_an_outcome(spark):
    of = lambda t: one(spark, captures.outcome(F.col("t")), schema="t string", t=t)
    assert [of(t) for t in (None, " ", "Link: https://a.b/c", "please verify you are human", "Target URL returned error 404", "This video is no more: Video unavailable")] == ["empty"] * 6
    assert of("Target URL returned error 503") == "retry" and of("short text") == "usable"
    assert of("how a captcha works " * 30) == "usable"


def test_what_may_be_shared(spark):
    body = "a text that is long enough to be shared with others"
    def usable(url="https://a.b/c?q=1", provenance="page", title="T", text=body, private=None, login=False):  # noqa: E306
        return one(spark, captures.anonymous_usable(*map(F.col, "uptxvl")), schema="u string, p string, t string, x string, v boolean, l boolean", u=url, p=provenance, t=title, x=text, v=private, l=login)
    assert usable() and usable(title=None) and usable(url=None)
    assert not any(usable(url=u) for u in ("https://me:pw@a.b/", "https://a.b/?access_token=1", "https://a.b/?x=1&API-Key=2", "https://a.b/?sig=3"))
    assert usable(url="https://a.b/?token=&design=1") and usable(url="https://a.b/token?signs=1") and usable(url="https://a.b/?q=me@x")
    assert not any((usable(provenance=None), usable(provenance="none"), usable(text=" short "), usable(text=None), usable(private=True), usable(login=True)))
    assert not any((usable(title="Facebook – log in"), usable(title="Private video"), usable(text=body + " Sign in to go on"), usable(text="This post is private. " + body)))
    assert usable(text=body * 60 + " log in to read") and usable(title="My private video")


def test_levels_of_evidence(spark):
    level = lambda t, *o: one(spark, captures.evidence_level(F.col("t"), [F.lit(x).cast("string") for x in o]), schema="t string", t=t)
    assert [level("one two three four", None), level("one two three", "x"), level(None, " ", "y"), level("one", None, " ")] == ["full_transcript", "partial", "partial", "metadata_only"]


def plain_redacted(t):
    """The text with each long run of prose hidden, one character after another."""
    out, run = [], ""
    for c in [*t, "\0"]:
        if c.isalnum() or c in " '.,;:!?-_()[]":
            run += c
            continue
        out += [f"content=[private {hashlib.sha256(run.encode()).hexdigest()[:12]} {len(run)} chars]" if len(run) >= 200 and " " in run else run, c]
        run = ""
    return "".join(out)[:-1]


def test_long_runs_are_redacted(spark):
    rng = random.Random(11)
    cases = ["", "a b " * 50, "a b " * 49, "x" * 300, "{" + "word, " * 60 + "}" + "z" * 199, "\n".join(["some prose " * 30, "short", "\té" * 90]), *("".join(rng.choices("ab é\n{", [9, 9, 3, 3, 0.02, 0.02], k=900)) for _ in range(20))]
    rows = spark.createDataFrame(list(enumerate(cases)), "i long, t string")
    assert {r.i: r.said for r in rows.select("i", text.redact_long_runs(F.col("t")).alias("said")).collect()} == {i: plain_redacted(t) for i, t in enumerate(cases)}


def test_known_values_do_not_cut_digests(spark):
    values = ["a", "1", "alpha", "a.b*", "\\E(", "alpha beta", "alpha"]
    said = "alpha beta 1 met alpha a.b* axb* \\E( 1"
    hidden = lambda v: f"<{hashlib.sha256(v.encode()).hexdigest()[:12]}>"
    expected = re.sub("|".join(re.escape(v) for v in sorted(set(values), key=len, reverse=True)), lambda m: hidden(m[0]), said)
    assert one(spark, text.redact_known(F.col("t"), F.array(*map(F.lit, values))), t=said) == expected


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.integers(-3, 4, 6).astype(float) for i in range(700)}  # many ties
    vectors |= {700: np.zeros(6), 701: np.ones(3)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + [(702, None)], "id long, vector array<double>")
    queries = rows.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    for block in (4_096, 20):
        found = {}
        for r in ranking.exact_neighbours(queries, rows, 7, block).collect():
            found.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.cosine)
        usable = {i: v / np.linalg.norm(v) for i, v in vectors.items() if len(v) == 6 and v.any()}
        for q in (i for i in usable if i % 9 == 0):
            best = sorted((-round(float(usable[q] @ v), 6), i) for i, v in usable.items())[:7]
            assert [(i, -c) for c, i in best] == [found[q][k] for k in range(1, 8)]
        assert len(found) == sum(i % 9 == 0 for i in usable)


def test_misspelt_terms_meet_the_owners_tags(spark):
    tags = spark.createDataFrame([(1, t) for t in ("kubernetes", "zebra", "kubernetes")] + [(2, "zebras")], "owner long, tag string")
    queries = spark.createDataFrame([(1, 1, ["kubernets", "the"]), (2, 2, ["zebrs"]), (3, 3, ["alone"])], "owner long, query_id long, terms array<string>")
    found = {r.query_id: r.terms for r in text.typo_expand(queries, tags).collect()}
    assert found == {1: ["kubernets", "the", "kubernetes"], 2: ["zebrs", "zebras"], 3: ["alone"]}
    assert {r.query_id: r.terms for r in text.typo_expand(queries, tags, most=0).collect()}[1] == ["kubernets", "the"]


def test_clock(spark):
    assert [one(spark, clock.backoff(F.col("n")), n=n) for n in (1, 2, 8, 9, 99)] == [2, 4, 256, 300, 300]
    thursday = 1_767_225_600  # 2026-01-01
    due = lambda local, hour: one(spark, clock.weekly_due(F.col("l"), F.lit(3), F.lit(hour), F.lit(50)), l=local)
    assert due(thursday + 86_400 + 240, 23) and not due(thursday + 23 * 3600 + 49 * 60, 23) and not due(thursday + 24 * 3600 + 5 * 60, 23)
    assert one(spark, clock.iso_week(F.col("l")), l=thursday) == "2026-W01"


def test_retry_delays(spark):
    cases = [("3.5", 3.5), ("-1", 0.5), ("NaN", 0.5), ("1e999", 0.5), ("10d", 0.5), ("Thu, 01 Jan 1970 00:01:40 GMT", 90.0), ("Thu, 01 Jan 1970 00:00:01 GMT", 0.0), ("Thu, 41 Foo 1970 00:00:01 GMT", 0.5), ("", 0.5), (None, 0.5)]
    rows = spark.createDataFrame(cases, "header string, delay double")
    found = rows.select("header", "delay", clock.retry_delay(F.col("header"), F.lit(1), F.lit(10), F.lit(0.5)).alias("found")).collect()
    assert [(r.header, r.found) for r in found] == cases
    assert one(spark, clock.retry_delay(F.lit(None).cast("string"), F.col("n"), F.lit(0), F.lit(0.0)), n=9) == pytest.approx(6.4)


def test_known_values_leave_no_part(spark):
    digest = lambda v: f"<{__import__('hashlib').sha256(v.encode()).hexdigest()[:12]}>"
    out = one(spark, text.redact_known(F.col("t"), F.array(F.lit("ann"), F.lit("ann lee"), F.lit(""), F.lit(None).cast("string"))), t="ann lee met ann")
    assert out == f"{digest('ann lee')} met {digest('ann')}"
    assert one(spark, text.redact_known(F.col("t"), F.lit(None).cast("array<string>")), t="x") == "x"


def test_reasons(spark):
    assert one(spark, text.reason_terms(F.col("t")), t="aws + deployment (at 01:20), ecs ,") == ["aws", "deployment", "ecs"]
    assert [one(spark, text.vacuous_reason(F.col("t")), t=t) for t in (" Related to x", "aws", "  ", "matched: x")] == [True, False, True, True]


def test_only_closed_forms_are_logged(spark):
    routes = {"/api/v1/items/{item_id}": "/api/v1/items/{item_id}", " READY ": "READY", "https://example.test/a/page": "unmatched", "/items/7": "unmatched", "two words": "unmatched", "": "unmatched", "a" * 65: "unmatched", "//{x}": "unmatched", None: "unmatched", "é.1": "é.1"}
    rows = spark.createDataFrame(list(routes.items()), "path string, expected string")
    assert rows.where(text.safe_route(F.col("path")) != F.col("expected")).count() == 0
    ids = {" a-1:/x ": "a-1:/x", "a\nb": None, "a{b}": None, "": None, "x" * 128: "x" * 128, "x" * 129: None, None: None}
    rows = spark.createDataFrame(list(ids.items()), "id string, expected string")
    assert rows.where(~text.safe_request_id(F.col("id")).eqNullSafe(F.col("expected"))).count() == 0


def test_timed_chunks_are_numbered_through_the_text(spark):
    rows = spark.createDataFrame([(1, "a b c d e [00:10] f g [01:00] "), (2, "  "), (3, None)], "id long, t string")
    found = text.timed_chunks(rows, "id", "t", size=3, step=2).orderBy("chunk_idx").collect()
    assert [tuple(r) for r in found] == [(1, 0, "a b c", None, None), (1, 1, "c d e", None, None), (1, 2, "f g", "00:10", 10)]
