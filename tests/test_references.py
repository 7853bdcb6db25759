"""Whole queries that SQL cannot express, against plain versions over the same tables."""

import difflib
import json
import re
from collections import defaultdict

import numpy as np

from lodestone.functions.stem import porter
from lodestone.operators import evaluate
from lodestone.plans import registry, search
from lodestone.sources import binders
from tests.test_evaluate import plain_groundedness
from tests.test_retrieval import plain_top

QUERIES = registry.queries()


def rows(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet").collect()


def scripts(spark, data):
    talks = defaultdict(list)
    for r in rows(spark, data, "conversations"):
        stamp = r.turn * 75
        talks[r.conv_id].append((r.turn, f"[{stamp // 60:02d}:{stamp % 60:02d}] {r.text}"))
    return {k: "\n".join(line for _, line in sorted(v)) for k, v in talks.items()}


def plain_sections(text):
    """(number, stamp, body) of a text cut at its time markers, one match after another."""
    pieces, at, stamp, number = [], 0, None, 0
    for m in re.finditer(r"(?:^|(?<=[\s\[(\-]))(\d{1,2}:\d{2}(?::\d{2})?)(?=$|[\s\]).,:])", text):
        pieces.append((number, stamp, text[at : m.start()]))
        at, stamp, number = m.end(), m.group(1), number + 1
    pieces.append((number, stamp, text[at:]))
    return [(n, s, b.strip(" \t\n[]()")) for n, s, b in pieces if b.strip(" \t\n[]()")]


def test_timed_sections(spark, data):
    found = defaultdict(list)
    for r in QUERIES["timed_sections"](spark, data).collect():
        found[r.conv_id].append((r.section_idx, r.start_timestamp, r.body))
    assert {k: sorted(v) for k, v in found.items()} == {k: plain_sections(t) for k, t in scripts(spark, data).items()}


def test_segment_groups(spark, data):
    expected = {}
    for r in rows(spark, data, "documents"):
        group, size, out = 0, 2, []
        for line in (r.text or "").split("\n"):
            if out and size + len(line) > 1_000:
                group, size = group + 1, 2
            out.append(group)
            size += len(line) + 2
        expected[r.doc_id] = out
    assert {r.doc_id: r.groups for r in QUERIES["segment_groups"](spark, data).collect()} == expected


def test_packed_segments(spark, data):
    found = defaultdict(list)
    for r in QUERIES["packed_segments"](spark, data).orderBy("conv_id", "turn", "piece").collect():
        found[r.conv_id].append((r.group, r.turn, r.chars))
    talks = defaultdict(list)
    for r in rows(spark, data, "conversations"):
        talks[r.conv_id].append((r.turn, r.text or ""))
    for key, turns in talks.items():
        group, size, out = 0, 2, []
        for turn, text in sorted(turns):
            whole = len(json.dumps({"id": turn, "text": ""})) + len(text)
            parts = [text] if whole + 4 <= 2_000 else [text[i : i + 872] for i in range(0, len(text), 872)]
            for part in parts:
                length = whole - len(text) + len(part)
                if out and size + length > 2_000:
                    group, size = group + 1, 2
                out.append((group, turn, len(part)))
                size += length + 2
        assert found[key] == out


def test_quota_spend(spark, data):
    uses = sorted((r.user_id, int(r.ts.replace(tzinfo=__import__("datetime").timezone.utc).timestamp()), r.event_id) for r in rows(spark, data, "events"))
    expected, state = {}, {}
    for owner, at, seq in uses:
        own = state.setdefault(owner, {n: [0, None] for n in ("calls", "tokens")})
        amounts, limits = {"calls": 1, "tokens": seq % 50}, {"calls": 5, "tokens": 120}
        for counter in own.values():
            if counter[1] is not None and at >= counter[1] + 86_400:
                counter[:] = [0, None]
        ok = all(own[n][0] + amounts[n] <= limits[n] for n in own)
        if ok:
            for n, counter in own.items():
                if amounts[n]:
                    counter[0] += amounts[n]
                    counter[1] = at if counter[1] is None else counter[1]
        expected[owner, seq] = ok
    assert {(r.owner, r.seq): r.granted for r in QUERIES["quota_spend"](spark, data).collect()} == expected


def test_typo_expand(spark, data):
    saves = binders.items(spark, data).select("id", "user_id", "topics").collect()
    known = defaultdict(set)
    for r in saves:
        known[r.user_id] |= {t.lower() for t in r.topics}
    expected = {}
    for r in saves:
        terms = [r.topics[0].lower().replace("e", "ee"), "the"]
        near = [m for t in terms if len(t) >= 4 and t not in known[r.user_id] for m in difflib.get_close_matches(t, sorted(known[r.user_id]), 1, 0.8)]
        expected[r.id] = terms + [m for i, m in enumerate(near) if m not in terms and m not in near[:i]]
    assert {r.query_id: list(r.terms) for r in QUERIES["typo_expand"](spark, data).collect()} == expected


def test_stemmed_scores_and_their_index(spark, data):
    saves = {r.id: r.search_text for r in search.searchable_items(spark, data).collect()}
    asked = defaultdict(list)
    for r in search.query_words(search.query_table(spark)).collect():
        asked[r.query_id].append(r.term)
    expected = plain_top(saves, asked, 50, porter)
    for name in ("stemmed_scores", "indexed_stems"):
        assert sorted(map(tuple, QUERIES[name](spark, data).collect())) == expected


def test_channel_trace(spark, data):
    """Every list's scores and places agree with the fused search's own lists."""
    queries = search.query_table(spark)
    lists, _ = search.candidates(spark, data, queries)
    best = {}
    for r in lists.collect():
        key = (r.query_id, r.id, r.list)
        best[key] = (min(r.rank, best.get(key, (r.rank,))[0]), max(round(r.raw, 6), best.get(key, (0, round(r.raw, 6)))[1]))
    assert {(r.query_id, r.id, r.list): (r["rank"], r.raw) for r in QUERIES["channel_trace"](spark, data).collect()} == best
    assert {k[2] for k in best} == {"lexical", "vector", "note", "chunk_vector", "chunk_lexical"}


def test_grounded_answers(spark, data):
    talks = defaultdict(lambda: ([], []))
    for r in sorted(rows(spark, data, "conversations"), key=lambda r: (r.conv_id, r.turn, r.text or "")):
        talks[r.conv_id][r.role != "assistant"].append(r.text) if r.role in ("assistant", "user") else None
    expected = {k: plain_groundedness(said, "\n".join(asked), None) for k, (said, asked) in talks.items()}
    found = {r.conv_id: (r.checked, r.supported, r.unsupported, r.score) for r in QUERIES["grounded_answers"](spark, data).collect()}
    assert {k: found[k] for k in expected} == {k: (c, s, len(bad), score) for k, (c, s, bad, score) in expected.items()}
    assert evaluate.SUPPORT == 0.6


def test_chunk_neighbours_are_true_ones(spark, data):
    from lodestone.plans import retrieval

    vectors = {r.id: np.array(r.vector) for r in retrieval.chunk_vectors(spark, data).collect()}
    for r in QUERIES["chunk_neighbours"](spark, data).where("rank <= 3").collect():
        assert abs(float(vectors[r.query_id] @ vectors[r.id]) - r.cosine) < 2e-6
        assert r["rank"] > 1 or r.cosine > 0.999999
