"""Shares taken, transitions asked for, and results reused, against plain versions that go row by row."""

import hashlib
import random

from lodestone.operators import saves


def plain_redeem(shares, taken, items, asks, now, most):
    taken, items, out = {(u, t): [i, at] for u, t, i, at in taken}, {i: [u, url, gone] for i, u, url, gone in items}, {}
    for ask, user, token in sorted(asks):
        share = next((s for s in shares if s[0] == token), None)
        if share is None or share[3] or share[2] <= now:
            out[ask] = ("gone", None)
            continue
        old = taken.get((user, token))
        if old and old[0] in items and items[old[0]][2] is None:
            # what the batch itself made is told as existing
            out[ask] = ("existing" if old[1] == "batch" else "again", old[0])
            continue
        item = next((i for i, (u, url, _) in items.items() if u == user and url == share[1]), None)
        if item and items[item][2] is None:
            out[ask] = ("existing", item)
            continue
        if sum(u == user and (at == "batch" or at > now - 86_400) for (u, _), (_, at) in taken.items()) >= most:
            out[ask] = ("limit", None)
            continue
        made = item or hashlib.md5(f"share|{user}|{token}".encode()).hexdigest()
        items[made] = [user, share[1], None]
        out[ask] = ("restored" if item else "created", made)
        if old:
            old[0] = made
        else:
            taken[user, token] = [made, "batch"]
    return out


def test_shares_are_taken_as_one_by_one(spark):
    rng, seen = random.Random(1), set()
    for most in (2, 100):
        shares = [(f"t{k}", f"url{k % 6}", rng.choice([50, 200, 200]), rng.random() < 0.1) for k in range(9)]
        items = [(f"i{n}", n % 5, f"url{n // 5}", rng.choice([None, 7])) for n in range(15)]
        taken = [(u, f"t{k}", rng.choice([None, *(i[0] for i in items if i[1] == u)]), rng.choice([100 - 90_000, 90])) for u in range(5) for k in range(0, 9, 4)]
        asks = [(n, rng.randrange(5), rng.choice(["none", *(f"t{k}" for k in range(9))])) for n in range(60)]
        asks = [a for n, a in enumerate(asks) if a[1:] not in {x[1:] for x in asks[:n]}]  # a user asks for a share once here
        found = saves.redeem(
            spark.createDataFrame(shares, "token_hash string, url string, expires_s long, revoked boolean"),
            spark.createDataFrame(taken, "user_id long, token_hash string, item_id string, at_s long"),
            spark.createDataFrame(items, "id string, user_id long, url string, deleted_s long"),
            spark.createDataFrame(asks, "ask_id long, user_id long, token_hash string"),
            100,
            most,
        ).collect()
        expected = plain_redeem(shares, taken, items, asks, 100, most)
        assert {r.ask_id: (r.outcome, r.item_id) for r in found} == expected
        seen |= {o for o, _ in expected.values()}
    assert seen == {"gone", "again", "existing", "created", "restored", "limit"}


ITEM = "id long, user_id long, status string, needs_retry boolean, link_only boolean, edited_title string, edited_summary string, under_way boolean, made_on long, made int"


def plain_decide(item, held, ask, today):
    row = dict(item)
    edited, waits = item["edited_title"] is not None or item["edited_summary"] is not None, item["status"] in ("pending", "processing")
    if ask["kind"] == "edit":
        for name in ask["sets"]:
            row[f"edited_{name}"] = ask[name]
        return "edited_now", row
    count = item["made"] if item["made_on"] == today else 0
    if ask["kind"] == "regenerate":
        for broken, outcome in ((edited and not ask["replace_edits"], "confirm"), (item["under_way"], "unchanged"), (waits or held, "busy"), (count >= 3, "quota")):
            if broken:
                return outcome, row
        return "queued", row | {"status": "ready", "needs_retry": False, "link_only": False, "under_way": True, "made_on": today, "made": count + 1}
    for broken, outcome in ((edited, "edited"), (item["link_only"], "link"), (waits, "unchanged"), (item["status"] != "failed" and not item["needs_retry"], "refused"), (held, "busy")):
        if broken:
            return outcome, row
    return "queued", row | {"status": "pending", "needs_retry": False}


def test_transitions_are_decided_as_one_by_one(spark):
    rng = random.Random(2)
    yes = lambda p: rng.random() < p
    items = [
        {"id": i, "user_id": i % 3, "status": rng.choice(["ready", "failed", "pending", "processing"]), "needs_retry": yes(0.2), "link_only": yes(0.2), "edited_title": "t" if yes(0.2) else None,
         "edited_summary": "s" if yes(0.1) else None, "under_way": yes(0.1), "made_on": rng.choice([None, 5, 6]), "made": rng.randrange(5)}
        for i in range(400)
    ]
    held = {i for i in range(400) if yes(0.2)}
    asks = [{"id": i, "user_id": i % 3, "kind": rng.choice(["edit", "regenerate", "retry"]), "replace_edits": yes(0.5), "sets": rng.choice([[], ["title"], ["title", "summary"]]), "title": rng.choice([None, "new"]), "summary": "own"} for i in range(400)]
    asks += [asks[7] | {"user_id": 99, "id": 1007}, asks[0] | {"id": 5_000}]
    schema = "id long, user_id long, kind string, replace_edits boolean, sets array<string>, title string, summary string"
    found = saves.decide(spark.createDataFrame(items, ITEM), spark.createDataFrame([(i, True) for i in held], "id long, held boolean"), spark.createDataFrame(asks, schema), 6).collect()
    assert len(found) == len(asks)
    for r in found:
        if r.id >= 400:
            assert r.outcome == "not_found"
            continue
        outcome, row = plain_decide(items[r.id], r.id in held, asks[r.id], 6)
        assert (r.outcome, {k: r[k] for k in row if k != "user_id"}) == (outcome, {k: v for k, v in row.items() if k != "user_id"})


def plain_source(item, items, assets, jobs, chunked, model, prompt):
    asset = assets.get(item["content_id"])
    if item["edited"] or item["under_way"] or item["id"] not in jobs or asset is None:
        return None
    if asset["status"] != "READY" or asset["owner"] != item["user_id"] or asset["version"] != jobs[item["id"]]:
        return None
    others = [x for x in items if x["content_id"] == item["content_id"] and x["id"] != item["id"] and x["status"] == "ready" and not x["link_only"] and x["embedding_model"] == model]
    if not others:
        return None
    source = min(others, key=lambda x: (x["created_s"], x["id"]))
    if source["needs_retry"] or source["brief_source"] in (None, "fallback") or source["prompt_version"] != prompt or source["id"] not in chunked:
        return None
    return None if item["is_video"] and source["evidence_level"] not in (None, "full_transcript") else source["id"]


def test_results_are_reused_as_one_by_one(spark):
    rng = random.Random(3)
    yes = lambda p: rng.random() < p
    items = [
        {"id": i, "user_id": rng.randrange(3), "content_id": rng.choice([None, *(f"c{k}" for k in range(60))]), "created_s": rng.randrange(9), "status": "ready" if yes(0.8) else "failed", "needs_retry": yes(0.1), "link_only": yes(0.1),
         "edited": yes(0.1), "under_way": yes(0.1), "embedding_model": "m" if yes(0.9) else "old", "brief_source": rng.choice(["model", "model", "model", "fallback", None]), "prompt_version": "p2" if yes(0.9) else "p1",
         "evidence_level": rng.choice([None, "full_transcript", "partial"]), "is_video": yes(0.3)}
        for i in range(400)
    ]
    assets = {f"c{k}": {"id": f"c{k}", "owner": rng.randrange(3), "status": "READY" if yes(0.9) else "FAILED", "version": "v2" if yes(0.9) else "v1"} for k in range(55)}
    jobs, chunked = {i: "v2" for i in range(400) if yes(0.9)}, {i for i in range(400) if yes(0.9)}
    schema = "id long, user_id long, content_id string, created_s long, status string, needs_retry boolean, link_only boolean, edited boolean, under_way boolean, embedding_model string, brief_source string, prompt_version string, evidence_level string, is_video boolean"
    tables = [spark.createDataFrame(items, schema), spark.createDataFrame(list(assets.values()), "id string, owner long, status string, version string")]
    tables += [spark.createDataFrame(list(jobs.items()), "item_id long, job_type string"), spark.createDataFrame([(i,) for i in chunked for _ in range(2)], "item_id long")]
    found = {r.id: r.source for r in saves.reuse_sources(*tables, "m", "p2").collect()}
    expected = {x["id"]: s for x in items if (s := plain_source(x, items, assets, jobs, chunked, "m", "p2")) is not None}
    assert found == expected and len(expected) > 15
    assert saves.reuse_sources(*tables, None, "p2").count() == 0
