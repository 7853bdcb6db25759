"""Reminders, private copies, guests, transcripts and durations against plain versions."""

import json
import random

from pyspark.sql import functions as F

from lodestone.operators import upkeep


def plain_sync(local, remote, now):
    """The sync as a device does it, one reminder after another: {item: (pushed, outcome, row)}."""
    device, server, out = {i: dict(r) for i, r in local.items()}, dict(remote), {}
    for i, r in local.items():
        out[i] = [None, "kept"]
        if r["asleep"]:
            continue
        if r["dirty"] == "remove":
            out[i][0] = "remove"
            server.pop(i, None)
            del device[i]
            out[i][1] = "deleted"
        elif r["dirty"] == "set" and r["at"] > now:
            out[i][0] = "set"
            server[i] = r["at"]
            device[i]["dirty"] = ""
        elif r["dirty"] == "delivered":
            out[i][0] = "acknowledge"
            if server.get(i) == r["at"] <= now:
                del server[i]
            device[i]["dirty"] = ""
    for i, at in server.items():
        mine = device.get(i)
        if mine and (mine["dirty"] or mine["asleep"]):
            continue
        if mine is None or mine["at"] != at:
            device[i] = {"at": at, "dirty": "", "heard": False, "asleep": False}
            out.setdefault(i, [None, ""])[1] = "stored"
    for i in list(device):
        if device[i]["dirty"] == "" and not device[i]["asleep"] and i not in server:
            del device[i]
            out[i][1] = "deleted"
    for r in device.values():
        if not r["asleep"] and not r["heard"] and r["dirty"] != "remove" and r["at"] <= now:
            r["heard"], r["dirty"] = True, "remove" if r["dirty"] == "set" else "delivered"
    return {i: (pushed, outcome, *((device[i]["at"], device[i]["dirty"], device[i]["heard"]) if i in device else (None, None, None))) for i, (pushed, outcome) in out.items()}


def test_reminders_merge_as_a_device_does(spark):
    rng = random.Random(1)
    local, remote = {}, {}
    for i in range(600):
        if rng.random() < 0.8:
            local[i] = {"at": rng.choice([50, 99, 100, 101, 150]), "dirty": rng.choice(["", "", "set", "remove", "delivered"]), "heard": rng.random() < 0.3, "asleep": rng.random() < 0.1}
        if rng.random() < 0.7:
            remote[i] = rng.choice([50, 99, 100, 101, 150])
    mine = spark.createDataFrame([(i, r["at"], r["dirty"] or None, r["heard"], r["asleep"]) for i, r in local.items()] + [(None, 1, "set", False, False)], "item_id long, scheduled_s long, dirty string, delivered boolean, suspended boolean")
    theirs = spark.createDataFrame(list(remote.items()), "item_id long, scheduled_s long")
    found = {r.item_id: tuple(r)[1:] for r in upkeep.merge_reminders(mine, theirs, 100).collect()}
    assert found == plain_sync(local, remote, 100) and len({v[:2] for v in found.values()}) >= 7


# -- private copies ----------------------------------------------------------


def tables(spark, assets, memories, items):
    return (
        spark.createDataFrame(assets, "id string, visibility string, owner long, title string"),
        spark.createDataFrame(memories, "content_id string, user_id long, note string"),
        spark.createDataFrame(items, "id long, content_id string, user_id long"),
    )


def test_shared_assets_are_split_once(spark):
    assets = [("a", "PRIVATE", None, "A"), ("b", "PUBLIC", None, "B"), ("c", None, 1, "C"), ("d", "UNKNOWN", 3, "D")]
    memories = [("a", 1, "n1"), ("a", 2, "n2"), ("b", 1, ""), ("b", 2, ""), ("c", 1, ""), ("d", 3, ""), ("d", 4, "x"), (None, 5, "")]
    items = [(10, "a", 1), (11, "a", 2), (12, "a", 2), (13, "a", 9), (14, "b", 2), (15, None, 2), (16, "d", 4)]
    before = tables(spark, assets, memories, items)
    new_assets, new_memories, new_items = upkeep.split_shared(*before)
    rows = new_assets.collect()
    assert sorted((r.parent or r.id, r.owner, r.title) for r in rows) == [("a", 1, "A"), ("a", 2, "A"), ("b", None, "B"), ("c", 1, "C"), ("d", 3, "D"), ("d", 4, "D")] or len(rows) == 6
    of = {(r.parent, r.owner): r.id for r in rows if r.parent}
    assert set(of) == {("a", 1), ("a", 2), ("d", 3), ("d", 4)} and len(set(of.values())) == 4
    assert {(r.user_id, r.note): r.content_id for r in new_memories.collect()}[2, "n2"] == of["a", 2]
    assert {r.id: r.content_id for r in new_items.collect()} == {10: of["a", 1], 11: of["a", 2], 12: of["a", 2], 13: "a", 14: "b", 15: None, 16: of["d", 4]}
    again = upkeep.split_shared(new_assets.drop("parent"), new_memories, new_items)
    assert sorted(r.id for r in again[0].collect()) == sorted(r.id for r in rows) and again[0].where("parent is not null").count() == 0
    rerun = upkeep.split_shared(*before)[0].collect()
    assert sorted(r.id for r in rerun) == sorted(r.id for r in rows)


def test_detached_saves_have_their_own_content(spark):
    _, memories, items = tables(spark, [], [("a", 1, "n1"), ("b", 1, "n2"), ("a", 2, "n3")], [(10, "a", 1), (11, "a", 1), (12, "b", 1), (13, None, 1), (14, "a", 2)])
    after, notes, assets = upkeep.detach(items, memories, spark.createDataFrame([(10,), (12,), (12,), (13,), (99,)], "id long"))
    own = {r.item_id: r.id for r in assets.collect()}
    assert set(own) == {10, 12, 13}
    assert {r.id: r.content_id for r in after.collect()} == {10: own[10], 11: "a", 12: own[12], 13: own[13], 14: "a"}
    assert sorted((r.content_id, r.user_id, r.note) for r in notes.collect()) == sorted([("a", 1, "n1"), (own[10], 1, "n1"), (own[12], 1, "n2"), ("a", 2, "n3")])


# -- guests ------------------------------------------------------------------


def plain_sweep(users, items, memories, assets, jobs, chunks, now):
    """Deletes row by row, as a worker that walks over guests' saves does."""
    guests = {u for u, s in users if s and s.startswith("guest:")}
    busy = {c for c, status, locked in jobs if status == "PROCESSING" or locked is not None}
    items, memories, assets, out = list(items), set(memories), {a[0]: a for a in assets}, set()
    limit = now - 86_400

    def drop_asset(content, owner):
        a = assets.get(content)
        if a and a[1] == owner and a[2] != "PUBLIC" and content not in busy and not any(i[2] == content for i in items) and not any(m[1] == content for m in memories):
            del assets[content]
            out.add(("asset", content))

    for row in [i for i in items if i[1] in guests and i[3] < limit and i[4] is None]:
        key, user, content = row[:3]
        if content in busy and content is not None:
            continue
        items.remove(row)
        out |= {("item", str(key))} | {("chunk", f"{i}:{n}") for i, n in chunks if i == key}
        if content is not None:
            if not any(i[1] == user and i[2] == content for i in items) and (user, content) in memories:
                memories.discard((user, content))
                out.add(("memory", f"{user}:{content}"))
            drop_asset(content, user)
    for a in list(assets.values()):
        if a[1] in guests and a[3] < limit:
            drop_asset(a[0], a[1])
    return out


def test_guests_are_swept_as_row_by_row(spark):
    rng = random.Random(2)
    for _ in range(3):
        users = [(u, rng.choice(["guest:x", "guest:y", "sub", None])) for u in range(12)]
        contents = [f"c{k}" for k in range(25)]
        items = [(i, rng.randrange(12), rng.choice([*contents, None]), rng.choice([1_000, 99_000]), rng.choice([None, None, None, 5])) for i in range(60)]
        memories = {(i[1], i[2]) for i in items if i[2] and rng.random() < 0.9} | {(rng.randrange(12), rng.choice(contents)) for _ in range(5)}
        assets = [(c, rng.choice([*range(12), None]), rng.choice(["PRIVATE", "UNKNOWN", "PUBLIC", None]), rng.choice([1_000, 99_000])) for c in contents]
        jobs = [(rng.choice(contents), rng.choice(["PROCESSING", "READY", "PENDING"]), rng.choice([None, None, 7])) for _ in range(6)] + [(None, "PROCESSING", 1)]
        chunks = [(i, n) for i in range(60) for n in range(2)]
        frames = [
            spark.createDataFrame(rows, schema)
            for rows, schema in (
                (users, "user_id long, subject string"),
                (items, "id long, user_id long, content_id string, created_s long, deleted_s long"),
                (sorted(memories), "user_id long, content_id string"),
                (assets, "id string, owner long, visibility string, created_s long"),
                (jobs, "content_id string, status string, locked_s long"),
                (chunks, "item_id long, chunk_idx int"),
            )
        ]
        found = [tuple(r) for r in upkeep.sweep_guests(*frames, now=100_000).collect()]
        assert len(found) == len(set(found)) and set(found) == plain_sweep(users, items, memories, assets, jobs, chunks, 100_000)


# -- transcripts -------------------------------------------------------------


def plain_pack(segments, cap):
    """(group, text) of a transcript's segments, a list that grows."""
    pieces = []
    for s in segments:
        if len(json.dumps(s, ensure_ascii=False)) + 4 <= cap:
            pieces.append(s)
        else:
            width = max(1, cap // 2 - 128)
            pieces += [s | {"text": s["text"][i : i + width]} for i in range(0, len(s["text"]), width)]
    out, group, size = [], 0, 2
    for n, s in enumerate(pieces):
        length = len(json.dumps(s, ensure_ascii=False))
        if n and size + length > cap and out[-1][0] == group:
            group, size = group + 1, 2
        out.append((group, s["text"]))
        size += length + 2
    return out


def test_transcripts_are_packed_as_plain(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for key in ("short", "long", "big", "edge"):
        segments = []
        for n in range({"short": 3, "long": 400, "big": 9, "edge": 40}[key]):
            size = {"short": 20, "long": rng.randrange(1, 60), "big": rng.choice([10, 900, 2_500]), "edge": 400}[key]
            segments.append({"id": n, "text": "é" * size})
        rows += [(key, s["id"], s["text"]) for s in segments]
        expected[key] = plain_pack(segments, 1_000)
    rows += [("odd", 0, None), ("odd", 1, "")]
    frame = spark.createDataFrame(rows, "talk string, id int, text string").repartition(5)
    size = F.char_length(F.format_string('{"id": %d, "text": ""}', F.col("id"))) + F.char_length(F.coalesce("text", F.lit("")))
    found = {}
    for r in upkeep.pack_segments(frame, "talk", "id", "text", size, cap=1_000).orderBy("talk", "id", "piece").collect():
        found.setdefault(r.talk, []).append((r.group, r.text))
    assert found.pop("odd") == [(0, None), (0, "")]
    assert found == expected and len({g for g, _ in expected["long"]}) > 10


# -- durations ---------------------------------------------------------------


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(4)
    rows = [(i * 60, int(rng.paretovariate(1.2) * 30), None) for i in range(30_000)] + [(5, None, None), (None, 7, None)]
    values = spark.createDataFrame(rows, "at long, v long, x string")
    sketches = upkeep.slice_sketches(values, "at", "v", 86_400)
    assert sketches.count() > 15
    got = upkeep.merged_quantiles(sketches, [0.5, 0.95, 0.99]).first()
    known = sorted(v for at, v, _ in rows if v is not None and at is not None)
    assert got.n == len(known)
    for p in (0.5, 0.95, 0.99):
        value = got[f"p{round(p * 100)}"]
        low, high = sum(v < value for v in known) / len(known), sum(v <= value for v in known) / len(known)
        assert low - 0.017 <= p <= high + 0.017


def test_durations_are_clamped(spark):
    jobs = spark.createDataFrame([(1, 10, 12, 15), (2, 10, 8, 5), (3, 10, None, 20), (4, None, 4, None)], "id long, created_s long, claimed_s long, updated_s long")
    assert [(r.wait_s, r.run_s) for r in upkeep.durations(jobs).orderBy("id").collect()] == [(2, 3), (0, 0), (None, None), (None, None)]
