"""Order-dependent and edge cases of the operators against plain Python."""

import hashlib
import pathlib
import random

from pyspark.sql import functions as F

from tiermem.functions import scan
from tiermem.functions.streamhash import ordered_sha256
from tiermem.functions.vectors import hash_embed
from tiermem.operators import audit, checks, distill, ingest, inventory, latency, lifecycle, replies, scenes, usage
from tiermem.sources import export, snapshot


def test_blocked_scans_equal_windows(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", n, rng.choice([None, rng.randrange(100)])) for n in range(2000)]
    df = spark.createDataFrame(rows, "k string, n long, v long")
    ranked = scan.blocked_row_number(df, ["k"], [("_a", F.floor(F.col("n") / 500)), ("_b", F.floor(F.col("n") / 50))], ["n"])
    seen, want = {}, set()
    for k, n, _ in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        want.add((k, n, seen[k]))
    assert {(r.k, r.n, r.rn) for r in ranked.collect()} == want
    top, want = {}, set()
    for k, n, v in sorted(rows, key=lambda r: r[1]):
        top[k] = max([x for x in (top.get(k), v) if x is not None], default=None)
        want.add((k, n, top[k]))
    running = scan.blocked_running_max(df, ["k"], ("_a", F.floor(F.col("n") / 50)), ["n"], F.col("v"), "m")
    assert {(r.k, r.n, r.m) for r in running.collect()} == want


def test_ordered_hash(spark):
    rows = [(f"g{n % 3}", f"{n:05d}", f"é{n}|") for n in range(5000)]
    got = {r.g: r.h for r in ordered_sha256(spark.createDataFrame(rows, "g string, o string, t string"), ["g"], ["o"], "t", "h").collect()}
    for g in got:
        assert got[g] == hashlib.sha256("".join(t for k, _, t in rows if k == g).encode()).hexdigest()


def test_hash_embed_is_unit_length(spark):
    df = spark.createDataFrame([("a", "hello"), ("b", "")], "id string, t string")
    rows = {r.id: r.e for r in df.select("id", hash_embed(F.col("t"), 8).alias("e")).collect()}
    assert abs(sum(x * x for x in rows["a"]) - 1) < 1e-6 and set(rows["b"]) == {0.0}


def ingest_in_order(rows):
    by_index, by_id, out = {}, {}, {}
    for arrival, id_, s, session, index, turn, content in sorted(rows):
        if index is not None and (session, index) in by_index:
            out[id_] = "duplicate" if by_index[(session, index)] == content else "index_conflict"
        elif turn is not None and (session, turn) in by_id:
            out[id_] = "duplicate" if by_id[(session, turn)] == index else "turn_id_conflict"
        else:
            out[id_] = "accepted"
            if index is not None:
                by_index[(session, index)] = content
            if turn is not None:
                by_id[(session, turn)] = index
    return out


TURN = "arrival long, id string, store_key string, session_id string, turn_index long, turn_id string, content string"


def test_ingest_rounds_equal_sequential_rule(spark):
    """Refused turns take no key, so verdicts chain; one key holds a third of the rows."""
    rng = random.Random(5)
    rows = []
    for n in range(400):
        hot = rng.random() < 0.34
        rows.append((
            n, f"i{n}", "t:self", "s0" if hot else f"s{rng.randrange(4)}", 0 if hot else rng.choice([None, *range(12)]),
            rng.choice([None, *[f"t{x}" for x in range(12)]]), rng.choice("ab"),
        ))
    df = spark.createDataFrame(rows, TURN)
    accepted, duplicates, conflicts = ingest.ingest_turns(df, df.limit(0))
    got = {r.id: "accepted" for r in accepted.collect()} | {r.id: "duplicate" for r in duplicates.collect()}
    got |= {r.id: r.reason for r in conflicts.collect()}
    assert got == ingest_in_order(rows)


def test_ingest_against_stored_turns(spark):
    stored = spark.createDataFrame([(0, "old", "t:self", "s", 3, "x", "hi")], TURN)
    new = spark.createDataFrame(
        [(1, "a", "t:self", "s", 3, None, "hi"), (2, "b", "t:self", "s", 3, None, "ho"), (3, "c", "t:self", "s", 4, "x", "z"), (4, "d", "t:self", "s", 5, "y", "z")], TURN
    )
    accepted, duplicates, conflicts = ingest.ingest_turns(new, stored)
    assert [r.id for r in accepted.collect()] == ["d"]
    assert [(r.id, r.kept_id) for r in duplicates.collect()] == [("a", "old")]
    assert {(r.id, r.reason) for r in conflicts.collect()} == {("b", "index_conflict"), ("c", "turn_id_conflict")}


GOOD = '{"type":"fact","content":" a ","confidence":"high"}'
REPLIES = {
    "fence": (f"```json\n[{GOOD}]\n```", 1, None), "empty": ("[]", 0, None), "fenced_empty": ("```\n[]\n```", 0, None),
    "lines": (f"Sure:\n{GOOD}\n{GOOD}\nbye", 2, None), "blank": (" \n ", 0, "blank"), "prose": ("nothing", 0, "no_objects"),
    "broken_array": ("[{", 0, "bad_array"), "bad_element": (f"[{GOOD}, 5]", 0, "invalid_element"),
    "broken_line": (f"{GOOD}\n{{oops", 0, "malformed_object"),
    "number": ('{"type":"fact","content":5,"confidence":"high"}', 0, "invalid_candidate"),
    "blank_content": ('{"type":"fact","content":"  ","confidence":"high"}', 0, "invalid_candidate"),
}


def test_candidate_replies(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in REPLIES.items()], "reply_id string, raw string")
    candidates, verdicts, rejected = replies.parse_candidates(df)
    got = {r.reply_id: (r.n_candidates, r.reason or None) for r in verdicts.collect()}
    assert got == {k: v[1:] for k, v in REPLIES.items()}
    assert {r.content for r in candidates.collect()} == {"a"}
    assert rejected.count() == sum(1 for v in REPLIES.values() if v[2])


def test_decision_replies_are_parsed_once(spark):
    """No filter before the entries become rows repeats what their array is made of."""
    df = spark.createDataFrame([("x", "[]", 2)], "reply_id string, raw string, n_candidates long").repartition(2)
    shown = spark.createDataFrame([("x", 0, "a")], "reply_id string, candidate long, target_id string")
    plan = replies.parse_decisions(df, shown)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace") < 10 and plan.count("parseJson") <= 2


def test_decision_replies(spark):
    entry = '{{"candidate":{},"action":"{}","target_ids":{},"rationale":"r"}}'
    cases = {
        "array": "[" + ",".join([entry.format(0, "store", "[]"), entry.format(1, "update", '["a"]')]) + "]",
        "repeat": "[" + ",".join([entry.format(0, "update", '["zz"]'), entry.format(0, "skip", "[]"), entry.format(0, "store", "[]")]) + "]",
        "lines": entry.format(1, "merge", '["a","b"]') + ",\n" + entry.format(7, "store", "[]"),
        "bad": "[" + ",".join([entry.format(0, "merge", '["a"]'), entry.format(1, "merge", '["a","a"]')]) + "]",
        "types": "[" + ",".join([entry.format(0, "update", "[5]"), entry.format('"1"', "store", "[]")]) + "]",
        "prose": "no json here",
    }
    df = spark.createDataFrame([(k, v, 2) for k, v in cases.items()], "reply_id string, raw string, n_candidates long")
    shown = spark.createDataFrame([(k, c, t) for k in cases for c in (0, 1) for t in "ab"], "reply_id string, candidate long, target_id string")
    decisions, unresolved, repeats = replies.parse_decisions(df, shown)
    got = {(r.reply_id, r.candidate): (r.action, list(r.targets)) for r in decisions.collect()}
    assert got == {
        ("array", 0): ("store", []), ("array", 1): ("update", ["a"]), ("repeat", 0): ("skip", []), ("lines", 1): ("merge", ["a", "b"]),
    }
    assert unresolved.count() == 12 - len(got)
    assert {(r.reply_id, r.candidate, r.n) for r in repeats.collect()} == {("repeat", 0, 3)}
    one = spark.createDataFrame([("x", 'ok: {"action":"skip","target_ids":[]} done'), ("y", "nope")], "reply_id string, raw string")
    single = {r.reply_id: (r.reason, r.action) for r in replies.parse_single_decisions(one, shown).collect()}
    assert single["x"] == (None, "skip") and single["y"][0] == "no_object"


def test_reconcile_repeats_until_no_clash(spark):
    schema = "pass_id string, position long, action string, new_id string, targets array<string>"
    rows = [("p", 0, "update", "n0", ["a"]), ("p", 1, "merge", "n1", ["a", "b"]), ("p", 2, "update", "n2", ["b"]), ("p", 3, "update", "a2", ["c"]),
            ("q", 0, "update", "a", ["a"]), ("q", 1, "update", "n9", ["a"])]
    df = spark.createDataFrame(rows, schema)
    kept, again = distill.claim_targets(df)
    assert {(r.pass_id, r.position, tuple(r.clash)) for r in again.collect()} == {("p", 1, ("a",))}

    def take_b(turn):
        return turn.withColumns({"action": F.lit("update"), "targets": F.array_except("targets", "clash")}).withColumn(
            "action", F.when(F.size("targets") == 0, "skip").otherwise("update")
        )

    final = {(r.pass_id, r.position): (r.action, list(r.targets)) for r in distill.reconcile(df, take_b).collect()}
    assert final[("p", 1)] == ("update", ["b"]) and final[("p", 2)] == ("skip", []) and final[("q", 1)] == ("update", ["a"])


def replay(passes, effects):
    out = {}
    for scene in {e["scene_id"] for e in effects}:
        mine = {e["place"]: e for e in effects if e["scene_id"] == scene}
        base = next((p for p in sorted(mine) if mine[p]["effect"] == "created" and mine[p]["before"] == 0 and len(mine[p]["added"]) == mine[p]["after"]), None)
        members, quality = [], "complete"
        for place in range(1, passes + 1):
            e = mine.get(place)
            if base is None or place < base:
                if e:
                    out[(scene, place)] = ("unavailable", 0, 0)
                continue
            if e is None:
                quality = "partial"
                continue
            start = list(members)
            if e["before"] != len(members) or any(a not in members for a in e["removed"]) or any(a in members for a in e["added"]):
                quality = "partial"
            members = [a for a in members if a not in e["removed"]]
            members += [a for a in e["added"] if a not in members]
            if e["after"] != len(members):
                quality = "partial"
            out[(scene, place)] = (quality, len(start), len(members))
    return out


def test_membership_replay_equals_fold(spark):
    rng = random.Random(11)
    passes, effects = 14, []
    for scene in range(30):
        members = set()
        for place in range(1, passes + 1):
            if rng.random() < 0.08:
                continue
            gone = {a for a in members if rng.random() < 0.3}
            new = {f"a{rng.randrange(12)}" for _ in range(rng.randrange(4))} - (members if rng.random() < 0.95 else set())
            after = (members - gone) | new
            odd = rng.random() < 0.05
            effects.append({
                "scene_id": f"s{scene}", "place": place, "effect": "created" if not members else "updated",
                "before": len(members) + odd, "after": len(after), "added": sorted(new), "removed": sorted(gone),
            })
            members = after
    fx = spark.createDataFrame(
        [(f"p{e['place']}", e["scene_id"], e["effect"], e["before"], e["after"], len(e["added"])) for e in effects],
        "pass_id string, scene_id string, effect string, members_before long, members_after long, n_added long",
    )
    moves = spark.createDataFrame(
        [(f"p{e['place']}", e["scene_id"], a, c) for e in effects for c in ("added", "removed") for a in e[c]],
        "pass_id string, scene_id string, atom_id string, change string",
    )
    order = spark.createDataFrame([(f"p{n}", n) for n in range(1, passes + 1)], "pass_id string, place long")
    quality, members = audit.replay_membership(order, fx, moves)
    got = {(r.scene_id, r.place): (r.quality, r.before, r.after) for r in quality.collect()}
    assert got == replay(passes, effects)
    for at in (5, passes):
        live = members.where((F.col("from_place") <= at) & (F.col("to_place").isNull() | (F.col("to_place") > at)))
        sizes = {r.scene_id: r["count"] for r in live.groupBy("scene_id").count().collect()}
        for (scene, place), (state, _, after) in got.items():
            if place == at and state != "unavailable":
                assert sizes.get(scene, 0) == after


def test_latency_tags_equal_brute_force(spark):
    rng = random.Random(2)
    spans = [("hot" if rng.random() < 0.6 else "cold", s, s + rng.choice([0, 3, 40, 900])) for s in (rng.randrange(2000) for _ in range(60))]
    seen = [(n, rng.choice(["hot", "cold", "none"]), rng.randrange(2100), 1.0) for n in range(500)]
    got = latency.tag_active(
        spark.createDataFrame(seen, "event_id long, store_key string, obs_s long, ms double"),
        spark.createDataFrame(spans, "store_key string, start_s long, end_s long"), block_s=100,
    )
    want = {n: any(k == s and a <= t < b for s, a, b in spans) for n, k, t, _ in seen}
    assert {r.event_id: r.active for r in got.collect()} == want


def test_histogram_edges(spark):
    values = [0.0, 4.999, 5.0, 60000.0, 1e9, -1.0, float("nan"), float("inf")]
    rows = {r.bin: r.n for r in latency.histogram(spark.createDataFrame([(v,) for v in values], "ms double")).collect()}
    assert len(rows) == 14 and rows[0] == 2 and rows[1] == 1 and rows[13] == 2 and sum(rows.values()) == 5


def test_attempt_ledger_states(spark):
    rows = [("dead", n, "failed") for n in range(8)] + [("slow", 0, "failed"), ("slow", 1, "failed"), ("run", 0, "running"), ("ok", 0, "failed"), ("ok", 1, "done")]
    df = spark.createDataFrame([(j, n, o, 1000 + n, "t:self") for j, n, o in rows], "job_id string, attempt_key long, outcome string, at_s long, store_key string")
    got = {r.job_id: r for r in inventory.attempt_ledger(df, 5000).collect()}
    assert got["dead"].status == "dead" and got["slow"].status == "pending" and got["slow"].due_s == 1001 + 60
    assert got["run"].stale_lease and got["ok"].status == "done"


def test_registry_and_vectors(spark):
    pools = spark.createDataFrame(
        [("a", "a", {"t": "read"}, "x", "x"), ("b", "c", {"t": "read"}, "x", "x"), ("d", "d", {"t": "write"}, "x", "x"), ("e", "e", None, "x", "x"), ("f", "f", {}, None, "x")],
        "key string, name string, members map<string,string>, created_at string, updated_at string",
    )
    verdicts = {r.key: r.verdict for r in checks.check_registry(pools).collect()}
    assert verdicts == {"a": "ok", "b": "name_mismatch", "d": "bad_access", "e": "members_missing", "f": "bad_dates"}


def test_usage_flip_voids_the_report(spark):
    items = spark.createDataFrame([("r", "T1", "a", "used"), ("r", "T1", "b", "unknown")], "recall_id string, tier string, item_id string, usage string")
    reports = spark.createDataFrame(
        [("p1", "r", "T1", "a", "unused"), ("p1", "r", "T1", "b", "used"), ("p2", "r", "T1", "b", "used"), ("p2", "r", "T1", "a", "used"),
         ("p3", "r", "T1", "b", "used"), ("p3", "r", "T1", "b", "unused")],
        "report_id string, recall_id string, tier string, item_id string, target string",
    )
    updated, unchanged, rejected = usage.apply_usage(reports, items)
    assert [(r.report_id, r.item_id) for r in updated.collect()] == [("p2", "b")]
    assert [(r.report_id, r.item_id) for r in unchanged.collect()] == [("p2", "a")]
    assert {(r.report_id, r.reason) for r in rejected.collect()} == {("p1", "conflict"), ("p3", "conflict")}


def test_snapshot_and_manifest(spark, views, tmp_path):
    path = str(tmp_path / "snap")
    manifest = snapshot.snapshot({"turns": views.turns, "core": views.core}, path)
    found = snapshot.manifest_of(spark, f"{path}/data")
    assert {r.verdict for r in snapshot.verify_manifest(manifest, found).collect()} == {"ok"}
    assert spark.read.parquet(f"{path}/data/turns").count() == views.turns.count()
    one = manifest.first()
    target = pathlib.Path(f"{path}/data/{one.path}")
    (target.parent / f".{target.name}.crc").unlink()  # the local file system's own check would stop the read
    with target.open("ab") as f:
        f.write(b"x")
    damaged = snapshot.verify_manifest(manifest, snapshot.manifest_of(spark, f"{path}/data"))
    assert [r.path for r in damaged.where("verdict = 'size'").collect()] == [one.path]


def test_episode_without_evidence(spark):
    evidence = spark.createDataFrame([("k", "a", "t1")], "store_key string, atom_id string, stream_id string")
    turns = spark.createDataFrame([("k", "t1", "s1")], "store_key string, id string, session_id string")
    atoms = spark.createDataFrame([("k", "a", "active")], "store_key string, id string, status string")
    gone = "episode:" + hashlib.sha256(b"s2").hexdigest()[:24]
    previous = spark.createDataFrame([("k", gone, "a")], "store_key string, scene_id string, atom_id string")
    for flag, count in ((False, 1), (True, 2)):
        effects = scenes.episodes(evidence, turns, atoms, previous, previous.select("store_key", "scene_id"), flag)[1].collect()
        assert len(effects) == count and ({r.effect for r in effects} == {"created", "retired"}) == flag


def test_requests_and_deletes_stay_in_their_store(spark):
    atoms = spark.createDataFrame([("a", "x", "active"), ("b", "x", "active")], "store_key string, id string, status string")
    requests = spark.createDataFrame(
        [(1, "a", "archive", "x"), (2, "a", "archive", "x"), (3, "b", "supersede", "x"), (4, "b", "archive", "x")],
        "request_id long, store_key string, op string, atom_id string")
    got = {tuple(r) for r in lifecycle.lifecycle_changes(requests, atoms).collect()}
    assert got == {(1, "x", "a", "archived"), (3, "x", "b", "superseded")}
    edges = spark.createDataFrame([("a", "x", "t"), ("b", "x", "t")], "store_key string, atom_id string, stream_id string")
    members = spark.createDataFrame([("a", "s", "x"), ("b", "s", "x")], "store_key string, scene_id string, atom_id string")
    left = lifecycle.delete_atoms(atoms.where("store_key = 'a'"), atoms, edges, members)
    assert [[r.store_key for r in df.collect()] for df in left] == [["b"], ["b"], ["b"]]


def test_a_trace_shows_only_its_own_store(spark):
    atoms = spark.createDataFrame(
        [("a", "x", "archived", "old of a"), ("b", "x", "active", "text of b"), ("b", "y", "active", "only b")],
        "store_key string, id string, status string, content string")
    scenes_ = spark.createDataFrame([], "store_key string, scene_id string, status string, scene_kind string, title string, summary string")
    core = spark.createDataFrame([], "store_key string, content string")
    items = spark.createDataFrame(
        [("r1", "a", 0, "T1", "ranked", "x"), ("r1", "a", 1, "T1", "ranked", "y"), ("r2", "b", 0, "T1", "ranked", "x")],
        "recall_id string, store_key string, ordinal long, tier string, source string, item_id string")
    shown, stale = usage.reconstruct(items, atoms, scenes_, core)
    texts = {r.recall_id: r.context for r in shown.collect()}
    assert texts["r1"] == "" and "text of b" in texts["r2"]
    assert {(r.item_id, r.reason) for r in stale.collect()} == {("x", "archived"), ("y", "not_found")}


def test_writes_of_a_batch_count_in_order(spark):
    columns = "store_key string, id string, type string, content string, confidence string, at long"
    new = spark.createDataFrame(
        [("a", "x", "fact", "one", "high", 2), ("a", "x", "fact", "two", "high", 3), ("a", "x", "fact", "one", "low", 4),
         ("b", "x", "fact", "two", "high", 1)], columns)
    changes, rejected = ingest.upsert_atoms(new, new.limit(0), order="at")
    assert {(r.store_key, r["at"], r.op) for r in changes.collect()} == {("a", 2, "insert"), ("a", 4, "update"), ("b", 1, "insert")}
    assert [(r.store_key, r.reason) for r in rejected.collect()] == [("a", "content_immutable")]


def test_a_turn_sent_again_is_a_duplicate(spark):
    columns = "arrival long, id string, store_key string, session_id string, turn_index long, turn_id string, content string"
    new = spark.createDataFrame([(1, "t", "a", "s", 0, "k", "x"), (2, "t", "a", "s", 0, "k", "x"), (3, "u", "a", "s", 1, "l", "y")], columns)
    accepted, duplicates, conflicts = ingest.ingest_turns(new, new.limit(0))
    assert [r.arrival for r in accepted.orderBy("arrival").collect()] == [1, 3] and not conflicts.collect()
    assert [(r.arrival, r.kept_id) for r in duplicates.collect()] == [(2, "t")]
    again, duplicates, _ = ingest.ingest_turns(new, new.where("arrival = 1"))
    assert [r.id for r in again.collect()] == ["u"] and duplicates.count() == 2


def test_usage_reports_of_a_batch_count_in_order(spark):
    items = spark.createDataFrame([("r", "T1", "a", "unknown"), ("r", "T1", "b", "unknown")], "recall_id string, tier string, item_id string, usage string")
    reports = spark.createDataFrame(
        [("p1", "r", "T1", "a", "used"), ("p2", "r", "T1", "a", "unused"), ("p2", "r", "T1", "b", "used"), ("p3", "r", "T1", "b", "unused"),
         ("p4", "r", "T1", "a", "used")], "report_id string, recall_id string, tier string, item_id string, target string")
    updated, unchanged, rejected = usage.apply_usage(reports, items)
    assert {(r.report_id, r.item_id) for r in updated.collect()} == {("p1", "a"), ("p3", "b")}
    assert [r.report_id for r in unchanged.collect()] == ["p4"] and [r.report_id for r in rejected.collect()] == ["p2"]


def test_case_export_moves_no_text_with_decisions(spark, views):
    v = views
    found = export.export_cases(v.decision_rows, v.passes, v.decision_targets, v.atom_evidence, v.turns, v.atoms)
    plan = found.cases._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # no list of texts is built for the case rows
    some = found.cases.where(F.crc32("decision_id") % 50 == 0)
    cases = {r.decision_id: r for r in some.collect()}
    nested = {r.decision_id: r for r in export.case_documents(export.Cases(some, found.evidence, found.existing)).collect()}
    assert set(cases) == set(nested) and any(c.n_existing > 1 for c in cases.values()) and any(c.resulting_atom_id is None for c in cases.values())
    for key, case in cases.items():
        turns, named = nested[key].input_evidence or [], nested[key].existing_atoms or []
        assert (case.n_evidence, case.n_existing) == (len(turns), len(named))
        assert case.existing_chars == sum(len(a.content or "") for a in named)
        assert [t.place for t in turns] == list(range(1, len(turns) + 1))
