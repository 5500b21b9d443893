"""Operators whose rows are shuffled no more often than their work needs."""

import re

from tiermem.operators import audit, distill, embedding, joins


def plan(df):
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(df):
    return re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*)\)", plan(df))


def test_void_passes_meet_once(spark):
    rows = [
        ("p1", 0, "a", "active", False), ("p1", 1, "b", None, False),        # missing
        ("p2", 0, "a", "merged", False), ("p2", 1, "c", None, False),        # inactive before missing
        ("p3", 0, "a", "active", False), ("p3", 2, "a", "active", False),    # retired by an earlier decision
        ("p4", 0, "a", "active", True), ("p4", 2, "a", "active", False),     # kept under its own id first
        ("p5", 1, "a", "active", False), ("p5", 1, "b", "active", False),
    ]
    targets = spark.createDataFrame(rows, "pass_id string, position long, target_id string, status string, own boolean")
    void = distill.void_passes(targets)
    assert len(shuffles(void)) == 1
    assert {r.pass_id: r.reason for r in void.collect()} == {"p1": "missing", "p2": "inactive", "p3": "repeated"}


def test_decision_lookups_shuffle_numbers(views):
    for df in (views.target_states, views.decision_rows):
        keys = [k for k in shuffles(df) if "atom_doc" in k or "target_doc" in k]
        assert keys and not any("store_key" in k for k in keys)
    assert "content" not in views.atom_keys.columns


def test_edges_are_made_distinct_once(views):
    ops = views.decision_rows.withColumn("new_id", views.decision_rows["id"])
    window = views.turns.selectExpr("store_key", "'pass-1' AS pass_id", "id AS stream_id")
    edges = distill.apply_decisions(ops, views.decision_targets, window, views.atom_evidence)[1]
    assert not any(re.search(r"new_id#\d+", key) for key in shuffles(edges))


def test_gone_targets_have_no_age(views, spark):
    targets = spark.createDataFrame(
        [("s", "p", "d1", "update", "a", 60), ("s", "p", "d2", "update", "gone-1", None)],
        "store_key string, pass_id string, decision_id string, action string, target_id string, created_s long")
    passes = spark.createDataFrame([("s", "p", 180)], "store_key string, pass_id string, started_s long")
    assert [(r.decision_id, r.age_minutes) for r in joins.target_ages(targets, passes).collect()] == [("d1", 2.0)]
    ages = shuffles(joins.target_ages(views.target_states, views.passes))
    assert not any("target_id" in key for key in ages)


def test_texts_are_cut_before_they_join(spark):
    turns = spark.createDataFrame(
        [("s", "t1", "x", "user", "é" * 7), ("s", "t2", "x", "user", "short")], "store_key string, id string, session_id string, role string, content string")
    rows = spark.createDataFrame([("s", "t1"), ("s", "t2"), ("s", "t1")], "store_key string, stream_id string")
    shown = joins.with_evidence_text(rows, turns, 6)
    assert sorted((r.stream_id, r.content, r.truncated) for r in shown.collect()) == [
        ("t1", "é" * 6 + "…", True), ("t1", "é" * 6 + "…", True), ("t2", "short", False)]
    above = plan(joins.with_evidence_text(rows, turns, 6)).split("Join")[0]
    assert "substring" not in above


def test_refresh_embeds_only_changed_texts(spark, tmp_path):
    rows = [("scenes", "s", "a", "h1", "one"), ("scenes", "s", "b", "h2", "two"), ("scenes", "s", None, "h3", "none"),
            ("turns", "s", "t", "", "turn"), ("scenes", "s", "n", None, "null")]
    texts = spark.createDataFrame(rows, "tier string, store_key string, id string, render_hash string, body string")
    table = embedding.VectorTable(spark, str(tmp_path / "vectors"))
    table.swap(texts, "m", embedding.folding_model(4), 4)
    later = texts.where("id <> 'b' OR id IS NULL").unionByName(
        spark.createDataFrame([("scenes", "s", "b", "h9", "new")], texts.schema))
    seen = []
    real, embedding.embed = embedding.embed, lambda given, *rest: seen.append(given) or real(given, *rest)
    try:
        table.swap(later, "m", embedding.folding_model(4), 4)
    finally:
        embedding.embed = real
    assert sorted(r.body for r in seen[0].collect()) == ["new", "none", "null", "turn"]
    assert sorted((r.id or "") for r in table.read().collect()) == sorted(["a", "b", "", "t", "n"])
    assert "LeftAnti" not in plan(seen[0])  # texts meet the keys of what changed, not all kept keys


def test_atom_texts_are_the_atoms(views):
    columns = ["store_key", "id", "src_doc_id", "type", "content", "status", "created_s"]
    assert sorted(map(str, views.atom_texts.select(columns).collect())) == sorted(map(str, views.atoms.select(columns).collect()))
    assert "Aggregate" not in plan(views.atom_texts)


def test_scene_texts_and_trace_lookups(views):
    columns = ["store_key", "scene_id", "scene_kind", "title", "summary", "status"]
    assert sorted(map(str, views.scene_texts.select(columns).collect())) == sorted(map(str, views.scenes.select(columns).collect()))
    assert shuffles(views.scene_texts) == []
    assert not any("store_key" in key for key in shuffles(views.trace_refs))


def test_moves_without_a_clean_creation_leave_first(spark):
    order = spark.createDataFrame([("p1", 1), ("p2", 2)], "pass_id string, place long")
    fx = spark.createDataFrame(
        [("p1", "a", "created", 0, 1, 1), ("p2", "a", "updated", 1, 2, 1), ("p1", "b", "updated", 3, 4, 1)],
        "pass_id string, scene_id string, effect string, members_before long, members_after long, n_added long")
    moves = spark.createDataFrame(
        [("p1", "a", "x", "added"), ("p2", "a", "y", "added"), ("p1", "b", "z", "added")], "pass_id string, scene_id string, atom_id string, change string")
    for given in (fx, fx.join(order, "pass_id")):
        quality, members = audit.replay_membership(order, given, moves)
        assert {(r.scene_id, r.place): (r.quality, r.before, r.after) for r in quality.collect()} == {
            ("a", 1): ("complete", 0, 1), ("a", 2): ("complete", 1, 2), ("b", 1): ("unavailable", 0, 0)}
        assert sorted((r.scene_id, r.atom_id, r.from_place, r.to_place) for r in members.collect()) == [("a", "x", 1, None), ("a", "y", 2, None)]
        assert "LeftSemi" in plan(audit.replay_membership(order, given, moves)[1])


def test_states_of_plain_targets(spark):
    targets = spark.createDataFrame(
        [("s", "p1", 0, "a", "a"), ("s", "p1", 1, "a", "n"), ("s", "p2", 0, "b", "n"), ("s", "p3", 0, "gone", "n"), ("t", "p4", 0, "a", "n")],
        "store_key string, pass_id string, position long, target_id string, new_id string")
    atoms = spark.createDataFrame([("s", "a", "active"), ("s", "b", "merged")], "store_key string, id string, status string")
    void = distill.void_passes(distill.target_states(targets, atoms))
    assert {r.pass_id: r.reason for r in void.collect()} == {"p2": "inactive", "p3": "missing", "p4": "missing"}
