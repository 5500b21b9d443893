"""Nearest neighbours, clustering and context assembly against brute force."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tiermem.functions import vectors
from tiermem.operators import clusters, context, scenes, search
from tiermem.sources.views import AS_OF_S


def top(found, n):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return sorted(map(tuple, found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r").collect()))


def test_nearest_both_ways_equal_brute_force(views, monkeypatch):
    atoms = views.atoms.where("embedding IS NOT NULL").select("store_key", "id", "embedding").cache()
    queries = views.recall_queries.cache()
    facts = [(r.store_key, r.id, np.array(r.embedding, dtype="float64")) for r in atoms.collect()]
    want = []
    for q in queries.where("embedding IS NOT NULL").collect():
        scored = [(-round(float(np.array(q.embedding, dtype="float64") @ v), 9), i) for s, i, v in facts if s == q.store_key]
        want += [(q.query_id, i, -s) for s, i in sorted(scored)[:7]]
    assert top(vectors.nearest(queries, atoms, 7), 7) == sorted(want)
    monkeypatch.setattr(vectors, "SLICE_ROWS", 20)
    assert top(vectors.nearest(queries, atoms, 7, fixed_rows=10), 7) == sorted(want)


def sequential(points, threshold):
    out, leaders = {}, {}
    for store, name, vector in sorted(points, key=lambda p: (p[0], p[1])):
        known = leaders.setdefault(store, [])
        best = max(((round(float(vector @ v), 9), -at) for at, (_, v) in enumerate(known)), default=(-9, 0))
        if best[0] >= threshold:
            out[store, name] = known[-best[1]][0]
        else:
            known.append((name, vector))
            out[store, name] = name
    return out


def test_leader_rounds_equal_sequential_rule(views):
    atoms = views.atoms.where("embedding IS NOT NULL").select("store_key", "id", "embedding").cache()
    points = [(r.store_key, r.id, np.array(r.embedding, dtype="float64")) for r in atoms.collect()]
    for threshold, front in ((0.3, 2048), (0.3, 7), (0.6, 25)):
        got = {(r.store_key, r.atom_id): r.leader_id for r in clusters.leader_clusters(atoms, threshold, front, fixed_rows=30).collect()}
        assert got == sequential(points, threshold)


def test_stores_with_one_id_cluster_apart(spark):
    rows = [("a", "p", [1.0, 0.0]), ("a", "q", [0.0, 1.0]), ("b", "q", [1.0, 0.0]), ("b", "r", [1.0, 0.0])]
    data = spark.createDataFrame(rows, "store_key string, id string, embedding array<float>")
    got = {tuple(r)[:3] for r in clusters.leader_clusters(data, 0.9).collect()}
    assert got == {("a", "p", "p"), ("a", "q", "q"), ("b", "q", "q"), ("b", "r", "q")}


def test_vectors_of_unequal_length_are_refused(spark):
    rows = [("a", "p", [1.0, 0.0, 0.0]), ("a", "q", [1.0])]
    data = spark.createDataFrame(rows, "store_key string, id string, embedding array<float>")
    with pytest.raises(Exception):
        clusters.leader_clusters(data, 0.9).collect()


def test_near_copies_share_one_leader(spark):
    rows = [("s", f"a{n:04d}", [1.0, 0.0]) for n in range(300)] + [("s", "b", [0.0, 1.0])]
    data = spark.createDataFrame(rows, "store_key string, id string, embedding array<float>")
    got = clusters.leader_clusters(data, 0.9, front=50).groupBy("leader_id").count().collect()
    assert {(r.leader_id, r["count"]) for r in got} == {("a0000", 300), ("b", 1)}


def test_chains_and_a_hot_store_settle_by_rounds(spark):
    """Every atom waits for the one before it; another store holds nearly all rows, most of them unlike."""
    rng = np.random.default_rng(3)
    turn = np.arange(12) * 0.3
    points = [("chain", f"c{n:02d}", np.array([np.cos(a), np.sin(a), 0, 0, 0, 0, 0, 0])) for n, a in enumerate(turn)]
    many = rng.normal(size=(900, 8))
    many /= np.linalg.norm(many, axis=1)[:, None]
    points += [("hot", f"h{n:04d}", v) for n, v in enumerate(many)]
    data = spark.createDataFrame([(s, n, v.tolist()) for s, n, v in points], "store_key string, id string, embedding array<double>")
    got = {(r.store_key, r.atom_id): r.leader_id for r in clusters.leader_clusters(data, 0.9, front=4, fixed_rows=64).collect()}
    assert got == sequential(points, 0.9)
    assert len({v for (s, _), v in got.items() if s == "hot"}) > 300


def test_kept_index_equals_a_rebuild(spark, tmp_path):
    """Rows added, replaced and deleted, then compacted: postings and statistics are those of the rows that are left."""
    texts = {("a", "1"): "the red fox the end", ("a", "2"): "red red wine", ("a", "3"): "", ("b", "1"): "the fox", ("a", "4"): "Fox, fox; FOX"}
    frame = lambda rows: spark.createDataFrame([(*k, v) for k, v in rows.items()], "store_key string, id string, body string")
    index = search.LexicalIndex(spark, str(tmp_path / "index"), buckets=3)
    wanted = spark.createDataFrame([(s, t) for s in "ab" for t in ("the", "red", "fox", "wine", "none")], "store_key string, term string")
    assert index.postings(wanted).count() == 0 and index.statistics(wanted).count() == 0

    def same(rows):
        want = search.postings(frame(rows))
        got = {tuple(r) for r in index.postings(wanted).select("store_key", "id", "term", "tf", "doc_len").collect()}
        assert got == {tuple(r) for r in want.join(wanted, ["store_key", "term"], "left_semi").select("store_key", "id", "term", "tf", "doc_len").collect()}
        stats = lambda df: {(r.store_key, r.term, r.df, r.n_docs, round(r.avg_len, 9)) for r in df.collect()}
        assert stats(index.statistics(wanted)) == stats(search.term_statistics(want).join(wanted, ["store_key", "term"], "left_semi"))

    index.add(frame({k: v for k, v in texts.items() if k != ("a", "4")} | {("a", "2"): "white wine the fox"}))
    index.add(frame({("a", "2"): texts["a", "2"], ("a", "4"): texts["a", "4"], (None, "9"): "fox", ("a", None): "fox", ("a", "5"): None}))
    same(texts)
    index.delete(spark.createDataFrame([("a", "1"), ("b", "7")], "store_key string, id string"))
    left = {k: v for k, v in texts.items() if k != ("a", "1")}
    same(left)
    index.compact()
    same(left)
    index.add(frame({("a", "1"): "the fox is back"}))
    same(left | {("a", "1"): "the fox is back"})
    plan = index.postings(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "body" not in plan


def test_contexts_stay_in_budget_and_pinned_breaks(spark, views):
    done = context.assemble_context(views.recall_queries, views.atoms, views.scenes, views.core, AS_OF_S).collect()
    assert done and all(r.total_chars <= r.budget for r in done)


def empty_core(spark):
    return spark.createDataFrame([], "store_key string, content string")


ATOMS = "id string, store_key string, type string, content string, priority long, confidence string, pinned boolean, status string, created_s long, embedding array<float>"
SCENES = "scene_id string, store_key string, scene_kind string, title string, summary string, status string, updated_s long, embedding array<float>"


def test_skip_and_continue(spark):
    """A large first hit is skipped, smaller later ones still fill the tier."""
    sizes = {"a": 590, "b": 300, "c": 250, "d": 120}
    vector = {"a": [1.0, 0.0], "b": [0.9, 0.4359], "c": [0.8, 0.6], "d": [0.6, 0.8]}
    atoms = spark.createDataFrame(
        [(k, "t:self", "fact", "x" * n, 100, "low", False, "active", 0, vector[k]) for k, n in sizes.items()], ATOMS
    )
    queries = spark.createDataFrame([("q", "t:self", "nothing", [1.0, 0.0], 700)], "query_id string, store_key string, text string, embedding array<float>, budget long")
    scenes_ = spark.createDataFrame([], SCENES)
    # pinned share 140 spills into the atoms' 280: 420 characters for the tier
    row = context.assemble_context(queries, atoms, scenes_, empty_core(spark), AS_OF_S).first()
    assert [i.id for i in row.atom_items] == ["b", "d"] and row.atom_chars == 420 and row.truncated


def test_lexical_needs_every_token_and_cut_comes_before_filter(spark):
    rows = [
        ("a", "memory system dual run", "active"), ("b", "memory system", "active"), ("c", "memory system dual run again", "merged"),
    ]
    atoms = spark.createDataFrame(
        [(i, "t:self", "fact", c, 100, "low", False, s, 0, None) for i, c, s in rows], ATOMS
    )
    schema = "query_id string, store_key string, text string, embedding array<float>"
    queries = spark.createDataFrame(
        [("all", "t:self", "Memory SYSTEM dual-run", None), ("odd", "t:self", "OR NOT *", None), ("none", "t:self", "", None)], schema
    )
    asked = search.with_limit(queries, 5, 3)
    hits = {(r.query_id, r.id) for r in search.bm25_topn(asked, search.atom_docs(atoms), 15).collect()}
    assert hits == {("all", "a"), ("all", "c")}
    assert {(r.query_id, r.id) for r in search.search_atoms(queries, atoms, AS_OF_S).collect()} == {("all", "a")}


def greedy(pairs):
    taken, used = {}, set()
    for leader in sorted({p[0] for p in pairs}):
        best = min(((-j, t) for l, t, j in pairs if l == leader and t not in used), default=None)
        if best:
            taken[leader] = best[1]
            used.add(best[1])
    return taken


def test_topic_rounds_equal_greedy_order(spark):
    rng = np.random.default_rng(3)
    pairs = [(f"l{a}", f"t{b}", float(round(rng.random(), 2))) for a in range(12) for b in range(9) if rng.random() < 0.5]
    data = spark.createDataFrame([("s", *p) for p in pairs], "store_key string, leader_id string, scene_id string, jaccard double")
    assert {r.leader_id: r.scene_id for r in scenes._greedy(data).collect()} == greedy(pairs)


def test_topics_keep_reorganise_and_retire(spark):
    members = [("s", "l1", a) for a in "abcd"] + [("s", "l2", a) for a in "xy"] + [("s", "l3", "new")]
    old = [("s", "t1", a) for a in "abc"] + [("s", "t2", a) for a in "xywv"] + [("s", "t3", "gone")]
    clusters_ = spark.createDataFrame(members, "store_key string, leader_id string, atom_id string")
    topics = spark.createDataFrame(old, "store_key string, scene_id string, atom_id string")
    state, effects = scenes.match_topics(clusters_, topics, F.lit("p"), reorg=0.4)
    rows = {r.scene_id: r for r in effects.collect()}
    assert rows["t1"].effect == "updated" and rows["t1"].n_added == 1
    assert rows["t2"].effect == "retired" and rows["t2"].superseded_by.startswith("topic:")
    assert rows["t3"].effect == "retired" and rows["t3"].superseded_by is None
    made = {r.derived_from for r in effects.collect() if r.effect == "created"}
    assert made == {"t2", None} and state.count() == 7


def test_new_rows_leave_no_tombstones(spark, tmp_path):
    """Rows that replace nothing are named nowhere, so a compaction joins nothing; parts of a bucket are inverted where they were read."""
    docs = spark.createDataFrame([("a", str(i), f"word{i % 7} the the") for i in range(40)], "store_key string, id string, body string").repartition(4)
    index = search.LexicalIndex(spark, str(tmp_path / "index"), buckets=2)
    index.add(docs.where("id % 2 = 0"))
    index.add(docs.where("id % 2 = 1"))
    assert not (tmp_path / "index" / "gone").exists()
    index.compact()
    wanted = spark.createDataFrame([("a", "the"), ("a", "word3")], "store_key string, term string")
    assert {(r.term, r.df, r.n_docs, r.avg_len) for r in index.statistics(wanted).collect()} == {("the", 40, 40, 3.0), ("word3", 6, 40, 3.0)}
    assert {r.tf for r in index.postings(wanted).where("term = 'the'").collect()} == {2}
    index.delete(docs.where("id < 10").select("store_key", "id"))
    assert index.postings(wanted).where("term = 'the'").count() == 30


def test_changes_write_no_terms_but_those_they_add(spark, tmp_path, monkeypatch):
    """What goes is named; its terms are neither read nor written, and document frequencies need no table of their own."""
    from tiermem.operators import lexical_index
    cuts = []
    monkeypatch.setattr(lexical_index, "cut_lineage", lambda df: cuts.append(df.columns) or df)
    docs = spark.createDataFrame([("a", str(i), f"word{i % 7} the the") for i in range(40)] + [("b", "1", "")], "store_key string, id string, body string")
    index = search.LexicalIndex(spark, str(tmp_path / "index"), buckets=3)
    index.add(docs)
    index.delete(docs.where("id < 10").select("store_key", "id"))
    index.add(docs.where("id = 12").withColumn("body", F.lit("other words")))
    assert cuts and not any("terms" in columns for columns in cuts)
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["gone", "postings", "published", "sizes"]
    wanted = spark.createDataFrame([("a", "the"), ("a", "other"), ("b", "the")], "store_key string, term string")
    assert {(r.store_key, r.term, r.df, r.n_docs, r.avg_len) for r in index.statistics(wanted).collect()} == {
        ("a", "the", 29, 30, 89 / 30), ("a", "other", 1, 30, 89 / 30)}


def test_a_document_is_one_row_per_folder(spark, tmp_path):
    bodies = [" ".join(f"w{(n * k) % 97}" for k in range(60)) for n in range(1, 30)] + ["", "the the THE"]
    docs = spark.createDataFrame([("a" if n % 2 else "b", str(n), body) for n, body in enumerate(bodies)], "store_key string, id string, body string")
    index = search.LexicalIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(docs)
    per_document = spark.read.parquet(f"{index.path}/postings").groupBy("store_key", "id").count()
    assert per_document.count() == len(bodies) and per_document.agg({"count": "max"}).first()[0] <= 4


def test_postings_need_no_shuffle(spark):
    bodies = [" ".join(f"w{(n * k) % 97}" for k in range(60)) for n in range(1, 30)] + ["", "the the THE"]
    docs = spark.createDataFrame([("a" if n % 2 else "b", str(n), body) for n, body in enumerate(bodies)], "store_key string, id string, body string")
    found = search.postings(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(n, t, body.lower().split().count(t)) for n, body in enumerate(bodies) for t in body.lower().split()} | {(n, "", 1) for n in range(len(bodies))}
    assert {(int(r.id), r.term, r.tf) for r in found.collect()} == want
    assert {int(r.id): r.doc_len for r in found.collect()} == {n: len(body.split()) for n, body in enumerate(bodies)}


def test_only_named_texts_are_rendered(spark, views):
    items = spark.createDataFrame(
        [("q", "a", 0, "T1", "pinned", "x", 2, None), ("q", "a", 1, "T2", "scene", "s", 5, 0.5), ("q", "a", 2, "T3", "core", "core", 3, None)],
        "query_id string, store_key string, ordinal long, tier string, source string, item_id string, chars long, score double")
    atoms = spark.createDataFrame([("a", "x", "hi"), ("b", "x", "no"), ("a", "y", "no")], "store_key string, id string, content string")
    scenes = spark.createDataFrame([("a", "s", "topic", "T", "sum"), ("b", "s", "topic", "U", None)], "store_key string, scene_id string, scene_kind string, title string, summary string")
    core = spark.createDataFrame([("a", "abc")], "store_key string, content string")
    found = context.context_texts(items, atoms, scenes, core)
    assert {r.item_id: r.body for r in found.collect()} == {"x": "hi", "s": "[topic] T\nsum", "core": "abc"}
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
