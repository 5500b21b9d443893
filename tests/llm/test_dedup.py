"""Joins, dedup and search against brute force."""

import collections
import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tiermem.llm import catalog, components, jaccard_join, near_vectors, suffix_dedup, top_k

SMALL = "/root/testdata/sf0.001"


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def shingles(text, words):
    found = (text or "").encode().lower().split()
    width = min(words, len(found))
    return {tuple(found[i:i + width]) for i in range(len(found) - width + 1)} if found else set()


def brute_classes(texts, words, percent):
    sets = {i: shingles(t, words) for i, t in texts.items()}
    union = Union()
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    return {i: (len(sets[i]), union.root(i)) for i in ids}


def test_jaccard_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in catalog.QUERIES["op2_ngram_jaccard_join"](spark, SMALL).collect()}
    assert got == brute_classes(texts, 3, 90)


def near_family(seed=3, copies=90, length=60):
    """Copies of one text with chance edits, some linked only through others, among short and equal texts."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, length)]
    texts = {}
    for i in range(copies):
        words = list(base)
        for at in rng.integers(0, length, rng.integers(0, 7)):
            words[at] = f"e{rng.integers(0, 9)}"
        texts[i] = " ".join(words[:length - int(rng.integers(0, 4))])
    texts |= {200: "one", 201: "ONE", 202: "one two", 203: "one  two", 204: None, 205: "", 206: " \t", 207: "é é é", 208: "É É É"}
    return texts


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_families(spark, monkeypatch, words, percent):
    monkeypatch.setattr(jaccard_join, "MEMBERS", 7)
    monkeypatch.setattr(jaccard_join, "QUERIES", 5)
    texts = near_family()
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, n long, sig string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(rows, words, percent).collect()}
    assert got == brute_classes(texts, words, percent)


def test_jaccard_odd_rows(odd_docs, no_docs):
    got = [(r.doc_id, r.component_id) for r in jaccard_join.classes(odd_docs).collect()]
    assert len(got) == 14 and dict(got)[2] == 1 and got.count((9, 9)) == 2 and dict(got)[4] == 4
    assert jaccard_join.classes(no_docs).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: union.root(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def brute_removal(texts, length):
    """Spans a document repeats of documents with smaller ids; ``texts`` are (id, bytes)."""
    first = {}
    for i, raw in texts:
        for at in range(len(raw) - length + 1):
            key = raw[at:at + length]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, raw in texts:
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - length + 1):
            if first[raw[at:at + length]] < i:
                gone[at:at + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(out)


def removed(rows, length):
    got = suffix_dedup.dedup(rows, length).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got if r.doc_id is not None)


def test_suffix_query(spark):
    texts = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = [(i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in brute_removal(texts, 50)]
    got = catalog.QUERIES["op5_suffix_array_dedup"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("length,crowded", [(50, 5000), (12, 5000), (12, 1), (50, 1)])
def test_suffix_mosaics(spark, monkeypatch, length, crowded):
    """Texts pieced together from few parts: many anchors with many contexts, runs of one byte, touching spans."""
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rng = np.random.default_rng(length + crowded)
    parts = ["the line that all share, word for word, here: ", "z" * 70, "ab" * 40, "é" * 33] + ["".join(map(chr, rng.integers(97, 101, 25))) for _ in range(12)]
    texts = [(int(i), "".join(rng.choice(parts, rng.integers(1, 14)))) for i in rng.permutation(70)]
    texts += [(500, ""), (501, "short"), (502, texts[0][1]), (503, texts[1][1] + "!")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert removed(rows, length) == brute_removal([(i, t.encode()) for i, t in texts], length)


def test_suffix_odd_rows(odd_docs, no_docs):
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect() if r.doc_id is not None]
    assert removed(odd_docs, 50) == brute_removal(texts, 50)
    assert suffix_dedup.dedup(no_docs).count() == 0
    kept = suffix_dedup.dedup(odd_docs).filter("doc_id IS NULL").first()
    assert kept.n_removed == 0


def test_suffix_sort_orders_and_verifies():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, (40, 20), dtype=np.uint8)
    prefix = np.zeros((40, 21), np.uint64)
    np.cumsum(suffix_dedup.TABLE[text] * suffix_dedup.POWERS[:20], axis=1, dtype=np.uint64, out=prefix[:, 1:])
    entry, start = np.repeat(np.arange(40), 13), np.tile(np.arange(13), 40)
    least = rng.integers(0, 1000, 520)
    got = suffix_dedup._least_of_runs(prefix, text, entry, start, np.zeros(520, np.int64), least, 8)
    want = {}
    for e, s, v in zip(entry, start, least):
        key = text[e, s:s + 8].tobytes()
        want[key] = min(want.get(key, v), v)
    assert got.tolist() == [want[text[e, s:s + 8].tobytes()] for e, s in zip(entry, start)]


def vector_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * (0.18 if i % 6 else 0.5)).tolist()) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]                     # copies
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] * 4), (404, [float("nan")] * 8), (405, [float("inf")] + [1.0] * 7),
             (406, [1.0] * 3), (407, [2.0] * 3), (None, [1.0] * 8), (7, rows[7][1])]
    return rows


def test_near_vectors(spark, monkeypatch):
    for name, value in (("LIST", 4), ("ENLARGED", 9), ("LEAF", 30), ("HUB", 16), ("PACK", 20)):
        monkeypatch.setattr(near_vectors, name, value)
    rows = vector_rows()
    df = spark.createDataFrame([r + (1, 2) for r in rows], "vec_id long, embedding array<double>, node int, component int").repartition(3)
    got = near_vectors.near_classes(df, recall=1.0).collect()
    assert len(got) == len(rows)
    good = {i: np.pad(np.array(v, float), (0, 8 - len(v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    hit = x @ x.T >= 0.9
    union = Union()
    for a, b in zip(*np.nonzero(hit)):
        union.join(ids[a], ids[b])
    want = {i: (int(hit[n].sum()) - 1, union.root(i)) for n, i in enumerate(ids)}
    found = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id in want}
    reached = sum(min(found[i][0], want[i][0]) for i in want)
    assert reached >= 0.95 * sum(w[0] for w in want.values()) and all(found[i][0] <= want[i][0] for i in want)
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id not in want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert near_vectors.near_classes(df.limit(0)).count() == 0


def test_near_vectors_query_recall(spark):
    folder = "/root/testdata/sf0.01"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().set_index("vec_id")
    got = catalog.QUERIES["op3_embedding_near_dedup"](spark, folder).toPandas().set_index("vec_id")
    x = np.stack(vectors.embedding).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert (got.loc[vectors.index].n_links.values == (x @ x.T >= 0.9).sum(1) - 1).all()


def test_suffix_dedup_rows_of_one_id(spark):
    """A row is a copy by its text, not by its id: another text under the same id stays."""
    a, b = ("Winter brings long nights that travellers in the hills know too well. " * 2, "Nobody else in this table has ever written down these words about the sea. " * 2)
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, bytes(r.kept).decode()) for r in suffix_dedup.dedup(rows).collect())
    assert got == [(3, 0, a), (5, 0, b), (5, len(a), ""), (7, len(b), "")]


def test_top_k_query(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = sorted(duck.execute(catalog.ORACLES["op9_exact_top_k"]).fetchall())
    got = sorted(map(tuple, catalog.QUERIES["op9_exact_top_k"](spark, SMALL).collect()))
    assert got == want and len(got) == 25 * 20


@pytest.mark.parametrize("scale", [3, 10**7])
def test_top_k_blocks_ties_and_odd_sides(spark, monkeypatch, scale):
    for name, value in (("SLAB", 50), ("BLOCK", 8), ("QUERIES", 6)):
        monkeypatch.setattr(top_k, name, value)
    rng = np.random.default_rng(4)
    rows = [(int(i), [int(v) * scale for v in rng.integers(-2, 3, 5)]) for i in range(170)] + [(5, [9 * scale] * 5), (900, [1]), (901, [])]
    df = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, weights array<bigint>, score string")
    least = {}
    for i, w in rows:
        least[i] = min(least.get(i, w), w)
    queries = df.filter("vec_id % 7 = 0")
    got = sorted(map(tuple, top_k.search(df, queries, k=6).collect()))
    want = []
    for q in sorted(i for i in least if i % 7 == 0):
        scored = sorted((-sum(a * b for a, b in zip(least[q], w)), i) for i, w in least.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:6])]
    assert got == sorted(want)
    assert top_k.search(df, queries.limit(0), k=3).count() == 0 and top_k.search(df.limit(0), queries, k=3).count() == 0


def test_top_k_visits_are_not_gathered_at_the_driver(spark):
    """Every block of queries visits every slab, so the visits grow with both; they are shuffled, however small Spark takes them for."""
    df = spark.createDataFrame([(i, [i % 7, i % 5]) for i in range(90)], "vec_id long, weights array<bigint>")
    plan = top_k.search(df, df, k=2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [number" in plan and "BroadcastHashJoin [number" not in plan


def exact_classes(x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    hit, union = x @ x.T >= threshold, Union()
    np.fill_diagonal(hit, False)
    for a, b in zip(*np.nonzero(hit)):
        union.join(int(a), int(b))
    return {i: (int(hit[i].sum()), union.root(i)) for i in range(len(x))}


def found_classes(spark, x):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    return {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_classes(df).collect()}


def test_near_vectors_isolated_pairs(spark):
    """Many pairs alone among random rows, beside one family that holds most links."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, 64))
    x[:600] = x[600:1200] + rng.normal(size=(600, 64)) * 0.45
    x[3500:] = x[3500] + rng.normal(size=(1500, 64)) * 0.2
    want = exact_classes(x)
    assert sum(want[i][0] > 0 for i in range(600)) > 300
    assert found_classes(spark, x) == want


def test_near_vectors_links_between_dense_families(spark):
    """Two families whose members all have more close neighbours inside than a list holds, and links between them."""
    rng = np.random.default_rng(7)
    centre, aside = rng.normal(size=(2, 64))
    x = np.stack([centre, centre + 0.45 * aside])[np.arange(400) % 2] + rng.normal(size=(400, 64)) * 0.08
    want = exact_classes(x)
    assert {c for _, c in want.values()} == {0} and min(k for k, _ in want.values()) > 199
    assert found_classes(spark, x) == want


def test_near_vectors_copies_pass_no_window(spark):
    """A vector that many rows hold is aggregated before it is shuffled, never ranked in one task."""
    rows = [(i, [1.0, 2.0] if i % 2 else [float(i), -1.0]) for i in range(40)]
    got = near_vectors.near_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.n_links, r.component_id) for r in got.collect() if r.vec_id % 2} == {(19, 1)}


def test_binary_columns_are_read_in_place():
    import pyarrow as pa

    part = pa.array([b"x" * 8, np.arange(3, dtype=np.uint64).tobytes(), b"", np.arange(5, 6, dtype=np.uint64).tobytes()], pa.binary())
    column = pa.chunked_array([part.slice(1, 3)])
    flat = suffix_dedup._flat(column, np.uint64)
    assert flat.tolist() == [0, 1, 2, 5] and not flat.flags.owndata
    assert suffix_dedup._flat(pa.chunked_array([part.slice(1, 1), part.slice(2, 0), part.slice(3, 1)]), np.uint64).tolist() == [0, 1, 2, 5]
    assert len(suffix_dedup._flat(pa.chunked_array([], pa.binary()), np.uint8)) == 0
