"""The model hook and the swap of vector versions."""

import os

import numpy as np

from pyspark.sql import functions as F

from tiermem.functions.vectors import hash_embed
from tiermem.operators import embedding

TEXT = "tier string, store_key string, id string, render_hash string, body string"


def test_one_load_per_worker_and_failed_rows_apart(spark):
    loads = spark.sparkContext.accumulator(0)
    name = f"counted-{os.getpid()}"

    def load():
        loads.add(1)

        def model(bodies):
            if any("bad" in b for b in bodies):
                raise ValueError("cannot read this")
            return np.array([[len(b), np.nan if b == "odd" else 1.0] for b in bodies])
        return model

    rows = [(i, "bad text" if i % 50 == 7 else "odd" if i == 3 else "x" * (i % 5) if i % 4 else None) for i in range(400)]
    data = spark.createDataFrame(rows, "id int, body string").repartition(16)
    found = {r.id: (r.embedding, r.error) for r in embedding.embed(data, ["id"], name, load, 2, batch=16).collect()}
    assert len(found) == 400 and 1 <= loads.value <= 4  # 16 tasks on 4 workers
    for i, body in rows:
        want = (None, "ValueError: cannot read this") if body == "bad text" else (None, "not finite") if body == "odd" else ([float(len(body or "")), 1.0], None)
        assert found[i] == want
    assert embedding.embed(data.limit(0), ["id"], name, load, 2).count() == 0
    short = embedding.embed(data.limit(5), ["id"], name + "s", lambda: lambda bodies: [[1.0]] * len(bodies), 2)
    assert {r.error for r in short.collect()} == {"wrong length"}


def test_folding_model_is_the_hash_embedder(spark):
    data = spark.createDataFrame([(i, t) for i, t in enumerate(["", "ab", "The red fox 日本 ü" * 9, None])], "id int, body string")
    got = embedding.embed(data, ["id"], "fold-8", embedding.folding_model(8), 8).join(data.select("id", hash_embed(F.col("body"), 8).alias("own")), "id").collect()
    assert len(got) == 4 and all(np.allclose(r.embedding, r.own, atol=1e-6) for r in got)


def test_swap_publishes_whole_versions_only(spark, tmp_path):
    rows = [("turns", "a", "t1", "", "hello"), ("scenes", "a", "s1", "h1", "one"), ("scenes", "a", "s2", "h2", "two")]
    texts = spark.createDataFrame(rows, TEXT)
    table = embedding.VectorTable(spark, str(tmp_path / "vectors"))
    assert table.swap(texts, "m1", lambda: lambda b: np.ones((len(b), 2)), 2).count() == 0
    before = table.current()
    dead = lambda: lambda b: (_ for _ in ()).throw(RuntimeError("down"))
    assert {r.error for r in table.swap(texts, "m2", dead, 3).collect()} == {"RuntimeError: down"}
    assert table.current() == before and {tuple(r.embedding) for r in table.read().collect()} == {(1.0, 1.0)}
    some = lambda: lambda b: np.full((len(b), 3), np.nan) if b == ["hello"] else (_ for _ in ()).throw(RuntimeError()) if "hello" in b else np.ones((len(b), 3))
    assert [r.id for r in table.swap(texts, "m3", some, 3, failed=0.5).collect()] == ["t1"]
    assert table.current()[0] == 2 and table.current()[2] == "m3"
    # a refresh by the same model asks for turns, for what has no vector, and for scenes with a new hash
    note = str(tmp_path / "asked")

    def counting():
        def model(bodies):
            with open(note, "a") as out:
                out.write("x" * len(bodies))
            return np.full((len(bodies), 3), 2.0)
        return model

    changed = spark.createDataFrame(rows[:2] + [("scenes", "a", "s2", "h3", "two more")], TEXT)
    table.swap(changed, "m3", counting, 3)
    got = {r.id: r.embedding[0] for r in table.read().where("embedding IS NOT NULL").collect()}
    assert got["s1"] == 1.0 and "s2" in got
    before = os.path.getsize(note) if os.path.exists(note) else 0
    table.swap(changed, "m4", counting, 3)
    assert os.path.getsize(note) == before + 3
    table.swap(changed, "m4", counting, 3)
    assert os.path.getsize(note) == before + 4  # the turn, which has no hash
    got = {r.id: r.embedding[0] for r in table.read().collect()}
    assert set(got) == {"t1", "s1", "s2"} and table.read().where("error IS NOT NULL").count() == 0
