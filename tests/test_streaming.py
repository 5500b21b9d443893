"""Batch results and streaming results agree; replays change nothing."""

import os

import pytest
from pyspark.sql import functions as F

from tiermem.operators import distill, ingest
from tiermem.streaming import incremental, keyed, rolling


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def stream_of(spark, df, folder, parts, key):
    """Write ``df`` as ``parts`` files in key order and read them one per micro-batch."""
    for n in range(parts):
        df.where(F.col("_part") == n).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    files = sorted((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getmtime)
    for at, path in enumerate(files):
        os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_turn_stream_equals_batch(spark, views, tmp_path):
    rows = views.incoming_turns.withColumn("_part", F.floor(F.col("arrival") / 10**12).cast("int"))
    stream = stream_of(spark, rows, str(tmp_path / "in"), 4, "arrival")
    got = sorted((r.id, r.verdict) for r in drain(keyed.ingest_turn_stream(stream), "turn_verdicts").collect())
    accepted, duplicates, conflicts = ingest.ingest_turns(views.incoming_turns, views.turns.limit(0))
    want = [(r.id, "accepted") for r in accepted.collect()] + [(r.id, "duplicate") for r in duplicates.collect()]
    want += [(r.id, r.reason) for r in conflicts.collect()]
    assert got == sorted(want) and len(got) == rows.count()


EVENTS = [
    ("m1", "s", 1, "part", None, "hel"), ("m1", "s", 2, "part", None, "hello"), ("m1", "s", 3, "settled", "assistant", None),
    ("m1", "s", 4, "part", None, "hello again"),
    ("m2", "s", 1, "settled", "user", None), ("m2", "s", 5, "part", None, " late "), ("m2", "s", 6, "part", None, "later"),
    ("m3", "s", 1, "part", None, "   "), ("m3", "s", 2, "settled", "user", None),
    ("m4", "s", 1, "part", None, "never settled"),
    ("m5", "s", 1, "part", None, " "), ("m5", "s", 2, "settled", "user", None), ("m5", "s", 3, "settled", "assistant", None),
    ("m5", "s", 7, "part", None, "x"),
]
SETTLED = {("m1", "assistant", "hello"), ("m2", "user", "late"), ("m5", "assistant", "x")}


def test_settle_messages(spark, tmp_path):
    schema = "message_id string, session_id string, event_seq long, kind string, role string, text string"
    events = spark.createDataFrame(EVENTS, schema)
    assert {(r.message_id, r.role, r.content) for r in keyed.settle_messages(events).collect()} == SETTLED
    parts = events.withColumn("_part", F.when(F.col("event_seq") < 3, 0).when(F.col("event_seq") < 5, 1).otherwise(2))
    stream = stream_of(spark, parts, str(tmp_path / "ev"), 3, "event_seq")
    out = drain(keyed.settle_message_stream(stream), "settled")
    assert {(r.message_id, r.role, r.content) for r in out.collect()} == SETTLED


def test_usage_stream(spark, tmp_path):
    rows = [
        ("r1", 0, None, "T1", "a", "unknown"), ("r1", 0, None, "T1", "b", "unknown"),
        ("r1", 1, "p1", "T1", "a", "used"), ("r1", 1, "p1", "T1", "b", "unused"),
        ("r1", 2, "p2", "T1", "a", "used"),
        ("r1", 3, "p3", "T1", "a", "unused"), ("r1", 3, "p3", "T1", "b", "unused"),
        ("r1", 4, "p4", "T1", "zz", "used"), ("r1", 4, "p4", "T1", "b", "unused"),
        ("r1", 5, "p5", "T1", "b", "used"), ("r1", 5, "p5", "T1", "b", "unused"),
    ]
    schema = "recall_id string, event_seq long, report_id string, tier string, item_id string, target string"
    events = spark.createDataFrame(rows, schema).withColumn("_part", F.when(F.col("event_seq") < 2, 0).otherwise(1))
    stream = stream_of(spark, events, str(tmp_path / "use"), 2, "event_seq")
    out = {(r.report_id, r.item_id, r.target): r.outcome for r in drain(keyed.usage_report_stream(stream), "usage_out").collect()}
    assert out[("p1", "a", "used")] == out[("p1", "b", "unused")] == "updated"
    assert out[("p2", "a", "used")] == "unchanged"
    assert {v for k, v in out.items() if k[0] == "p3"} == {"conflict"}
    assert {v for k, v in out.items() if k[0] == "p4"} == {"unknown_items"}
    assert {v for k, v in out.items() if k[0] == "p5"} == {"conflict"}


def test_rolling_histogram(spark, views, tmp_path):
    samples = views.latency.select("store_key", F.timestamp_seconds("obs_s").alias("ts"), "ms")
    batch = {tuple(r) for r in rolling.rolling_histogram(samples).collect()}
    samples.write.parquet(str(tmp_path / "lat"))
    stream = spark.readStream.schema(samples.schema).parquet(str(tmp_path / "lat"))
    got = {tuple(r) for r in drain(rolling.rolling_histogram(stream), "rolling", "update").collect()}
    assert got == batch and batch


def outputs(spark, sink):
    read = lambda name, *cols: {tuple(r) for r in incremental.read_output(spark, sink, name).select(*cols).collect()}
    return {
        "atoms": read("atoms", "store_key", "id", "content"), "evidence": read("evidence", "store_key", "atom_id", "stream_id"), "cursor": {tuple(r) for r in incremental.latest_cursors(spark, sink).collect()},
        "episodes": read("episodes", "store_key", "scene_id", "atom_id", "change"),
    }


def test_incremental_distillation(spark, views, tmp_path):
    turns = views.turns.cache()
    whole = str(tmp_path / "whole")
    incremental.distill_batch(turns, 0, whole)
    first = outputs(spark, whole)
    assert first["atoms"] and first["cursor"] == {(r.store_key, r.head) for r in turns.groupBy("store_key").agg(F.max("seq").alias("head")).collect()}
    incremental.distill_batch(turns, 0, whole)  # the same batch again
    incremental.distill_batch(turns, 1, whole)  # nothing is past the cursor
    assert outputs(spark, whole) == first

    parts = turns.withColumn("_part", F.least(F.floor((F.col("seq") - 1) / 20), F.lit(2)).cast("int"))
    stream = stream_of(spark, parts, str(tmp_path / "turns"), 3, "seq")
    sink = str(tmp_path / "stream")
    folder = str(tmp_path / "turns")
    incremental.run_incremental(stream, str(tmp_path / "cp"), sink, lambda: spark.read.parquet(folder)).awaitTermination()
    assert outputs(spark, sink) == first


def test_failed_step_is_invisible_and_retried(spark, views, tmp_path):
    turns, sink = views.turns, str(tmp_path / "sink")

    def dies(members):
        raise RuntimeError("model is down")

    with pytest.raises(RuntimeError):
        incremental.distill_batch(turns, 0, sink, dies)
    assert not incremental.read_output(spark, sink, "atoms").collect()

    def prose_for_one_store(members):
        good = incremental.rule_model(members)
        return good.withColumn("raw", F.when(F.col("store_key") == "tenant1:self", "sorry").otherwise(F.col("raw")))

    incremental.distill_batch(turns, 0, sink, prose_for_one_store)
    assert "tenant1:self" not in {r.store_key for r in incremental.latest_cursors(spark, sink).collect()}
    incremental.distill_batch(turns, 1, sink)
    clean = str(tmp_path / "clean")
    incremental.distill_batch(turns, 0, clean)
    assert outputs(spark, sink) == outputs(spark, clean)


def test_one_model_call_per_window(spark, views, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(members):
        def note(batches):
            for batch in batches:
                calls.add(batch.num_rows)
                yield batch

        said = incremental.rule_model(members)
        return said.mapInArrow(note, said.schema)

    windows, _members = distill.plan_windows(views.turns, incremental.latest_cursors(spark, str(tmp_path / "none")))
    incremental.distill_batch(views.turns, 0, str(tmp_path / "sink"), counted)
    assert calls.value == windows.count()


def test_stores_that_say_the_same_keep_their_own_rows(spark, tmp_path):
    said = [("a", "s", 1, "user", "The kettle is blue."), ("b", "s", 1, "user", "The kettle is blue."), ("b", "s", 2, "user", "It whistles.")]
    rows = [(f"{store}-{seq}", store, session, role, content, seq, seq, f"{store}:{seq}", 0) for store, session, seq, role, content in said]
    turns = spark.createDataFrame(rows, "id string, store_key string, session_id string, role string, content string, seq long, turn_index long, turn_id string, ts_s long")
    sink = str(tmp_path / "sink")
    incremental.distill_batch(turns, 0, sink)
    out = outputs(spark, sink)
    assert sorted(a[0] for a in out["atoms"]) == ["a", "b", "b"]
    assert all(edge[2].startswith(edge[0]) for edge in out["evidence"])
    assert {e[0] for e in out["episodes"]} == {"a", "b"}

    def archived(atoms):
        return atoms.select("store_key", "id", F.when(F.col("store_key") == "b", "archived").otherwise("active").alias("status"))

    incremental.distill_batch(turns, 1, sink, atoms_now=archived)
    effects = {r.store_key: (r.effect, r.n_removed) for r in incremental.episode_effects(spark, sink, 1).collect()}
    assert effects == {"b": ("retired", 2)}
