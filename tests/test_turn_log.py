"""Turn ingest to stored tables: batches, replays, lost steps, streams."""

import pytest

from pyspark.sql import functions as F

from tiermem.operators import ingest
from tiermem.streaming import turn_log


def rows_of(log, name, *columns):
    return {tuple(r) for r in log.read(name).select(*columns).collect()}


def test_batches_replays_and_a_lost_step(spark, views, tmp_path, monkeypatch):
    arrivals = views.incoming_turns.cache()
    whole, parts = turn_log.TurnLog(spark, str(tmp_path / "whole")), turn_log.TurnLog(spark, str(tmp_path / "parts"))
    assert whole.append(arrivals, 0) and not whole.append(arrivals, 0)
    middle = arrivals.approxQuantile("arrival", [0.5], 0.0)[0]
    assert parts.append(arrivals.where(F.col("arrival") <= middle), 0)
    first = rows_of(parts, "turns", "id", "seq")
    make = turn_log.make_folder

    def dies(*_):
        raise RuntimeError("lost before the marker")

    monkeypatch.setattr(turn_log, "make_folder", dies)
    with pytest.raises(RuntimeError):
        parts.append(arrivals.where(F.col("arrival") > middle), 1)
    assert rows_of(parts, "turns", "id", "seq") == first  # what a broken batch wrote is not seen
    monkeypatch.setattr(turn_log, "make_folder", make)
    assert parts.append(arrivals.where(F.col("arrival") > middle), 1)
    # later arrivals never change what earlier ones got, so cut batches equal one
    for name, columns in (("turns", ("id", "store_key", "turn_index", "content", "seq")), ("verdicts", ("arrival", "id", "verdict", "kept_id"))):
        assert rows_of(parts, name, *columns) == rows_of(whole, name, *columns)
    numbers = {}
    for store, seq in rows_of(parts, "turns", "store_key", "seq"):
        numbers.setdefault(store, set()).add(seq)
    assert all(seqs == set(range(1, len(seqs) + 1)) for seqs in numbers.values())
    assert {(r.store_key, r.head) for r in parts.heads().collect()} == {(s, len(n)) for s, n in numbers.items()}
    with pytest.raises(ValueError):
        turn_log.TurnLog(spark, parts.path).append(arrivals, -1)
    accepted, _, _ = ingest.ingest_turns(arrivals, arrivals.limit(0))
    assert rows_of(whole, "turns", "id", "turn_index") == {(r.id, r.turn_index) for r in accepted.collect()}


def test_stream_equals_batches(spark, views, tmp_path):
    folder = str(tmp_path / "in")
    data = views.incoming_turns.select(*[f.split()[0] for f in turn_log.ARRIVAL.split(", ")])
    data.where("arrival < 1000000000000").coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(data.schema).parquet(folder)
    log = turn_log.TurnLog(spark, str(tmp_path / "log"))
    turn_log.run_turn_log(stream(), str(tmp_path / "cp"), log.path).awaitTermination()
    data.where("arrival >= 1000000000000").coalesce(1).write.mode("append").parquet(folder)
    turn_log.run_turn_log(stream(), str(tmp_path / "cp"), log.path).awaitTermination()
    assert log.batches() == [0, 1]
    whole = turn_log.TurnLog(spark, str(tmp_path / "whole"))
    whole.append(data, 0)
    assert rows_of(log, "turns", "id", "seq") == rows_of(whole, "turns", "id", "seq")
    assert log.read("verdicts").count() == data.count()
