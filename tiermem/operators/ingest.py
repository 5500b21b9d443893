"""Batch ingest: duplicate and conflict handling, sequence numbers, atom upserts, core snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tiermem.functions.scan import Block, blocked_row_number
from tiermem.operators.checks import atom_defaults, check_atoms, check_immutable
from tiermem.session import cut_lineage


def _owner(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Per (store, session, key) the earliest row that is accepted or still open."""
    return rows.where(F.col(key).isNotNull() & F.col("state").isin("open", "accepted")).groupBy(
        "store_key", "session_id", key
    ).agg(F.min(F.struct("arrival", "state", "id", "digest", "turn_index")).alias(name))


def ingest_turns(new: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """new(arrival, id, store_key, session_id, turn_index, turn_id, content) against the
    stored turns -> (accepted, duplicates, conflicts).

    A turn index already taken by the same text is a duplicate, by another text a
    conflict; a turn id already used at the same index is a duplicate (the text is
    not compared), at another index a conflict. A refused turn takes no key, so a
    verdict can depend on earlier ones: rows whose keys belong to no open earlier row
    are settled together and the rest waits for the next round. Copies of a key are
    reduced to their earliest row before they are shuffled.
    """
    columns = [c for c in new.columns if c != "digest"]
    facts = ["arrival", "id", "store_key", "session_id", "turn_index", "turn_id", "digest", "state"]
    digest = F.sha2("content", 256).alias("digest")
    stored = current.select(
        F.lit(-1).cast("long").alias("arrival"), "id", "store_key", "session_id", "turn_index", "turn_id", digest,
        F.lit("accepted").alias("state"),
    )
    arriving = new.select(
        F.col("arrival").cast("long").alias("arrival"), "id", "store_key", "session_id", "turn_index", "turn_id",
        digest, F.lit("open").alias("state"),
    )
    rows = cut_lineage(stored.join(
        arriving.select("store_key", "session_id").distinct(), ["store_key", "session_id"], "left_semi"
    ).unionByName(arriving).withColumns({"kept_id": F.lit(None).cast("string")}))
    while True:
        joined = rows.join(_owner(rows, "turn_index", "_i"), ["store_key", "session_id", "turn_index"], "left").join(
            _owner(rows, "turn_id", "_t"), ["store_key", "session_id", "turn_id"], "left"
        )
        # a row owns a key if the owner is this very arrival: the same turn sent again is another arrival
        first_i = F.col("_i").isNull() | ((F.col("_i.arrival") == F.col("arrival")) & (F.col("_i.id") == F.col("id")))
        first_t = F.col("_t").isNull() | ((F.col("_t.arrival") == F.col("arrival")) & (F.col("_t.id") == F.col("id")))
        same_text = F.col("_i.digest") == F.col("digest")
        same_index = F.col("_t.turn_index").eqNullSafe(F.col("turn_index"))
        by_index = ~first_i & (F.col("_i.state") == "accepted")
        by_id = first_i & ~first_t & (F.col("_t.state") == "accepted")
        verdict = (
            F.when(F.col("state") != "open", F.col("state"))
            .when(by_index, F.when(same_text, "duplicate").otherwise("index_conflict"))
            .when(by_id, F.when(same_index, "duplicate").otherwise("turn_id_conflict"))
            .when(first_i & first_t, "accepted")
            .otherwise("open")
        )
        kept: Column = (
            F.when(F.col("state") != "open", F.col("kept_id")).when(by_index, F.col("_i.id")).when(by_id, F.col("_t.id"))
        )
        rows = cut_lineage(joined.withColumns({"_v": verdict, "kept_id": kept}).select(
            *[c for c in facts if c != "state"], F.col("_v").alias("state"), "kept_id"
        ))
        if rows.where("state = 'open'").isEmpty():
            break
    verdicts = rows.where("arrival >= 0").select("arrival", "id", "state", "kept_id")
    judged = new.select(columns).join(verdicts, ["arrival", "id"])
    return (
        judged.where("state = 'accepted'").drop("state", "kept_id"),
        judged.where("state = 'duplicate'").select("arrival", "id", "store_key", "session_id", "kept_id"),
        judged.where(F.col("state").isin("index_conflict", "turn_id_conflict")).select(
            "arrival", "id", "store_key", "session_id", F.col("state").alias("reason")
        ),
    )


def assign_seq(turns: DataFrame, heads: DataFrame, block: Block, order: list[str]) -> DataFrame:
    """Store-global numbers continuing after the stored head of every store."""
    numbered = blocked_row_number(turns, ["store_key"], [block], order, "_rn")
    return numbered.join(heads.select("store_key", "head"), "store_key", "left").withColumn(
        "seq", F.coalesce("head", F.lit(0)) + F.col("_rn")
    ).drop("_rn", "head")


def upsert_atoms(new: DataFrame, current: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Validated atom writes -> (change rows, rejected rows with a reason).

    Writes of one (store, id) within the batch count in the order of the column
    ``order`` (of type and text without one): the first valid one sets text and type of an id
    the store does not hold yet, and later ones must agree with it.
    """
    good, bad_domain = check_atoms(atom_defaults(new))
    key = ["store_key", "id"]
    place = F.struct(*([order] if order else []), "type", "content")
    first = good.groupBy(*key).agg(F.min(F.struct(place.alias("place"), "type", "content")).alias("f"))
    held = current.select(*key, "type", "content")
    opened = first.select(*key, "f.type", "f.content").join(held.select(*key), key, "left_anti")
    fine, changed = check_immutable(good, held.unionByName(opened))
    known = held.select(*key, F.lit(True).alias("_known"))
    lead = first.select(*key, F.col("f.place").alias("_first"))
    op = F.when(F.col("_known") | (place != F.col("_first")), "update").otherwise("insert")
    changes = fine.join(known, key, "left").join(lead, key).withColumn("op", op).drop("_known", "_first")
    columns = [*key, "reason"]
    return changes, bad_domain.select(columns).unionByName(changed.select(columns))


def core_snapshot(rows: DataFrame) -> DataFrame:
    """rows(store_key, written_s, content): the last text written per store."""
    return rows.groupBy("store_key").agg(F.max_by("content", "written_s").alias("content"))
