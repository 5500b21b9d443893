"""Status changes, metadata updates, deletion, upgrades: append change rows, fold to a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def lifecycle_changes(requests: DataFrame, atoms: DataFrame) -> DataFrame:
    """requests(request_id, store_key, op, atom_id) -> change rows, in the order of the request ids.

    Archiving only hits an atom that is active when its turn comes: any earlier request of
    the batch for the same atom has already taken it out of that state, or was itself an
    archiving that found it inactive.
    """
    status = F.create_map(
        F.lit("supersede"), F.lit("superseded"), F.lit("merge"), F.lit("merged"),
        F.lit("archive"), F.lit("archived"),
    )
    known = atoms.select("store_key", F.col("id").alias("atom_id"), "status")
    first = requests.groupBy("store_key", "atom_id").agg(F.min("request_id").alias("_first"))
    joined = requests.join(known, ["store_key", "atom_id"]).join(first, ["store_key", "atom_id"])
    return joined.where("op <> 'archive' OR (status = 'active' AND request_id = _first)").select(
        "request_id", "atom_id", "store_key", status[F.col("op")].alias("new_status")
    )


def current_atoms(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Fold the change log: per atom and field the newest non-null value wins (tags where the log has them)."""

    def newest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("change_seq"))).alias(name)

    fields = ["status", "confidence", "pinned", *(["tags"] if "new_tags" in changes.columns else [])]
    if "tags" in fields and "tags" not in base.columns:
        base = base.withColumn("tags", F.array().cast("array<string>"))
    folded = changes.groupBy("store_key", F.col("atom_id").alias("id")).agg(
        *[newest(f"new_{name}") for name in fields], F.max("changed_s").alias("changed_s"),
    )
    return base.join(folded, ["store_key", "id"], "left").withColumns({
        **{name: F.coalesce(f"new_{name}", name) for name in fields},
        "updated_s": F.greatest("created_s", "changed_s"),
    }).drop(*[f"new_{name}" for name in fields], "changed_s")


def delete_turns(
    keys: DataFrame, turns: DataFrame, evidence: DataFrame, by: str = "id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns left, evidence left, affected atoms) for keys (store_key, ``by``); atoms themselves are never touched."""
    wanted = keys.select("store_key", by).distinct()
    gone = turns.join(wanted, ["store_key", by], "left_semi").select("store_key", F.col("id").alias("stream_id"))
    edge = ["store_key", "stream_id"]
    affected = evidence.join(gone, edge, "left_semi").select("store_key", "atom_id").distinct()
    return turns.join(wanted, ["store_key", by], "left_anti"), evidence.join(gone, edge, "left_anti"), affected


def delete_atoms(
    keys: DataFrame, atoms: DataFrame, evidence: DataFrame, members: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Atoms, edges and memberships without the atoms in keys (store_key, id)."""
    by_id, by_atom = keys.select("store_key", "id"), keys.select("store_key", F.col("id").alias("atom_id"))
    return (
        atoms.join(by_id, ["store_key", "id"], "left_anti"),
        evidence.join(by_atom, ["store_key", "atom_id"], "left_anti"),
        members.join(by_atom, ["store_key", "atom_id"], "left_anti"),
    )


def delete_scenes(keys: DataFrame, scenes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = keys.select("store_key", "scene_id")
    key = ["store_key", "scene_id"]
    return scenes.join(gone, key, "left_anti"), members.join(gone, key, "left_anti")


def add_edges(new: DataFrame, edges: DataFrame) -> DataFrame:
    """Idempotent union of evidence edges."""
    return edges.unionByName(new.select(edges.columns)).dropDuplicates(["store_key", "atom_id", "stream_id"])


def upgrade(df: DataFrame, schema: dict[str, str], defaults: dict[str, Column]) -> DataFrame:
    """Bring an older table to the current columns; missing or null values take defaults."""
    out = []
    for name, kind in schema.items():
        have = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(have, defaults[name].cast(kind)) if name in defaults else have).alias(name))
    return df.select(out)


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row per key of an append table (partial aggregation before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(order)).alias("r")
    return df.groupBy(*keys).agg(row).select(*keys, "r.*").select(df.columns)


START = ("store_key", "watermark_start", "watermark_end", "input_turn_count", "model", "prompt_version", "distiller_version")
COMPLETION = ("status", "candidate_count", "error")


def fold_pass_log(events: DataFrame) -> DataFrame:
    """events(pass_id, event_no, kind, at_s, START..., COMPLETION...) -> one row per pass that was started.

    A start gives the pass its provenance and clears any completion before it; a completion
    counts if no later start follows, and one of a pass that never started counts for nothing. Both are
    maxima by event number, so the fold merges partial results and needs no order within a task.
    """
    def last(kind: str, *columns: str) -> Column:
        row = F.struct("event_no", "at_s", *columns)
        return F.max_by(F.when(F.col("kind") == kind, row), F.when(F.col("kind") == kind, F.col("event_no")))

    folded = events.groupBy("pass_id").agg(last("start", *START).alias("s"), last("complete", *COMPLETION).alias("c")).where("s IS NOT NULL")
    done = F.coalesce(F.col("c.event_no") > F.col("s.event_no"), F.lit(False))
    closed = {name: F.when(done, F.col(f"c.{name}")) for name in ("candidate_count", "error")}
    return folded.select(
        "pass_id", *(F.col(f"s.{name}").alias(name) for name in START), F.col("s.at_s").alias("started_s"),
        F.when(done, F.col("c.at_s")).alias("completed_s"), F.when(done, F.col("c.status")).otherwise("running").alias("status"),
        *(value.alias(name) for name, value in closed.items()))


def effect_log(rows: DataFrame, keys: tuple[str, ...] = ("pass_id", "scene_id"), order: str = "event_no") -> DataFrame:
    """The last row written for a scene in a pass; with the key (pass_id,), that of the profile."""
    return latest_by(rows, list(keys), order)
