"""Per-store counts, job reports, sweep gate, embedding lock, live state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tiermem.operators.checks import ATOM_STATUSES

# Retry, lease and staleness limits in seconds.
BACKOFF_S, MAX_BACKOFF_S, MAX_ATTEMPTS, LEASE_S = 30, 900, 8, 600
STALE_PENDING_S = 900


def heads(turns: DataFrame) -> DataFrame:
    return turns.groupBy("store_key").agg(F.max("seq").alias("head"))


def store_inventory(turns: DataFrame, atoms: DataFrame, scenes: DataFrame, core: DataFrame) -> DataFrame:
    """One row per store; every table collapses to one row per store before the joins."""
    t = turns.groupBy("store_key").agg(
        F.count(F.lit(1)).alias("turns"), F.max("seq").alias("head_seq")
    )
    a = atoms.groupBy("store_key").agg(
        *[F.count_if(F.col("status") == s).alias(f"atoms_{s}") for s in ATOM_STATUSES],
        F.count_if((F.col("status") == "active") & F.col("pinned")).alias("atoms_pinned"),
    )
    s = scenes.groupBy("store_key").agg(*[
        F.count_if((F.col("scene_kind") == kind) & (F.col("status") == status)).alias(f"{kind}_{status}")
        for kind in ("episode", "topic") for status in ("active", "retired")
    ])
    c = core.groupBy("store_key").agg(F.max(F.length("content")).cast("long").alias("core_chars"))
    joined = t.join(a, "store_key", "full").join(s, "store_key", "full").join(c, "store_key", "full")
    return joined.fillna(0)


def attempt_ledger(attempts: DataFrame, as_of_s: int) -> DataFrame:
    """Fold the attempts of each job into its state: retry time, dead flag, stale lease."""
    last = attempts.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max(F.struct("attempt_key", "outcome", "at_s", "store_key")).alias("z"),
    ).select("job_id", "attempts", "z.outcome", "z.at_s", "z.store_key")
    wait = F.least(BACKOFF_S * F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(MAX_BACKOFF_S)).cast("long")
    dead = F.col("attempts") >= MAX_ATTEMPTS
    status = (
        F.when(F.col("outcome") == "done", "done").when(F.col("outcome") == "running", "running")
        .when(dead, "dead").otherwise("pending")
    )
    due = F.when(F.col("outcome") == "failed", F.col("at_s") + wait).otherwise(F.col("at_s"))
    return last.select(
        "job_id", "store_key", "attempts", status.alias("status"), F.col("at_s").alias("updated_s"),
        F.when((F.col("outcome") == "failed") & ~dead, due).otherwise(F.col("at_s")).alias("due_s"),
        ((F.col("outcome") == "running") & (F.col("at_s") + LEASE_S < as_of_s)).alias("stale_lease"),
    )


def job_report(jobs: DataFrame, as_of_s: int) -> DataFrame:
    """jobs(job_id, store_key, status, created_s): counts by status with the oldest pending job."""
    by_status = jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("created_s", "job_id")).alias("o")
    )
    late = (F.col("status") == "pending") & (as_of_s - F.col("o.created_s") > STALE_PENDING_S)
    return by_status.select(
        "status", "n", F.col("o.job_id").alias("oldest_job"), F.col("o.created_s").alias("oldest_s"),
        F.when(F.col("status") == "dead", "error").when(late, "warn").otherwise("ok").alias("level"),
    )


def dead_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'dead'").orderBy(F.col("updated_s").desc(), "job_id")


def dirty_stores(changes: DataFrame, passes: DataFrame) -> DataFrame:
    """Stores whose newest lifecycle change is later than their last clean pass."""
    newest = changes.groupBy("store_key").agg(
        F.max(F.struct("changed_s", "reason")).alias("c")
    ).select("store_key", F.col("c.changed_s").alias("marked_s"), F.col("c.reason").alias("reason"))
    clean = passes.where("status = 'done'").groupBy("store_key").agg(F.max("started_s").alias("clean_s"))
    joined = newest.join(clean, "store_key", "left")
    return joined.where(F.col("marked_s") > F.coalesce("clean_s", F.lit(-1))).select(
        "store_key", "marked_s", "reason"
    )


def stores_needing_pass(heads_: DataFrame, cursors: DataFrame, dirty: DataFrame) -> DataFrame:
    marks = dirty.select("store_key", F.lit(True).alias("_dirty"))
    joined = heads_.join(cursors.select("store_key", "cursor"), "store_key", "left").join(
        marks, "store_key", "left"
    )
    fresh = F.col("head") > F.coalesce("cursor", F.lit(0))
    is_dirty = F.coalesce("_dirty", F.lit(False))
    return joined.where(fresh | is_dirty).select(
        "store_key", fresh.alias("has_new_turns"), is_dirty.alias("is_dirty")
    )


def embedding_lock(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """vectors(tier, model, embedding) against the locked model and size: rows per combination."""
    found = vectors.where("embedding IS NOT NULL").groupBy(
        "tier", "model", F.size("embedding").cast("long").alias("dim")
    ).agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col("model") != model, "model").when(F.col("dim") != dim, "dim")
    return found.withColumn("verdict", F.coalesce(problem, F.lit("ok")))


def live_state(inventory: DataFrame, passes: DataFrame, core_fx: DataFrame, recalls: DataFrame) -> DataFrame:
    """Inventory with the newest pass and recall of each store and a change signature."""
    last = passes.groupBy("store_key").agg(
        F.max(F.struct("started_s", "pass_id", "status", "candidate_count")).alias("p")
    ).select("store_key", "p.pass_id", F.col("p.status").alias("pass_status"), "p.candidate_count")
    last = last.join(core_fx.select("pass_id", F.col("effect").alias("core_effect")), "pass_id", "left")
    newest = recalls.groupBy("store_key").agg(
        F.max(F.struct("created_s", "recall_id")).alias("r")
    ).select("store_key", "r.recall_id")
    joined = inventory.join(last, "store_key", "left").join(newest, "store_key", "left")
    parts = [
        "atoms_active", "atoms_superseded", "atoms_merged", "episode_active", "topic_active",
        "core_chars", "head_seq", "pass_id", "pass_status", "candidate_count", "core_effect",
    ]
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return joined.select(
        "store_key", "turns", "head_seq", "atoms_active", "pass_id", "pass_status", "recall_id",
        F.sha2(text, 256).alias("signature"),
    )


def changed_since(now: DataFrame, before: DataFrame) -> DataFrame:
    old = before.select("store_key", F.col("signature").alias("_old"))
    return now.join(old, "store_key", "left").where(
        F.col("_old").isNull() | (F.col("_old") != F.col("signature"))
    ).drop("_old")
