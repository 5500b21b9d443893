"""Domain checks: rows are accepted or rejected with a reason, never coerced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tiermem.functions.vectors import is_valid_vector

# The closed domains of the data model.
ATOM_TYPES = ["fact", "pattern", "preference", "constraint", "instruction"]
CONFIDENCES = ["high", "medium", "low"]
ATOM_STATUSES = ["active", "superseded", "merged", "archived"]
ACTIONS = ["store", "update", "merge", "skip"]
ACCESS = ["none", "read", "readwrite"]
SEGMENT = "^[a-z0-9][a-z0-9_-]{0,63}$"


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(
        F.col("reason").isNotNull()
    )


def atom_defaults(df: DataFrame) -> DataFrame:
    """Missing type, confidence, priority, pinned and tags take the default value."""
    defaults = {
        "type": F.lit("fact"), "confidence": F.lit("medium"), "priority": F.lit(100).cast("long"),
        "pinned": F.lit(False), "tags": F.array().cast("array<string>"),
    }
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(name, value) if name in df.columns else value)
    return df


def atom_reason(type_: Column, confidence: Column) -> Column:
    bad_type = ~F.coalesce(type_.isin(ATOM_TYPES), F.lit(False))
    bad_confidence = ~F.coalesce(confidence.isin(CONFIDENCES), F.lit(False))
    return F.when(bad_type, "invalid_type").when(bad_confidence, "invalid_confidence")


def check_atoms(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, atom_reason(F.col("type"), F.col("confidence")))


def check_immutable(new: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An id that its store knows may not come back with another text or type."""
    known = current.select(
        "store_key", "id", F.col("type").alias("_type"), F.sha2("content", 256).alias("_content")
    )
    joined = new.join(known, ["store_key", "id"], "left")
    other_content = F.sha2("content", 256) != F.col("_content")
    reason = F.when(other_content, "content_immutable").when(
        F.col("type") != F.col("_type"), "type_immutable"
    )
    good, bad = _split(joined, reason)
    return good.drop("_type", "_content"), bad.drop("_type", "_content")


def check_vectors(df: DataFrame, dim: int, vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    vector = F.col(vec)
    reason = F.when(vector.isNull(), "not_an_array").when(F.size(vector) != dim, "wrong_dimension")
    return _split(df, reason.when(~is_valid_vector(vector, dim), "non_finite"))


def duplicate_turn_keys(turns: DataFrame) -> DataFrame:
    """(session, turn_index) and (session, turn_id) keys that occur more than once."""
    kinds = F.array(
        F.struct(F.lit("turn_index").alias("kind"), F.col("turn_index").cast("string").alias("value")),
        F.struct(F.lit("turn_id").alias("kind"), F.col("turn_id").alias("value")),
    )
    keys = turns.select("store_key", "session_id", F.explode(kinds).alias("k"))
    return (
        keys.where("k.value IS NOT NULL")
        .groupBy("store_key", "session_id", F.col("k.kind").alias("kind"), F.col("k.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def check_members(members: DataFrame) -> DataFrame:
    """Membership rows with the reason they make a registry corrupt, if any."""
    reason = (
        F.when(~F.col("pool").rlike(SEGMENT) | (F.col("pool") == "self"), "bad_name")
        .when(~F.col("tenant").rlike(SEGMENT), "bad_tenant")
        .when(~F.col("access").isin(ACCESS), "bad_access")
    )
    return members.withColumn("reason", F.coalesce(reason, F.lit("ok")))


def check_registry(declared: DataFrame) -> DataFrame:
    """declared(key, name, members map, created_at, updated_at) -> one verdict per pool."""
    bad_member = F.exists(F.map_values("members"), lambda a: ~F.coalesce(a.isin(ACCESS), F.lit(False)))
    reason = (
        F.when(F.col("name").isNull() | (F.col("name") != F.col("key")), "name_mismatch")
        .when(F.col("members").isNull(), "members_missing")
        .when(bad_member, "bad_access")
        .when(F.col("created_at").isNull() | F.col("updated_at").isNull(), "bad_dates")
    )
    return declared.select("key", F.coalesce(reason, F.lit("ok")).alias("verdict"))
