"""Pool membership: what a tenant may see and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pools_for(members: DataFrame) -> DataFrame:
    """Pools each tenant can reach with the access it has."""
    return members.where("access <> 'none'").select("tenant", "pool", "access")


def authorise(requests: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(request_id, tenant, pool, is_write) -> (allowed with store_key, denied with reason).

    The tenant's own store is always open; a pool must exist, the tenant must be in
    it, and a write needs readwrite.
    """
    known = members.select("pool").distinct().withColumn("_exists", F.lit(True))
    joined = requests.join(known, "pool", "left").join(
        members.select("pool", "tenant", "access"), ["pool", "tenant"], "left"
    )
    own = F.col("pool") == "self"
    access = F.coalesce("access", F.lit("none"))
    reason = (
        F.when(own, None)
        .when(F.col("_exists").isNull(), "no_such_pool")
        .when(access == "none", "not_a_member")
        .when(F.col("is_write") & (access != "readwrite"), "read_only")
    )
    judged = joined.withColumn("reason", reason).select("request_id", "tenant", "pool", "reason")
    allowed = judged.where("reason IS NULL").select(
        "request_id", "tenant", "pool", F.concat_ws(":", "tenant", "pool").alias("store_key")
    )
    return allowed, judged.where("reason IS NOT NULL")


def visible_rows(rows: DataFrame, members: DataFrame, tenant: str) -> DataFrame:
    """Rows of the pools one tenant may read (rows carry ``pool``)."""
    mine = members.where((F.col("tenant") == tenant) & (F.col("access") != "none")).select("pool")
    return rows.join(mine, "pool", "left_semi")
