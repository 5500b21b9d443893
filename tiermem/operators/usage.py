"""Recall usage: reports, rates, context efficiency, replaying a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tiermem.functions import text
from tiermem.operators.context import render
from tiermem.session import cut_lineage


def apply_usage(reports: DataFrame, items: DataFrame, order: str = "report_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """reports(report_id, recall_id, tier, item_id, target) -> (updated, unchanged, rejected).

    One unknown item, one item in both lists or one used/unused flip rejects the whole
    report. Reports of a batch count in the order of ``order`` (unique per report): an item
    that an earlier accepted report has marked cannot be marked otherwise by a later one.
    A report is settled once no earlier open one names an unmarked item of it; a marked
    item settles all later reports that disagree, so the rounds are few.
    """
    item = ["recall_id", "tier", "item_id"]
    refs = reports.groupBy("report_id", *item).agg(
        F.min("target").alias("target"), (F.min("target") != F.max("target")).alias("both"), F.min(order).alias("_place")
    )
    known = items.select(*item, F.col("usage").alias("current")).distinct()
    refs = cut_lineage(refs.join(known, item, "left"))
    marked = F.col("current").isin("used", "unused")
    flip = F.coalesce(marked & (F.col("current") != F.col("target")), F.lit(False))
    verdicts, open_ = None, refs
    while True:
        waits = F.max(F.when(~marked, F.col("_place") != F.col("_first")).otherwise(F.lit(False)))
        first = open_.groupBy(*item).agg(F.min("_place").alias("_first"))
        judged = open_.join(first, item).groupBy("report_id").agg(
            F.max(F.col("current").isNull()).alias("unknown"), F.max(F.col("both") | flip).alias("clash"), waits.alias("waits")
        )
        reason = F.when(F.col("unknown"), "unknown_items").when(F.col("clash"), "conflict")
        settled = judged.select("report_id", reason.alias("reason"), F.coalesce("waits", F.lit(False)).alias("waits"))
        settled = cut_lineage(settled.where("reason IS NOT NULL OR NOT waits").drop("waits"))
        verdicts = settled if verdicts is None else verdicts.unionByName(settled)
        fresh = open_.join(settled.where("reason IS NULL"), "report_id", "left_semi").select(*item, F.col("target").alias("_new"))
        open_ = open_.join(settled, "report_id", "left_anti").join(fresh.distinct(), item, "left")
        open_ = cut_lineage(open_.withColumn("current", F.when(marked, F.col("current")).otherwise(F.coalesce("_new", "current"))).drop("_new"))
        if open_.isEmpty():
            break
    accepted = verdicts.where("reason IS NULL").select("report_id")
    fine = refs.join(accepted, "report_id", "left_semi")
    lead = fine.groupBy(*item).agg(F.min("_place").alias("_first"))
    fine = fine.join(lead, item)
    same = marked | (F.col("_place") != F.col("_first")) | (F.col("current") == F.col("target"))
    out = ["report_id", *item, "target", "current"]
    return fine.where(~same).select(out), fine.where(same).select(out), verdicts.where("reason IS NOT NULL")


def trace_inventory(traces: DataFrame, items: DataFrame) -> DataFrame:
    """Traces and items per store; the items shrink to one row per trace before the join."""
    sizes = items.groupBy("recall_id").agg(F.count(F.lit(1)).alias("n"))
    return traces.select("store_key", "recall_id").distinct().join(sizes, "recall_id", "left").groupBy(
        "store_key"
    ).agg(
        F.count(F.lit(1)).alias("trace_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("item_count"),
    )


def _usage_counts() -> list[Column]:
    return [
        F.count_if(F.col("usage") == state).alias(state) for state in ("used", "unused", "unknown")
    ]


def usage_metrics(items: DataFrame) -> DataFrame:
    """Counts and rate per store by tier, source, rank and overall, in one scan.

    items carry the store of their trace. The rows first collapse to one per
    (store, tier, source, rank); only those few rows are expanded by GROUPING SETS.
    """
    cells = items.groupBy("store_key", "tier", "source", "ordinal").agg(*_usage_counts())
    sums = [F.sum(state).alias(state) for state in ("used", "unused", "unknown")]
    keys = [F.col("store_key"), F.col("tier"), F.col("source"), F.col("ordinal")]
    sets = [[keys[0], keys[1]], [keys[0], keys[2]], [keys[0], keys[3]], [keys[0]]]
    grouped = cells.groupingSets(sets, *keys).agg(*sums, F.grouping_id().alias("_g"))
    dimension = (
        F.when(F.col("tier").isNotNull(), "tier").when(F.col("source").isNotNull(), "source")
        .when(F.col("ordinal").isNotNull(), "rank").otherwise("all")
    )
    told = F.col("used") + F.col("unused")
    return grouped.select(
        "store_key", dimension.alias("dimension"),
        F.coalesce("tier", "source", F.col("ordinal").cast("string"), F.lit("")).alias("value"),
        "used", "unused", "unknown",
        F.round(F.when(told > 0, F.col("used") / told), 9).alias("rate"),
    )


def context_efficiency(items: DataFrame) -> DataFrame:
    chars = F.coalesce("chars", F.lit(0))
    used = F.sum(F.when(F.col("usage") == "used", chars).otherwise(0))
    sums = items.groupBy("store_key").agg(F.sum(chars).alias("total_chars"), used.alias("used_chars"))
    waste = (F.col("total_chars") - F.col("used_chars")) / F.col("total_chars")
    return sums.withColumn("unused_ratio", F.round(F.when(F.col("total_chars") > 0, waste), 9))


def usage_by_kind(items: DataFrame, atoms: DataFrame, scenes: DataFrame) -> DataFrame:
    """Usage per atom type and scene kind; items of one id collapse before the joins."""
    per_item = items.where("tier IN ('T1', 'T2')").groupBy("store_key", "tier", "item_id").agg(*_usage_counts())
    kinds = atoms.select("store_key", F.lit("T1").alias("tier"), F.col("id").alias("item_id"), F.col("type").alias("kind"))
    kinds = kinds.unionByName(
        scenes.select("store_key", F.lit("T2").alias("tier"), F.col("scene_id").alias("item_id"), F.col("scene_kind").alias("kind"))
    )
    return per_item.join(kinds, ["store_key", "tier", "item_id"], "left").groupBy(
        "tier", F.coalesce("kind", F.lit("gone")).alias("kind")
    ).agg(*[F.sum(state).alias(state) for state in ("used", "unused", "unknown")])


def _resolved(items: DataFrame, atoms: DataFrame, scenes: DataFrame, core: DataFrame) -> DataFrame:
    """items + the current text and the reason an item is stale (null when live)."""
    body = text.truncate(F.col("content"), text.ATOM_CAP)
    t1 = items.where("tier = 'T1'").join(
        atoms.select("store_key", F.col("id").alias("item_id"), F.col("status").alias("_s"), body.alias("body")),
        ["store_key", "item_id"], "left",
    )
    scene_body = text.truncate(
        text.scene_text(F.col("scene_kind"), F.col("title"), F.col("summary")), text.SCENE_CAP
    )
    t2 = items.where("tier = 'T2'").join(
        scenes.select("store_key", F.col("scene_id").alias("item_id"), F.col("status").alias("_s"), scene_body.alias("body")),
        ["store_key", "item_id"], "left",
    )
    t3 = items.where("tier = 'T3'").join(
        core.where("content <> ''").select("store_key", F.lit("active").alias("_s"), F.col("content").alias("body")),
        "store_key", "left",
    )
    columns = [*items.columns, "_s", "body"]
    merged = t1.select(columns).unionByName(t2.select(columns)).unionByName(t3.select(columns))
    reason = (
        F.when(F.col("_s").isNull(), F.when(F.col("tier") == "T3", "deleted").otherwise("not_found"))
        .when(F.col("_s") == "active", None)
        .when(F.col("tier") == "T2", "retired")
        .when(F.col("_s").isin("superseded", "merged"), F.col("_s"))
        .otherwise("archived")
    )
    return merged.withColumn("reason", reason).drop("_s")


def reconstruct(
    items: DataFrame, atoms: DataFrame, scenes: DataFrame, core: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """A past trace rendered with today's rows, and the items that went stale."""
    rows = _resolved(items, atoms, scenes, core)
    stale = rows.where("reason IS NOT NULL").select("recall_id", "ordinal", "tier", "item_id", "reason")
    live = rows.where("reason IS NULL").withColumnRenamed("recall_id", "query_id")
    rendered = render(live).select(F.col("query_id").alias("recall_id"), F.col("rendered").alias("context"))
    every = items.select("recall_id").distinct()
    return every.join(rendered, "recall_id", "left").fillna("", ["context"]), stale


def last_recall(
    traces: DataFrame, items: DataFrame, atoms: DataFrame, scenes: DataFrame, core: DataFrame
) -> DataFrame:
    """The newest recall of every store with a snippet of each item's current text."""
    newest = traces.groupBy("store_key").agg(
        F.max(F.struct("created_s", "recall_id")).alias("n")
    ).select("n.recall_id", "n.created_s")
    wanted = items.join(newest, "recall_id")
    t1 = atoms.select("store_key", F.lit("T1").alias("tier"), F.col("id").alias("item_id"), F.col("content").alias("_c"))
    joined = F.concat_ws(" — ", F.when(F.col("title") != "", F.col("title")),
                         F.when(F.col("summary") != "", F.col("summary")))
    t2 = scenes.select("store_key", F.lit("T2").alias("tier"), F.col("scene_id").alias("item_id"), joined.alias("_c"))
    resolved = wanted.where("tier <> 'T3'").join(t1.unionByName(t2), ["store_key", "tier", "item_id"], "left")
    cores = wanted.where("tier = 'T3'").join(core.select("store_key", F.col("content").alias("_c")), "store_key", "left")
    shown = text.snippet(F.col("_c"))
    columns = ["store_key", "recall_id", "created_s", "ordinal", "tier", "item_id", "source", "usage", "_c"]
    return resolved.select(columns).unionByName(cores.select(columns)).withColumn(
        "content", F.when(F.col("_c") != "", shown)
    ).drop("_c")


def prune(traces: DataFrame, items: DataFrame, days: int, as_of_s: int) -> tuple[DataFrame, DataFrame]:
    """Traces not older than ``days`` with their items; days <= 0 keeps everything."""
    if days <= 0:
        return traces, items
    kept = traces.where(F.col("created_s") >= as_of_s - days * 86400)
    return kept, items.join(kept.select("recall_id"), "recall_id", "left_semi")

