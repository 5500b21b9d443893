"""Budgeted context assembly over ranked tiers, rendering and trace rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tiermem.functions import text
from tiermem.operators import search
from tiermem.session import cut_lineage

# Tier shares, candidate sizing and headings.
LEGACY_TOTAL, LEGACY_PINNED_SHARE = 6000, 0.25
CORE_MIN_CHARS = 50
HEADINGS = {
    "pinned": "## Pinned",
    "ranked": "## Relevant facts/preferences/rules",
    "scene": "## Related episodes/topics",
    "core": "## Project/persona core",
}
POLICY_VERSION = "1"


@dataclass(frozen=True)
class Shares:
    pinned: float = 0.20
    atoms: float = 0.40
    scenes: float = 0.25
    core: float = 0.15

    def total(self) -> float:
        return self.pinned + self.atoms + self.scenes + self.core


def atom_pool(cap: Column) -> Column:
    return F.greatest(F.lit(15), F.ceil(cap / 100.0 * 1.5)).cast("int")


def scene_pool(cap: Column) -> Column:
    return F.greatest(F.lit(8), F.ceil(cap / 300.0 * 1.5)).cast("int")


def pinned_prefix(atoms: DataFrame, largest_cap: int, cap: int = text.ATOM_CAP) -> DataFrame:
    """Pinned atoms of each store in (created, id) order with their running length.

    An item that starts beyond the largest cap can never be admitted, and every
    non-empty item adds at least one character, so ``largest_cap + 1`` non-empty
    items per store decide every query; the bound is pruned before the shuffle.
    """
    shown = text.truncate(F.col("content"), cap)
    rows = atoms.where("status = 'active' AND pinned AND content <> ''").select(
        "store_key", "id", "created_s", shown.alias("shown"), F.length(shown).alias("chars")
    )
    order = Window.partitionBy("store_key").orderBy("created_s", "id")
    first = rows.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= largest_cap + 1
    )
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("running", F.sum("chars").over(running))


def recall_atoms_legacy(
    queries: DataFrame, atoms: DataFrame, as_of_s: int, limit: int = 10,
    total: int = LEGACY_TOTAL, share: float = LEGACY_PINNED_SHARE, index: search.LexicalIndex | None = None,
) -> DataFrame:
    """Pinned first within their share, then ranked atoms; each list stops at its first misfit."""
    pinned_cap = int(total * share)
    fits = pinned_prefix(atoms, pinned_cap, text.LEGACY_CAP).where(F.col("running") <= pinned_cap)
    used = fits.groupBy("store_key").agg(
        F.count(F.lit(1)).alias("n_pinned"), F.sum("chars").alias("pinned_chars")
    )
    asked = queries.join(used, "store_key", "left").fillna(0, ["n_pinned", "pinned_chars"])
    room = F.greatest(F.lit(limit) - F.col("n_pinned"), F.lit(0)) * 3
    hits = search.search_atoms(asked, atoms, as_of_s, room, index=index)
    shown = text.truncate(F.col("content"), text.LEGACY_CAP)
    ranked = (
        hits.join(fits.select("store_key", "id"), ["store_key", "id"], "left_anti")
        .join(atoms.select("store_key", "id", F.length(shown).alias("chars")), ["store_key", "id"])
        .join(asked.select("query_id", "n_pinned", "pinned_chars"), "query_id")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    running = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = (
        ranked.withColumn("place", F.row_number().over(order))
        .withColumn("running", running + F.col("pinned_chars"))
        .where((F.col("running") <= total) & (F.col("place") + F.col("n_pinned") <= limit))
    )
    first = queries.select("query_id", "store_key").join(
        fits.select("store_key", "id", "chars", "place"), "store_key"
    )
    return first.select(
        "query_id", F.lit("pinned").alias("source"), F.col("place").cast("long").alias("place"),
        "id", F.col("chars").cast("long").alias("chars"),
    ).unionByName(
        kept.select(
            "query_id", F.lit("ranked").alias("source"), F.col("place").cast("long").alias("place"),
            "id", F.col("chars").cast("long").alias("chars"),
        )
    )


def _fill(candidates: DataFrame, caps: DataFrame, tier: str) -> DataFrame:
    """Admit candidates in order, skipping what does not fit (candidates: query_id, id,
    score, chars). The list of a query is bounded by its candidate limit."""
    item = F.struct((-F.col("score")).alias("o"), "id", "chars", "score")
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    state = F.struct(
        F.lit(0).cast("long").alias("used"),
        F.array().cast("array<struct<id:string,chars:bigint,score:double>>").alias("kept"),
        F.lit(False).alias("missed"),
    )

    def step(acc: Column, it: Column) -> Column:
        fits = acc["used"] + it["chars"] <= F.col("cap")
        one = F.array(F.struct(
            it["id"].alias("id"), it["chars"].cast("long").alias("chars"), it["score"].alias("score")
        ))
        return F.struct(
            F.when(fits, acc["used"] + it["chars"]).otherwise(acc["used"]).cast("long").alias("used"),
            F.when(fits, F.concat(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"),
            (acc["missed"] | ~fits).alias("missed"),
        )

    folded = caps.join(lists, "query_id", "left").withColumn(
        "fold", F.aggregate(F.coalesce("items", F.array().cast(lists.schema["items"].dataType)), state, step)
    )
    return folded.select(
        "query_id", F.col("fold.used").alias(f"{tier}_chars"), F.col("fold.kept").alias(f"{tier}_items"),
        F.col("fold.missed").alias(f"{tier}_missed"),
    )


def assemble_context(
    queries: DataFrame, atoms: DataFrame, scenes: DataFrame, core: DataFrame, as_of_s: int,
    shares: Shares = Shares(),
    weights: search.Weights = search.Weights(),
    atom_index: search.LexicalIndex | None = None, scene_index: search.LexicalIndex | None = None,
) -> DataFrame:
    """queries(query_id, store_key, text, embedding, budget) -> one context row per query.

    Unused budget spills forward: pinned -> atoms -> scenes -> core. Pinned stops at
    the first misfit, atoms and scenes skip and go on. Pools are sized from the largest
    budget and the largest caps the queries have, so none is cut below what it may use.
    """
    total = shares.total()

    def share(part: float) -> Column:
        return F.floor(F.col("budget") * (part / total)).cast("long")

    asked = queries.select("query_id", "store_key", "text", "embedding", F.col("budget").cast("long").alias("budget"))
    base = cut_lineage(asked).withColumns({
        "pinned_cap": share(shares.pinned),
        "atom_share": share(shares.atoms),
        "scene_share": share(shares.scenes),
    }).withColumn(
        "core_share", F.col("budget") - F.col("pinned_cap") - F.col("atom_share") - F.col("scene_share")
    )
    largest_pinned = int(base.agg(F.max("pinned_cap")).first()[0] or 0)
    prefix = pinned_prefix(atoms, largest_pinned)
    caps = base.select("query_id", "store_key", "pinned_cap")
    order = F.struct("place", "id", "chars")
    admitted = caps.join(prefix, "store_key").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("running") <= F.col("pinned_cap"), order))).alias("pinned_items"),
        F.coalesce(F.max(F.when(F.col("running") <= F.col("pinned_cap"), F.col("running"))), F.lit(0)).alias("pinned_chars"),
        F.max(F.col("running") > F.col("pinned_cap")).alias("pinned_missed"),
    )
    staged = cut_lineage(base.join(admitted, "query_id", "left").fillna(0, ["pinned_chars"]).withColumns({
        "pinned_missed": F.coalesce("pinned_missed", F.lit(False)),
        "atom_cap": F.col("atom_share") + F.col("pinned_cap") - F.coalesce("pinned_chars", F.lit(0)),
    }))

    hits = search.search_atoms(
        staged.select("query_id", "store_key", "text", "embedding", "atom_cap"), atoms, as_of_s,
        atom_pool(F.col("atom_cap")), weights=weights, index=atom_index,
    ).where("NOT pinned")
    atom_text = text.truncate(F.col("content"), text.ATOM_CAP)
    sized = hits.join(
        atoms.select("store_key", "id", F.length(atom_text).cast("long").alias("chars")),
        ["store_key", "id"],
    )
    filled = _fill(sized, staged.select("query_id", F.col("atom_cap").alias("cap")), "atom")
    # One small row per query is written out, so that the next tier does not search again.
    staged = cut_lineage(staged.join(filled, "query_id").withColumn(
        "scene_cap", F.col("scene_share") + F.col("atom_cap") - F.col("atom_chars")
    ))

    scene_hits = search.search_scenes(
        staged.select("query_id", "store_key", "text", "embedding", "scene_cap"), scenes,
        scene_pool(F.col("scene_cap")), scene_index,
    )
    rendered = text.truncate(
        text.scene_text(F.col("scene_kind"), F.col("title"), F.col("summary")), text.SCENE_CAP
    )
    sized = scene_hits.join(
        scenes.select("store_key", F.col("scene_id").alias("id"), F.length(rendered).cast("long").alias("chars")),
        ["store_key", "id"],
    )
    filled = _fill(sized, staged.select("query_id", F.col("scene_cap").alias("cap")), "scene")
    staged = staged.join(filled, "query_id").withColumn(
        "core_cap", F.col("core_share") + F.col("scene_cap") - F.col("scene_chars")
    )

    has_core = F.coalesce(F.col("core_text") != "", F.lit(False))
    shown = has_core & (F.col("core_cap") > CORE_MIN_CHARS)
    excerpt = text.truncate(F.col("core_text"), F.col("core_cap").cast("int"))
    with_core = staged.join(
        core.select("store_key", F.col("content").alias("core_text")), "store_key", "left"
    ).withColumns({
        "core_chars": F.when(shown, F.length(excerpt)).otherwise(0).cast("long"),
        "core_missed": has_core & (~shown | (F.length("core_text") > F.col("core_cap"))),
    })
    return with_core.select(
        "query_id", "store_key", "text", "budget", "pinned_items", "atom_items", "scene_items",
        F.col("pinned_chars").cast("long").alias("pinned_chars"), "atom_chars", "scene_chars", "core_chars",
        (F.col("pinned_chars") + F.col("atom_chars") + F.col("scene_chars") + F.col("core_chars"))
        .cast("long").alias("total_chars"),
        (F.col("pinned_missed") | F.col("atom_missed") | F.col("scene_missed") | F.col("core_missed"))
        .alias("truncated"),
    )


def context_items(contexts: DataFrame) -> DataFrame:
    """Admitted items in order: (query_id, ordinal, tier, source, item_id, chars, score)."""

    def rows(items: str, tier: str, source: str, scored: bool) -> Column:
        return F.transform(
            F.coalesce(F.col(items), F.expr("array()").cast(
                "array<struct<id:string,chars:bigint,score:double>>" if scored
                else "array<struct<place:int,id:string,chars:int>>")),
            lambda i: F.struct(
                F.lit(tier).alias("tier"), F.lit(source).alias("source"), i["id"].alias("item_id"),
                i["chars"].cast("long").alias("chars"),
                (i["score"] if scored else F.lit(None)).cast("double").alias("score"),
            ),
        )

    core = F.when(F.col("core_chars") > 0, F.array(F.struct(
        F.lit("T3").alias("tier"), F.lit("core").alias("source"), F.lit("core").alias("item_id"),
        F.col("core_chars").alias("chars"), F.lit(None).cast("double").alias("score"),
    ))).otherwise(F.array().cast("array<struct<tier:string,source:string,item_id:string,chars:bigint,score:double>>"))
    every = F.concat(
        rows("pinned_items", "T1", "pinned", False), rows("atom_items", "T1", "ranked", True),
        rows("scene_items", "T2", "scene", True), core,
    )
    return contexts.select("query_id", "store_key", F.posexplode(every).alias("ordinal", "i")).select(
        "query_id", "store_key", F.col("ordinal").cast("long").alias("ordinal"), "i.*"
    )


def render(items: DataFrame) -> DataFrame:
    """items(key columns..., source, ordinal, body) already resolved to text -> one text per query.

    A context holds at most its budget in characters, so a group stays small.
    """
    parts = []
    for source, heading in HEADINGS.items():
        listed = F.transform(
            F.array_sort(F.collect_list(F.when(F.col("source") == source, F.struct("ordinal", "body")))),
            lambda s: s["body"],
        )
        parts.append((listed, heading))
    sections = [
        F.when(F.size(listed) > 0, F.concat_ws("\n", F.lit(heading), listed)) for listed, heading in parts
    ]
    return items.groupBy("query_id").agg(F.concat_ws("\n\n", *sections).alias("rendered"))


def context_texts(
    items: DataFrame, atoms: DataFrame, scenes: DataFrame, core: DataFrame
) -> DataFrame:
    """Give every admitted item the text it shows; texts that no item names are not shuffled."""
    items = cut_lineage(items)
    named = items.select("store_key", "tier", "item_id")
    t1 = atoms.select("store_key", F.lit("T1").alias("tier"), F.col("id").alias("item_id"), "content")
    t1 = t1.join(named, ["store_key", "tier", "item_id"], "left_semi").select(
        "store_key", "tier", "item_id", text.truncate(F.col("content"), text.ATOM_CAP).alias("_b"))
    t2 = scenes.select("store_key", F.lit("T2").alias("tier"), F.col("scene_id").alias("item_id"), "scene_kind", "title", "summary")
    scene_body = text.scene_text(F.col("scene_kind"), F.col("title"), F.col("summary"))
    t2 = t2.join(named, ["store_key", "tier", "item_id"], "left_semi").select(
        "store_key", "tier", "item_id", text.truncate(scene_body, text.SCENE_CAP).alias("_b"))
    cores = core.select("store_key", F.col("content").alias("_core"))
    excerpt = text.truncate(F.col("_core"), F.col("chars").cast("int"))
    return (
        items.join(t1.unionByName(t2), ["store_key", "tier", "item_id"], "left")
        .join(cores, "store_key", "left")
        .withColumn("body", F.when(F.col("tier") == "T3", excerpt).otherwise(F.col("_b")))
        .drop("_b", "_core")
    )


def emit_traces(
    contexts: DataFrame, as_of_s: int, mode: Column | None = None,
    weights: search.Weights = search.Weights(), shares: Shares = Shares(),
) -> tuple[DataFrame, DataFrame]:
    """Header and item rows of a recall trace; usage starts unknown."""
    policy = F.struct(
        F.struct(
            F.lit(weights.recency).alias("recency"), F.lit(weights.priority).alias("priority"),
            F.lit(weights.confidence).alias("confidence"),
        ).alias("weights"),
        F.struct(*[F.lit(getattr(shares, n)).alias(n) for n in ("pinned", "atoms", "scenes", "core")]).alias("budgets"),
        F.lit(weights.half_life_days).alias("recency_half_life_days"),
        F.lit(POLICY_VERSION).alias("version"),
    )
    recall = F.concat(F.lit("r-"), F.substring(F.sha2(F.concat_ws("|", "query_id", F.lit(str(as_of_s))), 256), 1, 16))
    heads = contexts.select(
        recall.alias("recall_id"), "store_key", F.split("store_key", ":")[0].alias("tenant"),
        F.col("text").alias("query"), F.col("budget").alias("requested_budget"),
        F.col("total_chars").alias("used_budget"),
        (mode if mode is not None else F.lit("explicit")).alias("mode"),
        policy.alias("policy_snapshot"), F.lit(as_of_s).alias("created_s"),
    )
    items = context_items(contexts).select(
        recall.alias("recall_id"), "ordinal", "tier", "item_id", "source", "score", "chars",
        F.lit("unknown").alias("usage"),
    )
    return heads, items
