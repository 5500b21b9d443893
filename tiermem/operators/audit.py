"""Pass history: summaries, listings, warnings, gaps, comparisons, membership replay."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tiermem.functions.scan import Block, blocked_row_number, blocked_running
from tiermem.operators.checks import ACTIONS
from tiermem.session import cut_lineage


PLACE_BLOCK = 1024


@dataclass(frozen=True)
class Thresholds:
    extraction_ratio: float = 1.5
    empty_min_turns: int = 5
    merge_atoms: int = 3
    scene_churn: float = 0.5
    core_churn: float = 0.5
    rapid_minutes: float = 60
    growth_spike: int = 10


def decision_counts(passes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Zero-filled decision counts per action for every pass."""
    counts = decisions.groupBy("pass_id").pivot("action", ACTIONS).agg(F.count(F.lit(1)))
    return passes.select("pass_id").join(counts, "pass_id", "left").fillna(0, ACTIONS)


def pass_summary(
    passes: DataFrame, decisions: DataFrame, scene_fx: DataFrame, core_fx: DataFrame
) -> DataFrame:
    scenes = scene_fx.groupBy("pass_id").agg(F.count(F.lit(1)).alias("scene_effects"))
    core = core_fx.select("pass_id", (F.col("effect") != "unchanged").alias("core_changed"))
    return (
        passes.join(decision_counts(passes, decisions), "pass_id")
        .join(scenes, "pass_id", "left")
        .join(core, "pass_id", "left")
        .fillna(0, ["scene_effects"])
        .withColumn("core_changed", F.coalesce("core_changed", F.lit(False)))
    )


def list_passes(
    summaries: DataFrame, status: str | None = None, since_s: int | None = None,
    actions: Sequence[str] = (), last: int | None = None, as_of_s: int = 0,
) -> DataFrame:
    """Newest first; ten passes unless a time range or a number is given."""
    rows = summaries.where(F.col("status") == status) if status else summaries
    if since_s is not None:
        rows = rows.where(F.col("started_s") >= as_of_s - since_s)
    if actions:
        wanted = F.lit(False)
        for action in actions:
            wanted = wanted | (F.col(action) > 0)
        rows = rows.where(wanted)
    size = last if last is not None else (10 if since_s is None else None)
    rows = rows.orderBy(F.col("started_s").desc(), "pass_id")
    return rows.limit(size) if size is not None else rows


def sample_decisions(decisions: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` decisions uniformly by a seeded SHA-256 of pass and id: repeatable anywhere, top-n per task."""
    return decisions.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "pass_id", "id"), 256), "id").limit(n)


def pass_counters(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """stored (unique atoms), updated, merged and skipped per pass; targets name losers."""
    replaced = targets.join(
        decisions.select(F.col("id").alias("decision_id"), "atom_id"), "decision_id"
    ).where("atom_id IS NULL OR target_id <> atom_id")
    changing = replaced.groupBy("decision_id").agg(F.lit(True).alias("changes"))
    joined = decisions.join(changing, decisions["id"] == changing["decision_id"], "left")
    changes = F.coalesce("changes", F.lit(False))
    return joined.groupBy("pass_id").agg(
        F.countDistinct(F.when(F.col("action") == "store", F.coalesce("atom_id", "id"))).alias("stored"),
        F.count_if((F.col("action") == "update") & changes).alias("updated"),
        F.count_if((F.col("action") == "merge") & changes).alias("merged"),
        F.count_if(F.col("action") == "skip").alias("skipped"),
    )


def _warn(df: DataFrame, code: str, message: Column) -> DataFrame:
    return df.select("pass_id", F.lit(code).alias("code"), F.lit("warn").alias("level"), message.alias("message"))


def _percent(share: Column) -> Column:
    return F.floor(share * 100 + 0.5).cast("long").cast("string")


def extraction_warnings(passes: DataFrame, decisions: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    found = decisions.groupBy("pass_id").agg(F.count(F.lit(1)).alias("_found"))
    rows = passes.join(found, "pass_id", "left")
    n = F.coalesce("candidate_count", "_found", F.lit(0))
    turns = F.coalesce("input_turn_count", F.lit(0))
    large = rows.where((turns > 0) & (n / turns > t.extraction_ratio))
    empty = rows.where((turns >= t.empty_min_turns) & (n == 0))
    return _warn(
        large, "large_extraction",
        F.concat(n.cast("string"), F.lit(" candidates out of "), turns.cast("string"), F.lit(f" turns; limit {t.extraction_ratio:g} per turn")),
    ).unionByName(_warn(
        empty, "empty_extraction", F.concat(turns.cast("string"), F.lit(f" turns gave no candidate; expected from {t.empty_min_turns} turns on"))
    ))


def merge_warnings(decisions: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rows = decisions.where((F.col("action") == "merge") & (F.col("n_targets") >= t.merge_atoms))
    return _warn(rows, "large_merge", F.concat(
        F.lit("decision "), "id", F.lit(" merges "), F.col("n_targets").cast("string"), F.lit(f" atoms; limit {t.merge_atoms}"),
    ))


def scene_warnings(scene_fx: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    share = (F.col("n_added") + F.col("n_removed")) / F.greatest("members_before", "members_after", F.lit(1))
    rows = scene_fx.where(~F.col("effect").isin("created", "retired") & (share > t.scene_churn))
    return _warn(rows, "scene_churn", F.concat(
        _percent(share), F.lit("% of the members of "), F.col("scene_kind"), F.lit(" "), "scene_id", F.lit(f" moved; limit {t.scene_churn:.0%}"),
    ))


def growth_warnings(decisions: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    stored = decisions.where("action = 'store'").groupBy("pass_id").agg(F.count(F.lit(1)).alias("n"))
    return _warn(stored.where(F.col("n") >= t.growth_spike), "atom_growth_spike", F.concat(
        F.lit("the pass stored "), F.col("n").cast("string"), F.lit(f" atoms; limit {t.growth_spike}"),
    ))


def supersession_warnings(ages: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    age = F.col("age_minutes")
    rows = ages.where(F.col("action").isin("update", "merge") & (age >= 0) & (age < t.rapid_minutes))
    return _warn(rows, "rapid_supersession", F.concat(
        F.lit("decision "), "decision_id", F.lit(" replaces "), "target_id", F.lit(", which is "),
        F.floor(age + 0.5).cast("long").cast("string"), F.lit(f" minutes old; limit {t.rapid_minutes:g}"),
    ))


def core_warnings(core_fx: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    old, new = F.col("old_chars"), F.col("new_chars")
    share = F.abs(new - old) / F.greatest(old, F.lit(1))
    rows = core_fx.where((F.col("effect") == "regenerated") & (old > 0) & (share > t.core_churn))
    return _warn(rows, "core_churn", F.concat(
        F.lit("profile went from "), old.cast("string"), F.lit(" to "), new.cast("string"), F.lit(" characters, "),
        _percent(share), F.lit(f"%; limit {t.core_churn:.0%}"),
    ))


def pass_warnings(
    passes: DataFrame, decisions: DataFrame, scene_fx: DataFrame, core_fx: DataFrame, ages: DataFrame,
    t: Thresholds = Thresholds(),
) -> DataFrame:
    parts = [
        extraction_warnings(passes, decisions, t), merge_warnings(decisions, t), scene_warnings(scene_fx, t),
        growth_warnings(decisions, t), supersession_warnings(ages, t), core_warnings(core_fx, t),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def data_gaps(
    passes: DataFrame, decisions: DataFrame, scene_fx: DataFrame, core_fx: DataFrame, found_turns: DataFrame
) -> DataFrame:
    """Notices about history a pass no longer has; three of them hold for every pass."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("pass_id").agg(F.count(F.lit(1)).alias(name))

    rows = (
        passes.join(count(found_turns, "turns"), "pass_id", "left")
        .join(count(decisions, "dec"), "pass_id", "left")
        .join(count(scene_fx, "scn"), "pass_id", "left")
        .join(count(core_fx, "cor"), "pass_id", "left")
        .fillna(0, ["turns", "dec", "scn", "cor"])
    )

    def gap(condition: Column, tier: str, notice: Column) -> Column:
        return F.when(condition, F.struct(F.lit(tier).alias("tier"), notice.alias("notice")))

    def of(have: str, want: str, tail: str) -> Column:
        return F.concat(F.col(have).cast("string"), F.lit(" of "), F.col(want).cast("string"), F.lit(tail))

    always = F.lit(True)
    gaps = F.array(
        gap(always, "T1", F.lit("Earlier counts and states of atoms are not kept.")),
        gap(always, "T2", F.lit("Earlier texts and member lists of scenes are not kept.")),
        gap(always, "T3", F.lit("Earlier profile texts are not kept.")),
        gap((F.col("input_turn_count") > 0) & (F.col("turns") < F.col("input_turn_count")), "T0",
            of("turns", "input_turn_count", " turns of the pass are still stored.")),
        gap(F.col("dec") < F.col("candidate_count"), "T1",
            of("dec", "candidate_count", " decisions of the pass are logged.")),
        gap(F.col("scn") == 0, "T2", F.lit("The pass logged no scene effect.")),
        gap(F.col("cor") == 0, "T3", F.lit("The pass logged no profile effect.")),
    )
    return rows.select("pass_id", F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("g")).select("pass_id", "g.*")


def compare_passes(summaries: DataFrame, block: Block) -> DataFrame:
    """Each pass beside the one before it in its store.

    The previous pass is the row with the next lower rank; ranks come from a blocked
    scan, so a store with most of the passes is not sorted by one task.
    """
    ranked = blocked_row_number(summaries, ["store_key"], [block], ["started_s", "pass_id"], "place")
    fields = ["pass_id", "status", "input_turn_count", "candidate_count", "watermark_start", "watermark_end"]
    now = ranked.select("store_key", "place", *fields)
    before = ranked.select("store_key", (F.col("place") + 1).alias("place"), *[F.col(f).alias(f"prev_{f}") for f in fields])
    return now.join(before, ["store_key", "place"], "left")


def narration_failures(passes: DataFrame) -> DataFrame:
    hit = F.regexp_extract("error", r"(\d+)\s+scene narration failure", 1)
    rows = passes.where((F.col("status") == "failed") & F.contains("error", F.lit("scene narration failure")))
    return rows.select("pass_id", F.when(hit != "", hit.cast("long")).otherwise(1).alias("failures"))


def reconciliation_passes(passes: DataFrame) -> DataFrame:
    return passes.where("input_turn_count = 0")


def scene_changed(scene_fx: DataFrame) -> DataFrame:
    changed = (F.col("effect") != "unchanged") | F.col("summary_regenerated") | F.col("embedding_regenerated")
    return scene_fx.withColumn("changed", changed)


def membership_diff(moves: DataFrame, after: DataFrame) -> DataFrame:
    """moves(store_key, pass_id, scene_id, atom_id, change) and members after -> removed, kept, added rows."""
    keys = ["store_key", "pass_id", "scene_id", "atom_id"]
    marker = F.when(F.col("change") == "added", "+").otherwise("-")
    moved = moves.where(F.col("change").isin("added", "removed")).select(*keys, marker.alias("marker"))
    kept = after.select(keys).join(moved.where("marker = '+'"), keys, "left_anti")
    return moved.unionByName(kept.withColumn("marker", F.lit("=")))


def replay_membership(passes: DataFrame, scene_fx: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership of every scene after every pass from its first clean creation on.

    passes(pass_id, place) give the order within the store, place without holes;
    scene_fx(pass_id, scene_id, effect, members_before, members_after, n_added[, place]);
    moves(pass_id, scene_id, atom_id, change). Returns (quality, members):
    quality(scene_id, pass_id, place, quality, before, after) and the membership as
    intervals members(scene_id, atom_id, from_place, to_place).

    Each (scene, atom) pair has its own short history of adds and removes: it is a
    member from an add that takes it in until the next remove. Sizes follow as
    running sums of those events, so no member list is ever gathered in one row.
    """
    fx = scene_fx if "place" in scene_fx.columns else scene_fx.join(passes.select("pass_id", "place"), "pass_id")
    clean = (
        (F.col("effect") == "created") & (F.col("members_before") == 0)
        & (F.col("n_added") == F.col("members_after"))
    )
    base = fx.groupBy("scene_id").agg(F.min(F.when(clean, F.col("place"))).alias("base"))
    known = fx.join(base, "scene_id")
    # Only moves of scenes with a clean creation count: the others leave where they are read, before any shuffle.
    live = cut_lineage(known.where("place >= base").select("scene_id", "pass_id", "place", "base", "members_before", "members_after"))
    here = live.select("scene_id", "pass_id", "place")
    step = F.when(F.col("change") == "added", 1).otherwise(0)
    moved = moves.where(F.col("change").isin("added", "removed")).join(here, ["scene_id", "pass_id"], "left_semi")
    moves = moved.join(here, ["scene_id", "pass_id"]).select("scene_id", "place", step.alias("step"), "atom_id").distinct()
    own = Window.partitionBy("scene_id", "atom_id").orderBy("place", "step")
    before = F.lag("step", 1, 0).over(own)
    at_pass = Window.partitionBy("scene_id", "atom_id", "place").orderBy("step")
    judged = moves.withColumn("was", before)
    removed_same_pass = F.lag("step").over(at_pass).isNotNull()
    judged = judged.withColumns({
        "delta": F.when((F.col("step") == 1) & (F.col("was") == 0), 1)
        .when((F.col("step") == 0) & (F.col("was") == 1), -1).otherwise(0),
        # An add counts as bad against the members before the pass, as does a remove.
        "bad": F.when(F.col("step") == 0, F.col("was") == 0).otherwise(
            F.when(removed_same_pass, F.lag("was").over(at_pass) == 1).otherwise(F.col("was") == 1)
        ),
    })
    per_pass = judged.groupBy("scene_id", "place").agg(
        F.sum("delta").alias("delta"), F.max("bad").alias("bad")
    )
    # Running sums over the passes of a scene, block by block: one scene may hold most rows.
    block = ("_blk", F.floor(F.col("place") / PLACE_BLOCK))
    rows = live.select("scene_id", "pass_id", "place", "base", "members_before", "members_after").join(
        per_pass, ["scene_id", "place"], "left"
    ).fillna(0, ["delta"])
    sized = blocked_running(
        rows, ["scene_id"], block, ["place"], {"after": ("sum", F.col("delta")), "_seen": ("sum", F.lit(1))}
    ).withColumn("before", F.col("after") - F.col("delta"))
    wrong = (
        F.coalesce("bad", F.lit(False)) | (F.col("members_before") != F.col("before"))
        | (F.col("members_after") != F.col("after"))
    )
    gap = F.col("_seen") < F.col("place") - F.col("base") + 1
    flagged = blocked_running(
        sized.withColumn("_wrong", wrong), ["scene_id"], block, ["place"], {"_ever": ("max", F.col("_wrong"))}
    ).withColumn("_partial", F.col("_ever") | gap)
    quality = flagged.select(
        "scene_id", "pass_id", "place",
        F.when(F.col("_partial"), "partial").otherwise("complete").alias("quality"),
        F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"),
    ).unionByName(
        known.where("base IS NULL OR place < base").select(
            "scene_id", "pass_id", "place", F.lit("unavailable").alias("quality"),
            F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("after"),
        )
    )
    turns_ = judged.where("delta <> 0")
    ends = F.lead("place").over(Window.partitionBy("scene_id", "atom_id").orderBy("place", "step"))
    members = turns_.withColumn("to_place", ends).where("delta = 1").select(
        "scene_id", "atom_id", F.col("place").alias("from_place"), "to_place"
    )
    return quality, members
