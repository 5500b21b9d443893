"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tiermem.plans import catalog
from tiermem.session import local_session
from tiermem.sources.views import MemoryViews

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "search_atoms_l6", "search_scenes_l7", "dense_atoms_l2", "context_budgets_l9", "usage_metrics_m4", "context_efficiency_m5",
    "leader_clusters_d14", "match_topics_d15_d17", "decision_evidence_j4", "window_evidence_j5", "latency_tags_j12",
    "tagged_histogram_m9", "store_inventory_m1", "pass_summary_m7", "pass_warnings_k9", "episodes_d13", "plan_windows_d4",
    "apply_usage_c9_h6", "parse_candidates_c4", "parse_decisions_c5", "core_hashes_d21", "reembed_d2", "current_atoms_e2",
    "replay_membership_k11",
]


def main() -> None:
    memory = os.environ.get("BENCH_MEMORY", "8g")
    spark = local_session(CPUS, memory=memory, **{"spark.sql.shuffle.partitions": CPUS})
    runs = catalog.callables()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}

    def timed(name: str, *makes) -> None:
        start = time.perf_counter()
        for make in makes:
            make()
        seconds[name] = round(time.perf_counter() - start, 3)

    # What a deployment has at hand: the stored tables and the kept indexes. Their making counts, under its own names.
    views = MemoryViews(spark, FOLDER)
    timed("build_tables", lambda: views.turns, lambda: views.atoms, lambda: views.atom_evidence, lambda: views.scenes, lambda: views.recall_queries)
    timed("build_indexes", lambda: views.atom_index, lambda: views.scene_index)
    for name in HEADLINE:
        start = time.perf_counter()
        runs[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
