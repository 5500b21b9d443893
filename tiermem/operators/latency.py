"""Latency samples: tagging by pass in flight, fixed-bin histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tiermem.functions.scan import blocked_running_max

# Bin edges in milliseconds; the last bin is open.
BOUNDS_MS = [0, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000]
SCAN_BLOCK_S = 3600


def tag_active(samples: DataFrame, intervals: DataFrame, block_s: int = SCAN_BLOCK_S) -> DataFrame:
    """Was a pass of the store in flight (start <= t < end) when a sample was taken?

    Some interval covers t exactly when the latest end among the intervals that
    started by t lies after t. That is a running maximum over one sorted merge of
    starts and samples: linear work, no interval is repeated and none is compared
    with every sample.
    """
    starts = intervals.select(
        "store_key", F.col("start_s").alias("_t"), F.lit(0).alias("_kind"),
        F.col("end_s").alias("_end"), F.lit(None).cast("struct<event_id:bigint,ms:double>").alias("_s"),
    )
    observed = samples.select(
        "store_key", F.col("obs_s").alias("_t"), F.lit(1).alias("_kind"),
        F.lit(None).cast("long").alias("_end"),
        F.struct(F.col("event_id").cast("long").alias("event_id"), F.col("ms").cast("double").alias("ms")).alias("_s"),
    )
    scanned = blocked_running_max(
        starts.unionByName(observed), ["store_key"], ("_blk", F.floor(F.col("_t") / block_s)),
        ["_t", "_kind"], F.col("_end"), "_open_until",
    )
    active = F.coalesce(F.col("_open_until") > F.col("_t"), F.lit(False))
    return scanned.where("_kind = 1").select(
        F.col("_s.event_id").alias("event_id"), "store_key", F.col("_t").alias("obs_s"),
        F.col("_s.ms").alias("ms"), active.alias("active"),
    )


def bin_index(ms: Column, bounds: Sequence[float] = BOUNDS_MS) -> Column:
    expr = F.lit(len(bounds) - 1)
    for at in range(len(bounds) - 1, 0, -1):
        expr = F.when(ms < bounds[at], at - 1).otherwise(expr)
    return expr


def _valid(samples: DataFrame) -> DataFrame:
    ms = F.col("ms")
    return samples.where(ms.isNotNull() & ~F.isnan(ms) & (ms >= 0) & (ms != float("inf")))


def histogram(
    samples: DataFrame, by: Sequence[str] = (), bounds: Sequence[float] = BOUNDS_MS
) -> DataFrame:
    """Count per bin, empty bins included, for every group.

    The bins are columns of one aggregate (one row per group is shuffled) and are
    turned into rows afterwards, which also yields the zero bins without a join.
    """
    at = bin_index(F.col("ms"), bounds)
    counts = [F.count_if(at == n).alias(f"b{n}") for n in range(len(bounds))]
    wide = _valid(samples).groupBy(*by).agg(*counts)
    edges = [*bounds, None]
    cells = F.array(*[
        F.struct(
            F.lit(n).cast("long").alias("bin"), F.lit(float(edges[n])).alias("lo"),
            F.lit(float(edges[n + 1]) if edges[n + 1] is not None else float("inf")).alias("hi"),
            F.col(f"b{n}").alias("n"),
        )
        for n in range(len(bounds))
    ])
    return wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.bin", "c.lo", "c.hi", "c.n")


def histogram_stats(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ms = F.col("ms")
    return _valid(samples).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
        F.round(F.avg(ms), 6).alias("mean_ms"),
    )
