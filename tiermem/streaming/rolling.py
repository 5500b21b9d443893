"""Event-time latency histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tiermem.operators.latency import BOUNDS_MS, bin_index


def rolling_histogram(
    samples: DataFrame, width: str = "5 minutes", late: str = "10 minutes", bounds: Sequence[float] = BOUNDS_MS
) -> DataFrame:
    """samples(store_key, ts, ms) -> (store_key, window_start, bin, n); later rows are dropped.

    Works on a stream and, unchanged, on a table.
    """
    ms = F.col("ms")
    valid = samples.where(ms.isNotNull() & ~F.isnan(ms) & (ms >= 0) & (ms != float("inf")))
    return (
        valid.withWatermark("ts", late)
        .groupBy("store_key", F.window("ts", width).alias("w"), bin_index(ms, bounds).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("store_key", F.col("w.start").alias("window_start"), "bin", "n")
    )
