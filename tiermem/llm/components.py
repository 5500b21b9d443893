"""Connected components of a graph given as edges, by alternating stars.

Each round hangs the larger neighbours of every node, then its smaller ones, on the
smallest neighbour. The number of edges never grows and rounds are logarithmic in
practice. Every round is stored, so a lost executor costs one round; hubs are aggregated
before the shuffle and their joins may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermem.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node in the edges ``a``, ``b`` (long).

    Loops and repeated edges are ignored; nodes without an edge do not appear; no edges give no rows.
    """
    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut_lineage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct())
    before = None
    while True:
        now = state(edges)
        if now == before or not now[0]:
            break
        before = now
        edges = cut_lineage(_small_star(_large_star(edges)).filter("a <> b").distinct())
    # at the fixed point every node hangs directly on the smallest node of its component
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
