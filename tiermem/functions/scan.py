"""Ordered prefix computations (ranks, running maxima) that never put a whole
partition key in one task.

A window over ``store_key`` sorts every row of a store in one task. Here the rows
of a key are cut into value-defined blocks whose order agrees with the wanted
order; only one small row per block goes through the key-wide window, and the rows
themselves are windowed inside their block. Blocks are column expressions, so a
recomputed task cuts exactly the same blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Block = tuple[str, Column]


def _exclusive_prefix(
    per_block: DataFrame, part: Sequence[str], names: Sequence[str], value: str
) -> DataFrame:
    """Sum of ``value`` over all earlier blocks of the key, one level at a time."""
    offsets = None
    for depth in range(1, len(names) + 1):
        level_keys = [*part, *names[:depth]]
        level = per_block.groupBy(*level_keys).agg(F.sum(value).alias("_size"))
        earlier = (
            Window.partitionBy(*part, *names[: depth - 1])
            .orderBy(names[depth - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        level = level.select(
            *level_keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_own")
        )
        if offsets is None:
            offsets = level.withColumnRenamed("_own", "_before")
        else:
            offsets = level.join(offsets, [*part, *names[: depth - 1]]).select(
                *level_keys, (F.col("_before") + F.col("_own")).alias("_before")
            )
    return offsets


def blocked_row_number(
    df: DataFrame,
    part: Sequence[str],
    blocks: Sequence[Block],
    order: Sequence[Column | str],
    out: str = "rn",
) -> DataFrame:
    """``row_number()`` over ``part`` ordered by (blocks..., order), from 1."""
    names = [name for name, _ in blocks]
    keys = [*part, *names]
    blocked = df.withColumns(dict(blocks))
    # The join drops null keys anyway; said here, every level shares one exchange of the sizes.
    known = blocked.where(" AND ".join(f"{key} IS NOT NULL" for key in keys))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _exclusive_prefix(sizes, part, names, "_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        blocked.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_inside", "_before", *names)
    )


def blocked_running(
    df: DataFrame,
    part: Sequence[str],
    block: Block,
    order: Sequence[Column | str],
    values: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Running aggregates up to and with the current row of ``part`` in (block, order).

    ``values`` maps each output column to ("sum" or "max", value); nulls are skipped.
    """
    name, expr = block
    keys = [*part, name]
    blocked = df.withColumns({name: expr, **{f"_v_{out}": value for out, (_, value) in values.items()}})
    fold = {"sum": F.sum, "max": F.max}
    per_block = blocked.groupBy(*keys).agg(
        *[fold[kind](f"_v_{out}").alias(f"_t_{out}") for out, (kind, _) in values.items()]
    )
    earlier = (
        Window.partitionBy(*part).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_block.select(
        *keys, *[fold[kind](f"_t_{out}").over(earlier).alias(f"_c_{out}") for out, (kind, _) in values.items()]
    )
    inside = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    running = blocked.withColumns(
        {f"_r_{out}": fold[kind](f"_v_{out}").over(inside) for out, (kind, _) in values.items()}
    ).join(carry, keys)

    def total(out: str, kind: str) -> Column:
        before, here = F.col(f"_c_{out}"), F.col(f"_r_{out}")
        if kind == "max":
            return F.greatest(before, here)
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))

    helpers = [f"{mark}{out}" for out in values for mark in ("_v_", "_c_", "_r_")]
    return running.withColumns({out: total(out, kind) for out, (kind, _) in values.items()}).drop(*helpers, name)


def blocked_running_max(
    df: DataFrame, part: Sequence[str], block: Block, order: Sequence[Column | str], value: Column, out: str
) -> DataFrame:
    return blocked_running(df, part, block, order, {out: ("max", value)})
