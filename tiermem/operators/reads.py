"""Filters, paging and point lookups over the memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


LAST_INDEX = 999999999
GRAM = 3


def _where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for condition in conditions:
        if condition is not None:
            df = df.where(condition)
    return df


def _range(name: str, start: int | None, end: int | None) -> list[Column | None]:
    return [
        F.col(name) >= start if start is not None else None,
        F.col(name) <= end if end is not None else None,
    ]


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A sorted page; Spark keeps ``limit + offset`` rows per task, not a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def query_turns(
    turns: DataFrame, session: str | None = None, start: int | None = None,
    end: int | None = None, limit: int = 50, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """A page of turns and the total number that match."""
    matched = _where(
        turns, F.col("session_id") == session if session else None, *_range("ts_s", start, end)
    )
    order = [
        F.col("session_id"), F.coalesce("turn_index", F.lit(LAST_INDEX)),
        F.col("ts_s").desc(), F.col("id"),
    ]
    return page(matched, order, limit, offset), matched.agg(F.count(F.lit(1)).alias("total"))


def turns_after(turns: DataFrame, cursors: DataFrame, limit: int = 50) -> DataFrame:
    """The next turns of every store past its cursor, in ``seq`` order.

    ``row_number() <= limit`` is pruned per input partition before the shuffle.
    """
    ahead = turns.join(cursors.select("store_key", "cursor"), "store_key", "left").where(
        F.col("seq") > F.coalesce("cursor", F.lit(0))
    )
    place = F.row_number().over(Window.partitionBy("store_key").orderBy("seq"))
    return ahead.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place", "cursor")


def query_atoms(
    atoms: DataFrame, type_: str | None = None, status: str = "active", start: int | None = None,
    end: int | None = None, limit: int = 50, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    matched = _where(
        atoms, F.col("status") == status, F.col("type") == type_ if type_ else None,
        *_range("updated_s", start, end),
    )
    order = [F.col("updated_s").desc(), F.col("id")]
    return page(matched, order, limit, offset), matched.agg(F.count(F.lit(1)).alias("total"))


def list_scenes(
    scenes: DataFrame, kind: str | None = None, status: str = "active", limit: int = 50,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    matched = _where(
        scenes, F.col("status") == status, F.col("scene_kind") == kind if kind else None
    )
    order = [F.col("updated_s").desc(), F.col("scene_id")]
    return page(matched, order, limit, offset), matched.agg(F.count(F.lit(1)).alias("total"))


def lookup(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Rows for a batch of ids (store_key, key), whatever their status; ids their store does not know are flagged."""
    found = table.withColumn("found", F.lit(True))
    return ids.select("store_key", key).distinct().join(found, ["store_key", key], "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def pinned_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.where((F.col("status") == "active") & F.col("pinned"))


def resolve_topics(requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """requests(request_id, store_key, topic) -> the title that becomes the query.

    An exact active topic id wins; otherwise the newest active topic of the store
    whose title contains the needle. Titles meet needles through a shared run of
    at most three characters (an equi-join), and only then is containment checked.
    """
    topics = scenes.where((F.col("scene_kind") == "topic") & (F.col("status") == "active")).select(
        "store_key", "scene_id", "title", "updated_s", F.lower("title").alias("low")
    )
    exact = topics.select("store_key", F.col("scene_id").alias("topic"), F.col("title").alias("by_id"))
    needles = requests.select("store_key", "topic").distinct().withColumn("needle", F.lower("topic"))
    needles = needles.withColumn("gram", F.substring("needle", 1, GRAM))
    starts = F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1)))

    def runs_of(size: int) -> Column:
        return F.transform(starts, lambda at: F.substring(F.col("low"), at, F.lit(size)))

    runs = F.flatten(F.array(*[runs_of(size) for size in range(GRAM + 1)]))
    grams = topics.withColumn("gram", F.explode(F.array_distinct(runs)))
    by_title = (
        grams.join(needles, ["store_key", "gram"])
        .where(F.contains("low", "needle"))
        .groupBy("store_key", "topic")
        .agg(F.max(F.struct("updated_s", "scene_id", "title")).alias("best"))
        .select("store_key", "topic", F.col("best.title").alias("by_title"))
    )
    return (
        requests.join(exact, ["store_key", "topic"], "left")
        .join(by_title, ["store_key", "topic"], "left")
        .select(
            "request_id", "store_key", "topic", F.coalesce("by_id", "by_title").alias("query"),
            F.coalesce("by_id", "by_title").isNotNull().alias("found"),
        )
    )

