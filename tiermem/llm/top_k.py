"""Exact top-k search by inner product, a block of documents at a time.

Vectors are terms with integer weights. Rows are cut into slabs of document ranges, a
slab into blocks; a block keeps the largest and smallest weight of every term and a
forward index (the weights of its rows). For a query the blocks are ordered by the sum
of its weights times the blocks' extremes, an upper bound of any score in the block.
They are scored in that order until the bound falls below the query's k-th score.

Slabs meet blocks of queries by an equi-join over a shuffle; what leaves a meeting is at most
k rows per query, so a query's results are merged from k rows per slab.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermem.llm.common import cut_lineage

SLAB = 1 << 14
BLOCK = 256
QUERIES = 1024


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _packed(rows: DataFrame, size: int, width: int, name: str) -> DataFrame:
    """Rows (id, array of long) as packed slabs of at most ``size`` rows, ids ascending within a slab."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def pack() -> pa.RecordBatch:
            ids, values = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_pydict({"ids": pa.array([ids[order].tobytes()], pa.binary()),
                                               "values": pa.array([values[order].tobytes()], pa.binary())})

        for batch in batches:
            ids = np.asarray(batch.column(0)).astype(np.int64)
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            values = np.zeros((len(ids), width), np.int64)
            flat = np.asarray(lists.flatten()).astype(np.int64)
            values[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            at = 0
            while at < len(ids):
                some = min(size - count, len(ids) - at)
                held.append((ids[at:at + some], values[at:at + some]))
                at, count = at + some, count + some
                if count == size:
                    yield pack()
                    held, count = [], 0
        if held:
            yield pack()

    packed = rows.mapInArrow(run, "ids binary, values binary")
    return packed.withColumn(name, F.monotonically_increasing_id())


def _top(keys: np.ndarray, k: int) -> np.ndarray:
    return keys if keys.shape[1] <= k else np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:]


def search_slab(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of the k best rows of a slab for each query, ties to the smaller id; ``row_ids`` ascend."""
    n = len(row_ids)
    peak = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if peak >= 2 ** 42:  # beyond what the packed keys hold: every row, in Python integers
        out = []
        for q, query in zip(query_ids.tolist(), queries.tolist()):
            scores = sorted((-sum(a * b for a, b in zip(query, row)), i) for i, row in zip(row_ids.tolist(), rows.tolist()) if i != q)
            out += [(q, i, -s) for s, i in scores[:k]]
        return out
    blocks = [slice(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]
    index = rows.astype(np.float64)  # sums stay below 2**53, so products are exact
    wanted = queries.astype(np.float64)
    high = np.stack([index[b].max(0) for b in blocks])
    low = np.stack([index[b].min(0) for b in blocks])
    bounds = np.maximum(wanted, 0) @ high.T + np.minimum(wanted, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    best = np.full((len(wanted), k), none)
    own = np.searchsorted(row_ids, query_ids)
    own = np.where((own < n) & (row_ids[np.minimum(own, n - 1)] == query_ids), own, -1)
    active = np.arange(len(wanted))
    for step in range(len(blocks)):
        kth = best[active].min(1)
        open_ = (kth == none) | (bounds[active, order[active, step]] >= (kth >> 20))
        active = active[open_]
        if not len(active):
            break
        at = order[active, step]
        for b in np.unique(at):
            some = active[at == b]
            block = blocks[b]
            scores = np.rint(wanted[some] @ index[block].T).astype(np.int64)
            keys = (scores << 20) | ((1 << 20) - 1 - np.arange(block.start, block.stop))
            mine = (own[some] >= block.start) & (own[some] < block.stop)
            keys[np.flatnonzero(mine), own[some][mine] - block.start] = none
            best[some] = _top(np.concatenate([best[some], keys], axis=1), k)
    query, place = np.nonzero(best != none)
    keys = best[query, place]
    row = (1 << 20) - 1 - (keys & ((1 << 20) - 1))
    return list(zip(query_ids[query].tolist(), row_ids[row].tolist(), (keys >> 20).tolist()))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "weights") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k best rows for every query row.

    Both sides have an id and an array of long, which must not hold nulls; a shorter
    array counts as padded with zeros. A row is never its query's result. Rows that
    share an id count once, with the least array. Empty sides give no rows.
    """
    def plain(side: DataFrame) -> DataFrame:
        return side.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("weights"))

    rows, queries = cut_lineage(plain(rows)), plain(queries)
    width, count = rows.agg(F.max(F.size("weights")), F.count(F.lit(1))).first()
    if not count:
        width = 1
    queries = queries.withColumn("weights", F.slice("weights", 1, width))  # what no row has adds nothing
    slabs = cut_lineage(_packed(rows.repartitionByRange(max(1, -(-count // SLAB)), "id"), SLAB, width, "slab"))
    asked = cut_lineage(_packed(queries.coalesce(max(1, -(-count // (SLAB * 4)))), QUERIES, width, "asked"))
    # every block of queries visits every slab; slabs are numbered (one row per 16,384 rows) so that the visits are an equi-join
    numbers = slabs.select("slab", (F.row_number().over(Window.orderBy("slab")) - 1).alias("number"))
    visits = asked.select(F.col("ids").alias("query_ids"), F.col("values").alias("query_values"),
                          F.explode(F.sequence(F.lit(0), F.lit(max(0, slabs.count() - 1)))).alias("number"))
    # Spark takes the visits for as small as one copy of the queries, and would gather them all at the driver for a broadcast
    pairs = visits.hint("merge").join(slabs.join(numbers, "slab"), "number")
    pairs = pairs.select("query_ids", "query_values", "ids", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*(batch.column(i) for i in range(4))):
                q, qv, r, rv = (np.frombuffer(c.as_buffer(), dtype=np.int64) for c in cells)
                found = search_slab(qv.reshape(len(q), width), q, rv.reshape(len(r), width), r, k)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()),
                    "score": pa.array([f[2] for f in found], pa.int64())})

    merged = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
