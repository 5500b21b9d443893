"""Vectors in Spark: packed blocks, exact block-wise nearest neighbours, hashing embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

SCORE_DIGITS = 9
# Most fixed rows one task holds, streamed rows per slice.
FIXED_ROWS = 8192
SLICE_ROWS = 200_000


def hash_embed(text: Column, dim: int = 768) -> Column:
    """Deterministic embedding: position-folded character codes, unit length.

    Runs on Arrow batches; each text is folded with one numpy reshape.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def fold(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            codes = np.frombuffer((text or "").encode("utf-16-le"), dtype="<u2") / 255.0
            padded = np.zeros(-(-max(len(codes), 1) // dim) * dim)
            padded[: len(codes)] = codes
            folded = padded.reshape(-1, dim).sum(axis=0)
            norm = np.sqrt((folded * folded).sum()) or 1.0
            out.append((folded / norm).astype("float32"))
        return pd.Series(out)

    return fold(text)


def is_valid_vector(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows of one matrix; unequal lengths are an error (``check_vectors`` finds them)."""
    sizes = np.asarray(column.value_lengths())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal length in one store; reject them with check_vectors first")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _rows(key: str, columns: tuple[list, list, list]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.float64()]
    arrays = [pa.array(values, type=kind) for values, kind in zip(columns, types)]
    return pa.RecordBatch.from_arrays([pa.array([key] * len(columns[0]), pa.string()), *arrays], ["k", "fixed_id", "id", "score"])


class _TopN:
    """The ``n`` best streamed rows of every fixed row, ties by id."""

    def __init__(self, ids: list[str], matrix: np.ndarray, n: int):
        self.ids, self.matrix, self.n = ids, matrix, n
        self.best: list[list[tuple[float, str]]] = [[] for _ in ids]

    def feed(self, ids: np.ndarray, matrix: np.ndarray) -> tuple[list, list, list]:
        scores = np.round(self.matrix @ matrix.T, SCORE_DIGITS)
        for at, best in enumerate(self.best):
            line = scores[at]
            floor = -best[-1][0] if len(best) == self.n else -np.inf
            if len(line) > self.n:
                floor = max(floor, np.partition(line, len(line) - self.n)[len(line) - self.n])
            picked = np.flatnonzero(line >= floor)
            if len(picked):
                merged = best + list(zip((-line[picked]).tolist(), ids[picked].tolist()))
                self.best[at] = sorted(merged)[: self.n]
        return [], [], []

    def finish(self) -> tuple[list, list, list]:
        flat = [(q, i, -s) for q, best in zip(self.ids, self.best) for s, i in best]
        return [f[0] for f in flat], [f[1] for f in flat], [f[2] for f in flat]


class _BestEarlier:
    """For every streamed row the best fixed row (lowest id on a tie), optionally below its id."""

    def __init__(self, ids: list[str], matrix: np.ndarray, only_smaller: bool):
        order = np.argsort(np.asarray(ids, dtype=str), kind="stable")
        self.ids, self.matrix = np.asarray(ids, dtype=str)[order], matrix[order]
        self.only_smaller = only_smaller

    def feed(self, ids: np.ndarray, matrix: np.ndarray) -> tuple[list, list, list]:
        scores = np.round(matrix @ self.matrix.T, SCORE_DIGITS)
        if self.only_smaller:
            below = np.searchsorted(self.ids, ids.astype(str))
            scores[np.arange(len(self.ids))[None, :] >= below[:, None]] = -np.inf
        at = scores.argmax(axis=1)
        top = scores[np.arange(len(ids)), at]
        some = np.isfinite(top)
        return self.ids[at[some]].tolist(), ids[some].tolist(), top[some].tolist()

    def finish(self) -> tuple[list, list, list]:
        return [], [], []


def _meet(streamed: DataFrame, fixed: DataFrame, scorer: Callable, fixed_rows: int) -> DataFrame:
    """Score streamed rows (k, id, v) against fixed rows (k, id, v) of the same key.

    Fixed rows in blocks, streamed rows in slices; every (block, slice) of a key is one sorted run.

    A key with many rows has many slices, so a hot key is spread; the fixed rows of a
    block are repeated once per slice and the streamed rows once per block.
    """
    blocks = fixed.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / fixed_rows).cast("int").alias("n_blocks"))
    slices = streamed.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("n_slices"))
    sizes = blocks.join(slices, "k")

    def placed(df: DataFrame, own: str, other: str, own_n: str, other_n: str, kind: int) -> DataFrame:
        return df.join(sizes, "k").select(
            "k", F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other),
            F.lit(kind).alias("kind"), "id", "v",
        )

    group = ["k", "block", "slice"]
    both = placed(fixed, "block", "slice", "n_blocks", "n_slices", 0).unionByName(
        placed(streamed, "slice", "block", "n_slices", "n_blocks", 1)
    )
    runs = both.repartition(*group).sortWithinPartitions(*group, "kind").select(*group, "kind", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors, one = None, [], [], None
        for batch in batches:
            marks = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            start = 0
            while start < len(marks):
                end = start
                while end < len(marks) and marks[end] == marks[start]:
                    end += 1
                if marks[start][:3] != current:
                    if one is not None:
                        yield _rows(current[0], one.finish())
                    current, ids, vectors, one = marks[start][:3], [], [], None
                part = batch.slice(start, end - start)
                if marks[start][3] == 0:
                    ids.extend(part.column(4).to_pylist())
                    vectors.append(_matrix(part.column(5)))
                elif ids:
                    one = one or scorer(ids, np.concatenate(vectors))
                    names = np.asarray(part.column(4).to_pylist(), dtype=object)
                    yield _rows(current[0], one.feed(names, _matrix(part.column(5))))
                start = end
        if one is not None:
            yield _rows(current[0], one.finish())

    return runs.mapInArrow(run, "k string, fixed_id string, id string, score double")


def _side(df: DataFrame, id_col: str, key: str = "store_key", vec: str = "embedding") -> DataFrame:
    kept = df.where(F.col(vec).isNotNull())
    return kept.select(F.col(key).alias("k"), F.col(id_col).cast("string").alias("id"), F.col(vec).alias("v"))


def nearest(queries: DataFrame, corpus: DataFrame, n: int, fixed_rows: int = FIXED_ROWS) -> DataFrame:
    """(query_id, id, score): exact dot-product candidates of every query in its store.

    Each task keeps the ``n`` best of the rows it sees, so the true top ``n`` is
    always among them; single pairs are never emitted.
    """
    found = _meet(
        _side(corpus, "id"), _side(queries, "query_id"), lambda ids, m: _TopN(ids, m, n), fixed_rows
    )
    return found.select(F.col("fixed_id").alias("query_id"), "id", "score")


def best_leader(
    rows: DataFrame, leaders: DataFrame, only_smaller_ids: bool = False, fixed_rows: int = FIXED_ROWS
) -> DataFrame:
    """(store_key, id, leader_id, score): the most similar leader of every row, lowest id on a tie."""
    found = _meet(
        _side(rows, "id"), _side(leaders, "id"), lambda ids, m: _BestEarlier(ids, m, only_smaller_ids), fixed_rows
    )
    return found.groupBy(F.col("k").alias("store_key"), "id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "fixed_id")).alias("b")
    ).select("store_key", "id", F.col("b.fixed_id").alias("leader_id"), (-F.col("b.s")).alias("score"))
