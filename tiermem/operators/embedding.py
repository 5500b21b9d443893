"""Embedding by a model hook, and vectors as a versioned table with a published pointer."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tiermem.functions import identity, text
from tiermem.functions.worker import kept
from tiermem.session import cut_lineage, path_exists

Encoder = Callable[[list[str]], np.ndarray]
BATCH = 256


def _vectors(model: Encoder, bodies: list[str], dim: int) -> list[tuple[list[float] | None, str | None]]:
    """Vector and error of every text: one call for all, or where that fails or gives unusable rows, one each."""
    def checked(vector) -> tuple[list[float] | None, str | None]:
        row = np.asarray(vector, dtype="float32")
        if row.shape != (dim,):
            return None, "wrong length"
        return (row.tolist(), None) if np.isfinite(row).all() else (None, "not finite")

    try:
        found = model(bodies)
        if len(found) == len(bodies):
            return [checked(v) for v in found]
    except Exception:  # one bad text must not lose the others: they are tried alone
        pass
    out = []
    for body in bodies:
        try:
            out.append(checked(model([body])[0]))
        except Exception as error:  # noqa: BLE001 - whatever the model says is the row's error
            out.append((None, f"{type(error).__name__}: {error}"[:200]))
    return out


def embed(rows: DataFrame, keys: Sequence[str], name: str, load: Callable[[], Encoder], dim: int, batch: int = BATCH) -> DataFrame:
    """rows(*keys, body) -> (*keys, embedding, error): partition batches through a model.

    ``load`` gives the model, once per Python worker and ``name``; it is called with at most ``batch`` texts at
    a time. A row the model fails on has a null vector and an error, and the others of its batch are
    unharmed. A null body is embedded as an empty text. Rows never meet, so there is no shuffle.
    """
    out = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL("embedding array<float>, error string")])
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for given in batches:
            for at in range(0, given.num_rows, batch):
                part = given.slice(at, batch)
                model = model or kept(("model", name), load)
                found = _vectors(model, [b or "" for b in part.column(len(keys)).to_pylist()], dim)
                columns = [part.column(i) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())], schema=shape)

    return rows.select(*keys, "body").mapInArrow(run, out)


def folding_model(dim: int) -> Callable[[], Encoder]:
    """The stand-in model: character codes folded by position, unit length."""
    def load() -> Encoder:
        def fold(bodies: list[str]) -> np.ndarray:
            out = np.zeros((len(bodies), dim), "float32")
            for at, body in enumerate(bodies):
                codes = np.frombuffer(body.encode("utf-16-le"), dtype="<u2") / 255.0
                sums = np.bincount(np.arange(len(codes)) % dim, weights=codes, minlength=dim)
                out[at] = sums / (np.sqrt((sums * sums).sum()) or 1.0)
            return out
        return fold
    return load


def tier_texts(turns: DataFrame, atoms: DataFrame, scenes: DataFrame) -> DataFrame:
    """(tier, store_key, id, render_hash, body) of every row of all three tiers, whatever the status."""
    none = F.lit("").alias("render_hash")
    return turns.select(F.lit("turns").alias("tier"), "store_key", "id", none, F.col("content").alias("body")).unionByName(
        atoms.select(F.lit("atoms").alias("tier"), "store_key", "id", none, F.col("content").alias("body"))).unionByName(
        scenes.select(
            F.lit("scenes").alias("tier"), "store_key", F.col("scene_id").alias("id"),
            identity.render_hash(F.col("title"), F.col("summary")).alias("render_hash"),
            text.scene_embed_text(F.col("title"), F.col("summary")).alias("body")))


class VectorTable:
    """Versions of a vector table in a folder, and a pointer to the one readers see.

    A version is written whole, checked, and then published by a pointer file; the pointer with the
    highest number counts. Readers of the old version are not disturbed, and a step that died before
    its pointer leaves the old version in place.
    """

    KEYS = ("tier", "store_key", "id", "render_hash")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def current(self) -> tuple[int, str, str] | None:
        """Number, folder and model of the published version; a row per swap is read."""
        if not path_exists(self.spark, f"{self.path}/pointers"):
            return None
        rows = self.spark.read.schema("folder string, model string, number int").parquet(f"{self.path}/pointers")
        best = rows.orderBy(F.desc("number")).first()
        return best and (best.number, best.folder, best.model)

    def read(self) -> DataFrame:
        now = self.current()
        if now is None:
            raise LookupError("no version is published")
        return self.spark.read.parquet(f"{self.path}/{now[1]}")

    def _publish(self, folder: str, model: str, number: int) -> None:
        self.spark.range(1).select(F.lit(folder).alias("folder"), F.lit(model).alias("model")).write.mode("overwrite").parquet(
            f"{self.path}/pointers/number={number}")

    def swap(self, texts: DataFrame, model: str, load: Callable[[], Encoder], dim: int, failed: float = 0.0) -> DataFrame:
        """Embed every row of ``texts`` (KEYS, body) by the model and publish the new version.

        Returns the rows the model failed on, with their errors; if their share is above ``failed``,
        nothing is published. Failed rows have no vector in the new version. A refresh by the same model
        takes the vectors of rows whose render hash did not change from the old version.
        """
        now = self.current()
        number, folder = (now[0] + 1 if now else 1), f"version-{uuid.uuid4().hex}"
        keys = list(self.KEYS)
        same = None
        if now and now[2] == model:
            # Keys are compared without texts; texts only meet the keys of what changed, and tiers without a hash meet nothing.
            old = self.read().where("render_hash <> '' AND embedding IS NOT NULL").select(*keys, "embedding", "error")
            hashed = F.coalesce(F.col("render_hash") != "", F.lit(False))
            ids = texts.where(hashed).select(*keys)
            same = old.join(ids, keys, "left_semi")
            changed = cut_lineage(ids.join(old.select(*keys), keys, "left_anti")).alias("c")
            equal = [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
            texts = texts.where(~hashed).unionByName(texts.where(hashed).alias("t").join(changed, equal, "left_semi"))
        fresh = embed(texts, keys, model, load, dim)
        (fresh if same is None else fresh.unionByName(same)).write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/{folder}")
        bad = written.where("error IS NOT NULL")
        total, lost = written.agg(F.count(F.lit(1)), F.count("error")).first()
        if lost <= failed * total:
            self._publish(folder, model, number)
        return bad.select(*keys, "error")
