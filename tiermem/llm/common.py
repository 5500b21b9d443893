"""Small helpers the operators of this folder share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermem.session import cut_lineage, shared_folder

__all__ = ["bucketed", "cut_lineage", "held_out", "read", "release", "row_sample", "text_rows"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    """Whether a row's id falls to the rows no label is learned from."""
    return F.crc32(F.col(id_col).cast("string")) % modulus == remainder


def row_sample(rows: DataFrame, group: str, wanted: int, id_col: str = "doc_id") -> DataFrame:
    """About ``wanted`` rows of every value of ``group`` (all, if it has fewer), chosen by a hash of the id.

    The shares come from counts over all rows; twice ``wanted`` bounds a group by
    far more than the spread of a hash draw.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30))
    keep = F.lit(False)
    for value, count in sorted(counts.items(), key=lambda x: str(x[0])):
        keep = keep | (F.col(group).eqNullSafe(F.lit(value)) & (draw < int((1 << 30) * min(1.0, wanted / count))))
    return rows.filter(keep)


def text_rows(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[tuple[list, list]]:
    """Ids and texts of Arrow batches in slices of at most ``rows`` rows and about ``size`` bytes."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for key, text in zip(batch.column(0), batch.column(1)):
            value = text.as_py()
            ids.append(key.as_py())
            texts.append(value)
            held += len(value or "")
            if len(ids) >= rows or held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def bucketed(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Write the rows as a bucketed table in the shared folder, so joins and groups on ``column`` need no shuffle."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(parts, column).write.bucketBy(parts, column).format("parquet")
       .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Let the context drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
