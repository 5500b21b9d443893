"""Versioned snapshots with a checksum manifest, and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every data file below ``path``, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "part-*"
    ).load(path)
    relative = F.element_at(F.split("path", F.lit(path.rstrip("/") + "/"), 2), -1)
    return files.select(
        relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table below a fresh folder and return the manifest (also written, last)."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/data/{name}")
    manifest = manifest_of(spark, f"{path}/data")
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def verify_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Verdict per expected file: ok, missing, size or checksum."""
    have = found.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    verdict = (
        F.when(F.col("_b").isNull(), "missing").when(F.col("_b") != F.col("bytes"), "size")
        .when(F.col("_s") != F.col("sha256"), "checksum").otherwise("ok")
    )
    return expected.join(have, "path", "left").select("path", verdict.alias("verdict"))


def check_dimension(expected_dim: int, vectors: DataFrame) -> DataFrame:
    """Vector sizes of the target that disagree with the snapshot."""
    size = F.size("embedding").cast("long")
    return vectors.where("embedding IS NOT NULL").groupBy(size.alias("dim")).agg(
        F.count(F.lit(1)).alias("n")
    ).where(F.col("dim") != expected_dim)
