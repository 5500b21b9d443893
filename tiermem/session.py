"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int | str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tiermem")
    settings = {
        **SETTINGS,
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-warehouse-"),
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master (tests, bench) gets a folder of its own; on a cluster an
    unset folder is an error, because a machine-local one would not survive the
    loss of an executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    folder = folder or context.getCheckpointDir() or ""
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def _named(spark: SparkSession, path: str):
    context = spark.sparkContext
    name = context._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(context._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    name, files = _named(spark, path)
    return files.exists(name)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    name, files = _named(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(name)] if files.exists(name) else []


def make_folder(spark: SparkSession, path: str) -> None:
    name, files = _named(spark, path)
    files.mkdirs(name)


def kept_columns(make: Callable) -> Callable:
    """``make`` names its columns and gives expressions over them; these are built once per application and set of arguments.

    A nested expression takes a call to the JVM for every node, which steps with many small rounds would pay in each.
    """
    held: dict = {}

    @functools.wraps(make)
    def get(*args):
        key = (SparkContext._active_spark_context.applicationId, *args)
        if key not in held:
            held[key] = make(*args)
        return held[key]

    return get


def stored(df: DataFrame) -> str:
    """Write the rows as a table in the shared folder; its path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back.

    Later plans then start from files that survive a lost executor, and they know
    the real size of the table, so a join broadcasts it only when it is small.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))
