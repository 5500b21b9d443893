"""Turn ingest to stored tables: exactly-once verdicts and store-global numbers, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tiermem.operators import ingest
from tiermem.session import folders, make_folder, path_exists

ARRIVAL = "arrival long, id string, store_key string, session_id string, turn_index long, turn_id string, content string"
TABLES = {
    "turns": ARRIVAL + ", seq long",
    "verdicts": "arrival long, id string, store_key string, session_id string, verdict string, kept_id string",
    "heads": "store_key string, head long",
}
ARRIVAL_BLOCK = 4096


class TurnLog:
    """Accepted turns with their numbers, the verdict on every arrival, and the head of every store.

    A batch is judged against the turns of all complete batches, numbered on from the heads, and
    written under its own number; a marker folder made last completes it. A batch that died
    halfway is written again, a complete one is left alone, so a replay changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def batches(self) -> list[int]:
        return sorted(int(name.removeprefix("batch=")) for name in folders(self.spark, f"{self.path}/done") if name.startswith("batch="))

    def read(self, name: str) -> DataFrame:
        """Rows of the complete batches, which are written one after the other."""
        schema = StructType.fromDDL(TABLES[name] + ", batch long")
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch") <= done[-1])

    def heads(self) -> DataFrame:
        return self.read("heads").groupBy("store_key").agg(F.max("head").alias("head"))

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Judge and store one batch of arrivals; false if it was complete before."""
        if path_exists(self.spark, f"{self.path}/done/batch={batch}"):
            return False
        later = [b for b in self.batches() if b > batch]
        if later:
            raise ValueError(f"batch {batch} comes after batch {later[-1]}, which is complete")
        rows = rows.select([F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(ARRIVAL)])
        accepted, duplicates, conflicts = ingest.ingest_turns(rows, self.read("turns"))
        numbered = ingest.assign_seq(accepted, self.heads(), ("_blk", F.floor(F.col("arrival") / ARRIVAL_BLOCK)), ["arrival", "id"])

        def write(name: str, df: DataFrame) -> DataFrame:
            path = f"{self.path}/{name}/batch={batch}"
            df.select(StructType.fromDDL(TABLES[name]).names).write.mode("overwrite").parquet(path)
            return self.spark.read.schema(TABLES[name]).parquet(path)

        stored = write("turns", numbered)
        write("heads", stored.groupBy("store_key").agg(F.max("seq").alias("head")))
        none = F.lit(None).cast("string")
        base = ["arrival", "id", "store_key", "session_id"]
        write("verdicts", stored.select(*base, F.lit("accepted").alias("verdict"), none.alias("kept_id")).unionByName(
            duplicates.select(*base, F.lit("duplicate").alias("verdict"), "kept_id")).unionByName(
            conflicts.select(*base, F.col("reason").alias("verdict"), none.alias("kept_id"))))
        make_folder(self.spark, f"{self.path}/done/batch={batch}")
        return True


def run_turn_log(arrivals: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Drain a stream of arrivals into the log; the stream's batch number is the log's."""
    log = TurnLog(arrivals.sparkSession, path)
    return arrivals.writeStream.foreachBatch(lambda rows, batch: log.append(rows, batch)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
