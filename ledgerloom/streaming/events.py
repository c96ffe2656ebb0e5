"""Streaming over event logs: windows with late data, sessions, repeated events, expiring counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import Workspace


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder; ``ts`` becomes a time that watermarks take."""
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))


def user_sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_deliveries(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, through a checkpointed file or memory sink in the shared folder."""
    work = Workspace(spark, "stream")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{work.root}/out").option("checkpointLocation", f"{work.root}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{work.root}/out")
    kept: dict[str, DataFrame] = {}

    def keep(batch: DataFrame, _: int) -> None:
        kept["last"] = work.table(batch, "batch")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{work.root}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return kept["last"] if kept else spark.createDataFrame([], stream.schema)


def into_table(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch through ``merge`` (an upsert, say), exactly once by batch id."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
