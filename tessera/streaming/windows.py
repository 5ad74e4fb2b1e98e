"""Structured Streaming: windowed counts, sessions and incremental graph upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_folder


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream; a glob as path, so that it may be one file or a folder of them."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) by tumbling windows; events later than `late` are left to the batch path."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_once(counts: DataFrame) -> DataFrame:
    """Runs a stream over all there is and gives its complete state, written as Parquet, with the
    stream's own checkpoint, in the shared folder; nothing of it is held by the driver."""
    spark = counts.sparkSession
    root = f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"

    def write(state: DataFrame, _: int) -> None:
        state.write.mode("overwrite").parquet(f"{root}/state")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{root}/state")
