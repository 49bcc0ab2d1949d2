"""Structured Streaming over the events table: an extra beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values per type and tumbling window; the same plan runs on a table and on a stream."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    out = stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Everything that has arrived, as a table in memory: for small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
