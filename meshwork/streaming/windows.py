"""Streaming: shares of event types in tumbling windows, with a watermark for late rows.

The batch panel is built once per period; this is its incremental form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio


def read_events(spark: SparkSession, folder: str, files: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """A stream of a folder's parquet files; local timestamps become instants, which watermarks need."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_trigger:
        stream = stream.option("maxFilesPerTrigger", per_trigger)
    return stream.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_shares(events: DataFrame, types: list[str], width: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, total, one share per type) of each window; works on streams (append or update) and on tables."""
    sums = [F.sum(F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0)).alias(t) for t in types]
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), *sums)
    return w.select(F.col("w.start").alias("start"), "n", "total", *[ratio(F.col(t), F.col("total")).alias(t) for t in types])


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into an in-memory table, for tests."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
