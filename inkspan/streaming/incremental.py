"""Incremental counts over an event stream: watermarked windows, and diffs of snapshots for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators.versions import diff


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their values by type in tumbling windows; rows later than the watermark are left out."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "v")


def diff_each_batch(stream: DataFrame, current: Callable[[], DataFrame], take: Callable[[DataFrame, int], None], checkpoint: str):
    """foreachBatch: what a batch of mentions changes against the current snapshot."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: take(diff(current(), batch), k)).start()
