"""The recall log as a stream: counts, empty rates and latencies by tenant and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.querylog import SCHEMA


def read_log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New JSON-lines files of a folder as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed_recalls(log: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(tenant, start, end, recalls, empty_rate, mean_latency_ms): lines later than ``late`` are left out.

    Works on streams and tables. Lines without a time have no window; those without a tenant count as ``?``.
    """
    rows = log.where((F.col("event") == "recall") & F.col("ts").isNotNull()).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    w = rows.groupBy(F.coalesce("tenant", F.lit("?")).alias("tenant"), F.window("at", window).alias("w"))
    got = w.agg(F.count(F.lit(1)).alias("recalls"), F.avg(F.coalesce("empty", F.lit(False)).cast("double")).alias("empty_rate"), F.avg("latency_ms").alias("mean_latency_ms"))
    return got.select("tenant", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "recalls", "empty_rate", "mean_latency_ms")
