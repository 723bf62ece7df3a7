"""Streams of measurement samples: windows joined as a static side, sums kept by window and entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.windows import normalise

SAMPLE = "entity string, ts_us long, metric string, value double, unit string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def window_sums(stream: DataFrame, windows: DataFrame, lateness: str | None = None) -> DataFrame:
    """(window, metric, entity, sum_value, n) in update mode. Samples may come late without limit unless lateness bounds the state."""
    s = normalise(stream).withColumn("ts", F.timestamp_micros("ts_us"))
    s = s.withWatermark("ts", lateness) if lateness else s
    joined = s.join(F.broadcast(windows), (F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") < F.col("end_us")))
    return joined.groupBy(F.col("name").alias("window"), "metric", "entity").agg(F.sum("value").alias("sum_value"), F.count("*").alias("n"))
