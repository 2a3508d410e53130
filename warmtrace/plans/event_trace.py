"""The driver tables seen as traces and as raw inputs of the dataset loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import round_java


def as_event_trace(events: DataFrame) -> DataFrame:
    """Rows of ``events`` as a trace; ``app`` is an extra column."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.concat(F.lit("o"), F.col("user_id") % 20).alias("owner"),
        F.concat(F.lit("f"), F.col("user_id") % 20, F.lit("_"), F.col("event_type")).alias("function"),
        F.col("event_type").alias("app"),
        (128 * (1 + k % 8)).cast("int").alias("memory_mb"),
        round_java(F.col("value") * 10000).alias("duration_ms"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("event_id").alias("seq"))


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_trace(spark.read.parquet(f"{sf_dir}/events.parquet"))


def based_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with times from 0."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = events.select(F.min(F.unix_millis(F.col("ts").cast("timestamp")))).scalar()
    return event_trace(spark, sf_dir).withColumn("ts_ms", F.col("ts_ms") - first)
