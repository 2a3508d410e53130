"""Column names, file headers and constants shared by every operator.

A *trace* is a DataFrame ``owner string, function string, memory_mb int,
duration_ms bigint, ts_ms bigint, seq bigint``.  ``(function, seq)`` identifies
a row; rows of one function are ordered by ``(ts_ms, seq)`` and rows of a whole
trace by ``(ts_ms, owner, function, seq)``, so results do not depend on
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACE = ["owner", "function", "memory_mb", "duration_ms", "ts_ms", "seq"]
ORDER = ["ts_ms", "owner", "function", "seq"]
FUNCTION_ORDER = ["ts_ms", "seq"]

# The file formats and the defaults of the published tools.
TRACE_HEADER = "HashOwner,HashFunction,AverageAllocatedMb,AverageDuration,Timestamp"
ENRICHED_HEADER = TRACE_HEADER + ",Language,Benchmark"
EVENT_ROWS_HEADER = "NamespaceHash,AppHash,AppContainerRequestMemory,AppExecTimes,InvocationTimes"
FUNCTION_MAPPING_HEADER = "HashFunction,CompressedHash"
OWNER_MAPPING_HEADER = "HashOwner,CompressedHash"
BENCHMARK_MAPPING_HEADER = "HashFunction,Benchmark"
MS_PER_MINUTE = 60_000
MINUTES_PER_DAY = 1_440
MINUTES_PER_WEEK = 10_080
SECONDS_PER_DAY = 86_400
KEEPALIVE_MS = 600_000
SAMPLE_MS = 1_000
HOT_COLD_STARTS = 10
HOT_PERIOD_MS = 60_000
OPTIMISED_RATIO = 0.375
VM_MB = 1_024
WORKERS = 100
WORKER_MB = 106_496


def end_ms(ts: str = "ts_ms", duration: str = "duration_ms") -> Column:
    """First instant at which an invocation no longer runs."""
    return F.col(ts) + F.col(duration)


def arrival_order() -> Column:
    """``(ts_ms, seq)`` as one number, which a hash aggregate can hold."""
    # Any two bigint seqs differ by less than the factor.
    factor = F.lit("20000000000000000000").cast("decimal(20,0)")
    return (F.col("ts_ms").cast("decimal(18,0)") * factor + F.col("seq")).cast("decimal(38,0)")


def with_end(tr: DataFrame) -> DataFrame:
    return tr.withColumn("end_ms", end_ms())


def as_trace(df: DataFrame, *extra: str) -> DataFrame:
    """Pick and type the trace columns, plus any named extras."""
    return df.select(
        F.col("owner").cast("string").alias("owner"),
        F.col("function").cast("string").alias("function"),
        F.col("memory_mb").cast("int").alias("memory_mb"),
        F.col("duration_ms").cast("bigint").alias("duration_ms"),
        F.col("ts_ms").cast("bigint").alias("ts_ms"),
        F.col("seq").cast("bigint").alias("seq"),
        *extra,
    )
