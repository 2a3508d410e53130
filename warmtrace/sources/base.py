"""What a trace source is: anything that loads invocations as a trace."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Source(Protocol):
    def load(self, spark: SparkSession, **options) -> DataFrame:
        """A trace: owner, function, memory_mb, duration_ms, ts_ms, seq."""
        ...
