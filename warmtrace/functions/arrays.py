"""Expressions over arrays of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import convert_units, round_py


def clean_numbers(values: Column) -> Column:
    """Drop null, NaN and unparseable items from an array."""
    numbers = F.transform(values, lambda x: x.try_cast("double"))
    return F.filter(numbers, lambda x: x.isNotNull() & ~F.isnan(x))


def median_of(numbers: Column) -> Column:
    """Median of an array of numbers, null when empty."""
    ordered = F.array_sort(numbers)
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def median_memory(df: DataFrame, column: str = "memory_gb") -> DataFrame:
    """Add ``memory_mb``: median of a GB array, in MB, halves to even."""
    mb = round_py(convert_units(median_of(clean_numbers(F.col(column))), "gb_to_mb"))
    return df.withColumn("memory_mb", mb)


def zip_shortest(left: Column, right: Column) -> Column:
    """Pair two arrays up to the shorter length as structs ``left, right``."""
    n = F.least(F.size(left), F.size(right))
    return F.arrays_zip(F.slice(left, F.lit(1), n).alias("left"),
                        F.slice(right, F.lit(1), n).alias("right"))
