"""Rounding and unit rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import OPTIMISED_RATIO

UNIT_FACTORS = {"gb_to_mb": 1024, "mb_to_gb": 1 / 1024, "s_to_ms": 1000, "ms_to_s": 1 / 1000}


def round_java(x: Column) -> Column:
    """Nearest integer, halves up (also for negatives)."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def round_py(x: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.bround(x, 0).cast("bigint")


def convert_units(x: Column, unit: str) -> Column:
    return x * F.lit(UNIT_FACTORS[unit])


def optimised_footprint(memory: Column) -> Column:
    return (memory * F.lit(OPTIMISED_RATIO)).cast("int")


def ceil_div(x: Column, size: int) -> Column:
    """Smallest integer not below x / size, for x >= 0, without leaving integers."""
    up = (x + F.lit(size - 1)).cast("bigint")
    return ((up - F.pmod(up, F.lit(size))) / F.lit(size)).cast("bigint")
