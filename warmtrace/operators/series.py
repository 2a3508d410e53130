"""Metric series: peaks, percentiles and cumulative distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expand import unfold
from .running import borders_of, range_of, running


def _ranked(s: DataFrame) -> DataFrame:
    """Distinct values per series with the number of values up to and including them; NaN is the largest.

    The borders of the ranges are quantiles of each series' own values, so no range holds much more
    than its share, however the values lie; NaN belongs to the last.
    """
    tally = s.groupBy("series", "value").agg(F.count("*").alias("n"))
    usual = F.when(~F.isnan("value"), F.col("value"))
    placed = tally.join(tally.groupBy("series").agg(borders_of(usual).alias("_borders")), "series")
    ranked = running(placed.withColumn("_range", range_of(F.col("_borders"), F.col("value"))).drop("_borders"), keys=["series"], chunk=F.col("_range"),
                     order=["value"], sums={"upto": F.col("n")})
    return ranked.drop("_range")


def series_max(s: DataFrame) -> DataFrame:
    return s.groupBy("series").agg(F.max("value").alias("peak"))


def series_cdf(s: DataFrame) -> DataFrame:
    """Sorted values, NaN last, against (i - 1) / n."""
    totals = s.groupBy("series").agg(F.count("*").alias("total"))
    steps = unfold(_ranked(s).join(totals, "series"), "n", "_copy")
    i = F.col("upto") - F.col("n") + F.col("_copy") - 1
    return steps.select("series", "value", i.alias("i"), (i / F.col("total")).alias("fraction"))


def series_percentiles(s: DataFrame, shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles per series."""
    totals = s.groupBy("series").agg(F.count("*").alias("total"))
    ranked = _ranked(s).join(totals, "series")
    picks = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("total")), F.col("value")))
             .alias(f"p{round(p * 100)}") for p in shares]
    return ranked.groupBy("series").agg(*picks)
