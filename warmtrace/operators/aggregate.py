"""Rates, popularity, dense ids and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MINUTES_PER_DAY, arrival_order
from .running import running, with_range


def rate_by_function(counts: DataFrame, last_row: bool = False) -> DataFrame:
    """Average invocations per minute of a day and function.

    ``counts`` is long (function, minute, count).  Repeated function keys add
    up; with ``last_row`` only the row with the highest ``row_pos`` counts.
    """
    if last_row:
        per_row = counts.groupBy("function", "row_pos").agg(F.sum("count").alias("n"))
        totals = per_row.groupBy("function").agg(F.max_by("n", "row_pos").alias("n"))
    else:
        totals = counts.groupBy("function").agg(F.sum("count").alias("n"))
    return totals.select("function", (F.col("n") / MINUTES_PER_DAY).alias("per_minute"))


def minute_vector_by_owner(counts: DataFrame) -> DataFrame:
    """Invocations per owner and minute, all functions together."""
    return counts.groupBy("owner", "minute").agg(F.sum("count").alias("count"))


def rate_by_owner(counts: DataFrame) -> DataFrame:
    """Average invocations per minute of a day and owner."""
    return (minute_vector_by_owner(counts).groupBy("owner")
            .agg((F.sum("count") / MINUTES_PER_DAY).alias("per_minute")))


def ranked_rates(rates: DataFrame, key: str) -> DataFrame:
    """Rates in ascending order."""
    return rates.orderBy("per_minute", key)


def count_by_function(tr: DataFrame) -> DataFrame:
    return tr.groupBy("function").agg(F.count("*").alias("invocations"))


def functions_by_owner(tr: DataFrame) -> DataFrame:
    return tr.groupBy("owner").agg(F.count_distinct("function").alias("functions"))


def owner_summary(tr: DataFrame) -> DataFrame:
    """Distinct functions and invocations per owner.

    Counts per (owner, function) first, so one busy owner is spread over its
    functions before the second, small grouping.
    """
    pairs = tr.groupBy("owner", "function").agg(F.count("*").alias("n"))
    return pairs.groupBy("owner").agg(F.count("*").alias("functions"),
                                      F.sum("n").alias("invocations"))


def dense_ids(tr: DataFrame, key: str) -> DataFrame:
    """Number the values of ``key`` 0, 1, ... in the order they first appear in ``seq``."""
    first = tr.groupBy(key).agg(F.min("seq").alias("first_seq"))
    numbered = running(with_range(first, "first_seq"), keys=[], chunk=F.col("_range"),
                       order=["first_seq", key], sums={"id": F.lit(1)})
    return numbered.select(key, (F.col("id") - 1).alias("id"))


def replace_ids(tr: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Replace ``key`` by its dense id."""
    return (tr.join(ids.select(key, "id"), key)
            .withColumn(key, F.col("id").cast("string")).drop("id"))


def first_duration(tr: DataFrame) -> DataFrame:
    """Duration of each function's first invocation."""
    return tr.groupBy("function").agg(F.min_by("duration_ms", arrival_order()).alias("duration_ms"))


def trace_mix(tr: DataFrame) -> DataFrame:
    """Invocations per language and benchmark, with a subtotal per language.

    The subtotals are rolled up from the small table of pairs, not from the rows.
    """
    pairs = tr.groupBy("language", "benchmark").agg(F.count("*").alias("n"))
    return (pairs.rollup("language", "benchmark").agg(F.sum("n").alias("invocations"))
            .where(F.col("language").isNotNull()))


def apportion(mix: DataFrame, total: int = 416) -> DataFrame:
    """Share of ``total`` instances per language, by invocations."""
    per = mix.where(F.col("benchmark").isNull()).select("language", "invocations")
    return per.withColumn("instances", F.col("invocations") * total
                          / per.select(F.sum("invocations")).scalar())


def response_overhead(log: DataFrame) -> DataFrame:
    """Means over a response log: delay beyond plan, stretch, network and worker time."""
    actual = F.col("end_ms") - F.col("start_ms")
    planned = F.when(F.col("duration_ms") == 0, F.lit(0.1)).otherwise(F.col("duration_ms"))
    zero = F.lit(0.0)
    return log.agg(
        F.coalesce(F.avg(actual - F.col("duration_ms")), zero).alias("avg_longer"),
        F.coalesce(F.avg(actual / planned), zero).alias("avg_increase"),
        F.coalesce(F.avg(F.col("received_ms") - F.col("start_ms")), zero).alias("avg_send"),
        F.coalesce(F.avg(F.col("responded_ms") - F.col("received_ms")), zero).alias("avg_worker"),
        F.coalesce(F.avg("duration_ms"), zero).alias("avg_planned"),
        F.coalesce(F.avg(F.col("end_ms") - F.col("responded_ms")), zero).alias("avg_receive"),
        F.count("*").alias("responses"))


def load_report(df: DataFrame, name: str, **skipped: Column):
    """Attach row counts to a stage; read them from the returned observation after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    counts = [F.count_if(c).alias(n) for n, c in skipped.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def step_report(steps: dict[str, DataFrame]) -> DataFrame:
    """Rows left after each named step, in step order."""
    out = None
    for pos, (name, df) in enumerate(steps.items()):
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(pos).cast("bigint").alias("pos"), F.lit(name).alias("step"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
