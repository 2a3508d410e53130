"""From aggregated or nested datasets to one row per invocation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash32, round_java, zip_shortest
from ..functions.arrays import clean_numbers
from ..model import (MINUTES_PER_WEEK, MS_PER_MINUTE, SECONDS_PER_DAY)

# Longest array one row may expand to at once.
BLOCK = 4_096
SEQ_PER_MINUTE = 1 << 32


# --- filters ---------------------------------------------------------------

def filter_minutes(df: DataFrame, first: int, last: int, column: str = "minute") -> DataFrame:
    """Keep the inclusive minute range of a per-minute table."""
    return df.where(F.col(column).between(first, last))


def filter_minute_window(df: DataFrame, first: int, last: int, column: str = "ts_ms") -> DataFrame:
    """Keep timestamps from the start of minute ``first`` to the end of ``last``."""
    return df.where(F.col(column).between(first * MS_PER_MINUTE, (last + 1) * MS_PER_MINUTE - 1))


def drop_empty_minutes(df: DataFrame, column: str = "count") -> DataFrame:
    """Drop blank and non-positive counts; fractions are cut off first."""
    return (df.withColumn(column, F.col(column).cast("double").cast("bigint"))
            .where(F.col(column) > 0))


def drop_incomplete(df: DataFrame, columns: Sequence[str], positive: bool = False) -> DataFrame:
    """Drop rows with a missing value, or with one that is not positive."""
    for c in columns:
        df = df.where(F.col(c) > 0 if positive else F.col(c).isNotNull())
    return df


def drop_malformed(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Keep the rows for which no reason to skip holds."""
    for bad in reasons.values():
        df = df.where(~F.coalesce(bad, F.lit(True)))
    return df


def count_malformed(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows each reason skips (the first that holds), and how many stay."""
    first = F.lit("kept")
    for name, bad in reversed(list(reasons.items())):
        first = F.when(F.coalesce(bad, F.lit(True)), F.lit(name)).otherwise(first)
    tagged = df.select(first.alias("_reason"))
    return tagged.agg(*[F.count_if(F.col("_reason") == n).alias(n) for n in [*reasons, "kept"]])


# --- time ------------------------------------------------------------------

def minute_start_ms(minute: Column, first_minute: int = 1) -> Column:
    """Start of a minute counted from ``first_minute``."""
    return (minute.cast("bigint") - F.lit(first_minute)) * F.lit(MS_PER_MINUTE)


def offset_days(day: Column) -> Column:
    """Second at which a day starts."""
    return day.cast("bigint") * F.lit(SECONDS_PER_DAY)


def offset_weeks(ts_ms: Column, week: Column, start_week: int) -> Column:
    """Place week-relative times on one time line."""
    return ts_ms + (week.cast("bigint") - F.lit(start_week)) * F.lit(MINUTES_PER_WEEK * MS_PER_MINUTE)


def rebase_time(df: DataFrame, column: str = "ts_ms") -> DataFrame:
    """Shift times so that the earliest is 0."""
    return df.withColumn(column, F.col(column) - df.select(F.min(column)).scalar())


def jitter_in_minute(function: Column, minute: Column, i: Column, seed: int) -> Column:
    """Offset in [0, 60000) for the i-th invocation of a function in a minute."""
    return hash32(function, minute, i, seed) % F.lit(MS_PER_MINUTE)


# --- expansion -------------------------------------------------------------

def unfold(df: DataFrame, count: str, name: str = "i") -> DataFrame:
    """One row per 1..count, block by block: a very large count never becomes one array."""
    n = F.col(count)
    blocks = df.withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(BLOCK)))))
    return blocks.withColumn(name, F.explode(F.sequence(
        F.col("_block") * BLOCK + 1, F.least(n, (F.col("_block") + 1) * BLOCK)))).drop("_block")


def synth_ids(df: DataFrame, column: str = "pos") -> DataFrame:
    """Owner and function names for sources that only number their functions."""
    return (df.withColumn("owner", F.concat(F.lit("owner_"), F.col(column)))
            .withColumn("function", F.concat(F.lit("f_"), F.col(column))))


def sum_repeats(df: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """Add up repeated rows of one key, so that (function, minute) is unique."""
    others = [c for c in df.columns if c not in keys and c != count]
    return df.groupBy(*keys).agg(F.sum(count).alias(count), *[F.first(c).alias(c) for c in others])


def expand_counts(df: DataFrame, seed: int = 0, count: str = "count",
                  start: Column | None = None, first_minute: int = 1) -> DataFrame:
    """One row per counted invocation with its time drawn within the minute.

    ``(function, minute)`` must be unique (``sum_repeats``).
    """
    begin = minute_start_ms(F.col("minute"), first_minute) if start is None else start
    return (unfold(df, count)
            .withColumn("ts_ms", begin + jitter_in_minute(F.col("function"), F.col("minute"),
                                                          F.col("i"), seed))
            .withColumn("seq", F.col("minute").cast("bigint") * F.lit(SEQ_PER_MINUTE) + F.col("i")))


# --- joins that belong to loading -------------------------------------------

def attach_profile(counts: DataFrame, durations: DataFrame, memory: DataFrame) -> DataFrame:
    """Add the average duration of the function and memory of the app.

    Functions without either are dropped.  Spark broadcasts a profile table
    only below its size threshold; larger ones shuffle, with skew splitting.
    """
    return counts.join(durations, "function").join(memory, "app")


def count_unprofiled(counts: DataFrame, durations: DataFrame, memory: DataFrame) -> DataFrame:
    """How many functions ``attach_profile`` drops."""
    functions = counts.select("owner", "app", "function").distinct()
    have = (functions.join(durations.select("function"), "function", "left_semi")
            .join(memory.select("app"), "app", "left_semi"))
    return (functions.agg(F.count("*").alias("functions"))
            .withColumn("skipped", F.col("functions") - have.select(F.count("*")).scalar()))


def align_matrices(counts: DataFrame, delays: DataFrame, memory: DataFrame) -> DataFrame:
    """Join the three per-minute matrices on (time, function position)."""
    keys = ["time_s", "pos"]
    return (counts.select(*keys, F.col("value").alias("count"))
            .join(delays.select(*keys, F.col("value").alias("delay_ms")), keys)
            .join(memory.select(*keys, F.col("value").alias("memory")), keys))


def matrix_invocations(aligned: DataFrame, seed: int = 0) -> DataFrame:
    """Expand aligned matrices: truncated counts, rounded delay and memory."""
    kept = drop_incomplete(drop_empty_minutes(aligned), ["delay_ms", "memory"])
    named = synth_ids(kept).select(
        "owner", "function",
        round_java(F.col("memory").cast("double")).cast("int").alias("memory_mb"),
        round_java(F.col("delay_ms").cast("double")).alias("duration_ms"),
        (F.col("time_s") * 1000).alias("_start"),
        F.floor(F.col("time_s") / 60).alias("minute"), "count")
    return expand_counts(named, seed, start=F.col("_start")).drop("_start")


def attach_app_memory(events: DataFrame, config: DataFrame) -> DataFrame:
    """Add configured memory; apps without configuration are dropped."""
    return events.join(config.select("namespace", "app", "memory_mb"), ["namespace", "app"])


def count_missing_memory(events: DataFrame, config: DataFrame) -> DataFrame:
    missing = events.join(config.select("namespace", "app"), ["namespace", "app"], "left_anti")
    return missing.agg(F.count("*").alias("skipped_missing_memory"))


def zip_event_arrays(events: DataFrame) -> DataFrame:
    """One row per (time, duration) pair of an app, to the shorter of both arrays."""
    pairs = zip_shortest(clean_numbers(F.col("times_s")), clean_numbers(F.col("exec_ms")))
    rest = [c for c in events.columns if c not in ("times_s", "exec_ms")]
    return (events.select(*rest, F.posexplode(pairs).alias("pos", "_pair"))
            .select(*rest, "pos", F.col("_pair.left").alias("time_s"),
                    F.col("_pair.right").alias("duration")))


def count_empty_pairs(events: DataFrame) -> DataFrame:
    n = F.least(F.size(clean_numbers(F.col("times_s"))), F.size(clean_numbers(F.col("exec_ms"))))
    return events.agg(F.count_if(F.coalesce(n, F.lit(0)) <= 0).alias("skipped_records"),
                      F.count("*").alias("records"))


def concat_periods(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Append the rows of further days or weeks."""
    for df in more:
        first = first.unionByName(df)
    return first


def keep_selected(df: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Keep the rows whose key was chosen."""
    return df.join(selected.select(key), key, "left_semi")


def sort_trace(tr: DataFrame) -> DataFrame:
    """Total order by time; ties by owner, function and ``seq``."""
    return tr.orderBy("ts_ms", "owner", "function", "seq")
