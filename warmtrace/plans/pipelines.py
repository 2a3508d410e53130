"""The three life cycles: generating a trace, enriching it, and analysing its replay."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEEPALIVE_MS, MS_PER_MINUTE, MINUTES_PER_DAY, MINUTES_PER_WEEK, as_trace
from ..operators.aggregate import dense_ids, load_report, replace_ids
from ..operators.downscale import downscale
from ..operators.expand import (align_matrices, attach_app_memory, attach_profile,
                                drop_empty_minutes, drop_incomplete, expand_counts,
                                filter_minute_window, matrix_invocations, sum_repeats,
                                zip_event_arrays)
from ..operators.gauges import gauges
from ..operators.language import assign_language, nearest_benchmark
from ..operators.stages import materialise
from ..operators.starts import classify_optimised, classify_starts
from ..functions import convert_units, round_py
from ..sources import readers
from ..sources.base import Source


def counts_to_trace(counts: DataFrame, durations: DataFrame, memory: DataFrame,
                    seed: int = 0) -> DataFrame:
    """Per-minute counts and their profiles as a trace."""
    keys = ["owner", "app", "function", "minute"]
    summed = sum_repeats(drop_empty_minutes(counts).drop("row_pos"), keys)
    return as_trace(expand_counts(attach_profile(summed, durations, memory), seed))


def matrices_to_trace(counts: DataFrame, delays: DataFrame, memory: DataFrame,
                      seed: int = 0) -> DataFrame:
    return as_trace(matrix_invocations(align_matrices(counts, delays, memory), seed))


def event_arrays_to_rows(events: DataFrame, config: DataFrame) -> DataFrame:
    """Nested events as flat rows: memory in MB, whole milliseconds, halves to even."""
    pairs = zip_event_arrays(attach_app_memory(events, config))
    return (pairs.withColumn("duration_ms", round_py(F.col("duration")))
            .withColumn("ts_ms", round_py(convert_units(F.col("time_s"), "s_to_ms")))
            .drop("duration", "time_s"))


def event_rows_to_trace(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Flat events within a minute range, rows without memory or duration dropped."""
    inside = filter_minute_window(rows, first, last)
    return as_trace(drop_incomplete(inside, ["memory_mb", "duration_ms"], positive=True))


def _check_range(first: int, last: int, low: int, high: int) -> None:
    if first < low or last > high or first > last:
        raise ValueError(f"invalid minute range [{first},{last}], expected within [{low},{high}]")


@dataclass
class MinuteCounts:
    """One day of wide per-function minute counts with duration and memory tables."""

    counts: str
    durations: str
    memory: str

    def load(self, spark: SparkSession, first: int = 701, last: int = 710, seed: int = 0) -> DataFrame:
        _check_range(first, last, 1, MINUTES_PER_DAY)
        return counts_to_trace(readers.read_minute_counts(spark, self.counts, first, last),
                               readers.read_function_durations(spark, self.durations),
                               readers.read_app_memory(spark, self.memory), seed)

    def names(self, spark: SparkSession) -> DataFrame:
        """The owner and function of every profiled line in file order, with or without invocations."""
        return attach_profile(readers.read_minute_names(spark, self.counts),
                              readers.read_function_durations(spark, self.durations),
                              readers.read_app_memory(spark, self.memory)).select("owner", "function", "seq")


@dataclass
class MinuteMatrices:
    """Folders of ``day_NNN.csv`` matrices for requests, delay and memory."""

    requests: str
    delay: str
    memory: str

    def load(self, spark: SparkSession, first_day: int, last_day: int | None = None, first: int = 0,
             last: int = MINUTES_PER_DAY - 1, seed: int = 0) -> DataFrame:
        _check_range(first, last, 0, MINUTES_PER_DAY - 1)
        days = range(first_day, (first_day if last_day is None else last_day) + 1)
        paths = [[f"{folder}/day_{d:03d}.csv" for d in days]
                 for folder in (self.requests, self.delay, self.memory)]
        readers.check_header_widths(*[readers.text_lines(spark, p) for p in paths])
        return matrices_to_trace(*[readers.read_minute_matrix(spark, p, first, last) for p in paths],
                                 seed=seed)


@dataclass
class WeeklyEvents:
    """Folder of flat event files ``week_N.csv``."""

    folder: str

    def load(self, spark: SparkSession, first_week: int = 1, last_week: int | None = None,
             first: int = 0, last: int = 9) -> DataFrame:
        _check_range(first, last, 0, MINUTES_PER_WEEK - 1)
        weeks = range(first_week, (first_week if last_week is None else last_week) + 1)
        traces = []
        for week in weeks:
            rows = readers.read_event_rows(spark, f"{self.folder}/week_{week}.csv")
            part = event_rows_to_trace(rows, first, last)
            shift = (week - first_week) * MINUTES_PER_WEEK * 60_000
            # Row positions start anew in each file; keep them apart by week.
            traces.append(part.withColumn("ts_ms", F.col("ts_ms") + F.lit(shift))
                          .withColumn("seq", F.col("seq") * len(weeks) + (week - first_week)))
        out = traces[0]
        for more in traces[1:]:
            out = out.unionByName(more)
        return out


def generate(spark: SparkSession, source: Source, limits: dict | None = None, compress: bool = False,
             **options) -> DataFrame | tuple[DataFrame, DataFrame, DataFrame]:
    """Load a source and downscale it; with ``compress`` ids are dense and both mappings returned.

    Ids number what the source names, in the order of its file, where it has ``names``; else the rows of the trace.
    """
    tr = source.load(spark, **options)
    limits = dict(limits or {})
    if limits.get("users") and limits.pop("rank_on_range", False):
        limits["rank_users_on"] = tr
    out = downscale(tr, **limits)
    if not compress:
        return out
    named = source.names(spark) if hasattr(source, "names") else tr
    owners, functions = dense_ids(named, "owner"), dense_ids(named, "function")
    return replace_ids(replace_ids(out, owners, "owner"), functions, "function"), owners, functions


def generate_reported(rows: DataFrame, first: int, last: int, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """A downscaled trace of flat events, and its report ``pos, step, rows``.

    Every row that is read counts once: as loaded, or under the first reason to skip it, a null being a reason too.  The
    counts come with the passes that write the loaded and the generated trace; nothing is scanned to count.
    """
    inside = F.col("ts_ms").between(first * MS_PER_MINUTE, (last + 1) * MS_PER_MINUTE - 1)
    skipped, before = {}, F.lit(True)
    for name, fine in {"outside_range": inside, "no_memory": F.col("memory_mb") > 0, "no_duration": F.col("duration_ms") > 0}.items():
        fine = F.coalesce(fine, F.lit(False))
        skipped[name], before = before & ~fine, before & fine
    read, seen = load_report(rows, f"read-{uuid.uuid4().hex}", **skipped, loaded=before)
    loaded = materialise(event_rows_to_trace(read, first, last))
    left, kept = load_report(downscale(loaded, **(limits or {})), f"generated-{uuid.uuid4().hex}")
    out = materialise(left)
    counts = {"read": seen.get["rows"], **{n: seen.get[n] for n in [*skipped, "loaded"]}, "generated": kept.get["rows"]}
    report = rows.sparkSession.createDataFrame([(i, n, c) for i, (n, c) in enumerate(counts.items())], "pos bigint, step string, rows bigint")
    return out, report


def languages(tr: DataFrame, seed: int = 0) -> DataFrame:
    """Language and benchmark of every function."""
    return nearest_benchmark(assign_language(tr, seed=seed), seed=seed)


def analyse(tr: DataFrame, keepalive_ms: int = KEEPALIVE_MS, optimise: bool = False,
            classify: Callable[..., DataFrame] | None = None, **options) -> DataFrame:
    """Gauges of a replayed trace; ``classify`` replaces the start policy."""
    step = classify or (classify_optimised if optimise else classify_starts)
    return gauges(step(tr, keepalive_ms, **options), keepalive_ms)
