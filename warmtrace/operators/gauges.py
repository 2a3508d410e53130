"""Gauges over time: what runs and what is cached at each sample instant.

An invocation runs on [start, end); its container then idles on [end, min(reused,
end + keep-alive)).  Every gauge is a sum of steps at the ends of such intervals,
so nothing is rescanned per sample: steps are added up per instant, accumulated
over time chunks, and read off at the sample instants.  Gauges that count
distinct keys or VMs first turn each key's level into steps of the gauge.

There is one sample per grid second with an arrival, taken at its last arrival, unless ``samples`` names the
instants (``samples.sample_times``).  Those must be arrivals; counts are then since the sample before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ceil_div
from ..model import (KEEPALIVE_MS, SAMPLE_MS, VM_MB, WORKER_MB, WORKERS,
                     arrival_order, end_ms)
from .running import CHUNK_ROWS, WIDTH, chunk_of, running, time_chunk, with_widths
from .stages import materialise

GAUGES = ["ts_ms", "invocations", "cold", "running_users", "running_functions",
          "running_invocations", "running_mb", "cached_users", "cached_functions", "cached_mb"]
OPTIMISED_GAUGES = ["optimised_cold", "running_optimised_functions"]


def level_steps(moves: DataFrame, keys: list[str], names: list[str],
                value: Callable[[Column], Column], chunk_rows: int) -> DataFrame:
    """Steps of ``value(level)`` where each key's levels are the running sums of its moves.

    ``moves`` has ``keys``, ``time`` and one column of moves per name; the result
    has the steps in those columns.  Moves at one instant may come in any order:
    their steps add up to the same.
    """
    cut = with_widths(moves, keys, "time", chunk_rows)
    levels = running(cut, keys=keys, chunk=chunk_of(cut, "time"), order=["time"],
                     sums={f"_{n}": F.col(n) for n in names})
    steps = levels.select(*keys, "time", *[
        (value(F.col(f"_{n}")) - value(F.col(f"_{n}") - F.col(n))).alias(n) for n in names])
    changed = F.lit(False)
    for n in names:
        changed = changed | (F.col(n) != 0)
    return steps.where(changed)


def is_active(level: Column) -> Column:
    return (level > 0).cast("bigint")


def _at_samples(steps: DataFrame, sums: list[str], counts: list[str], grid_ms: int,
                chunk_rows: int, samples: DataFrame | None = None) -> DataFrame:
    """Accumulate steps per instant and read them at the last arrival of each grid bucket, or at ``samples``.

    ``sums`` are levels; ``counts`` are totals of the bucket.  ``steps`` has one
    row per change with ``time``, those columns and ``arrivals``.
    """
    at = steps.groupBy("time").agg(*[F.sum(c).alias(c) for c in [*sums, *counts, "arrivals"]])
    # At most one row per millisecond is left, and it is read twice.
    at = materialise(at)
    if samples is not None:
        return _at_instants(at, sums, counts, samples, chunk_rows)
    cut = with_widths(at.withColumn("_bucket", time_chunk("time", grid_ms)), [], "time",
                      chunk_rows, multiple_of=grid_ms)
    levels = running(cut, keys=[], chunk=chunk_of(cut, "time"), order=["time"],
                     sums={f"_{c}": F.col(c) for c in sums}, keep_chunk="_part")
    bucket = Window.partitionBy("_part", "_bucket")
    last = F.max(F.when(F.col("arrivals") > 0, F.col("time"))).over(bucket)
    return (levels.select("time", last.alias("_last"), *[F.col(f"_{c}").alias(c) for c in sums],
                          *[F.sum(c).over(bucket).alias(c) for c in counts])
            .where("time = _last")
            .select(F.col("time").alias("ts_ms"), *sums, *counts))


def _at_instants(at: DataFrame, sums: list[str], counts: list[str], samples: DataFrame, chunk_rows: int) -> DataFrame:
    """Read levels at given instants; what is counted there is what came since the instant before."""
    cut = with_widths(at, [], "time", chunk_rows)
    levels = running(cut, keys=[], chunk=chunk_of(cut, "time"), order=["time"],
                     sums={f"_{c}": F.col(c) for c in [*sums, *counts]})
    there = levels.join(samples.select(F.col("ts_ms").alias("time")), "time", "left_semi")
    there = materialise(there.select("time", *[F.col(f"_{c}").alias(c) for c in [*sums, *counts]]))
    if counts:
        cut = with_widths(there, [], "time", chunk_rows)
        there = running(cut, keys=[], chunk=chunk_of(cut, "time"), order=["time"],
                        maxes={f"_{c}": F.col(c) for c in counts}, exclusive=True)
    return there.select(F.col("time").alias("ts_ms"), *sums,
                        *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in counts])


def sample_counts(starts: DataFrame, grid_ms: int = SAMPLE_MS) -> DataFrame:
    """Invocations and cold starts since the previous sample."""
    return (starts.groupBy(time_chunk("ts_ms", grid_ms).alias("_bucket"))
            .agg(F.max("ts_ms").alias("ts_ms"), F.count("*").alias("invocations"),
                 F.count_if("cold").alias("cold")).drop("_bucket"))


def per_sample_delta(samples: DataFrame, total: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Difference of a cumulative column from one sample to the next (from 0 at the first)."""
    cut = with_widths(samples, [], chunk_rows=chunk_rows)
    before = running(cut, keys=[], chunk=chunk_of(cut, "ts_ms"), order=["ts_ms"], maxes={"_before": F.col(total)}, exclusive=True)
    return (before.withColumn(name, F.col(total) - F.coalesce("_before", F.lit(0)))
            .drop("_before", WIDTH))


def running_gauges(tr: DataFrame, grid_ms: int = SAMPLE_MS, chunk_rows: int = CHUNK_ROWS,
                   samples: DataFrame | None = None) -> DataFrame:
    """Running invocations and memory at each sample."""
    changes = tr.select(F.explode(F.array(
        F.struct(F.col("ts_ms").alias("time"), F.lit(1).alias("n"),
                 F.col("memory_mb").cast("bigint").alias("mb"), F.lit(1).alias("arrivals")),
        F.struct(end_ms().alias("time"), F.lit(-1).alias("n"),
                 (-F.col("memory_mb")).cast("bigint").alias("mb"), F.lit(0).alias("arrivals"))))
        .alias("_c")).select("_c.*")
    out = _at_samples(changes, ["n", "mb"], [], grid_ms, chunk_rows, samples)
    return out.select("ts_ms", F.col("n").alias("running_invocations"), F.col("mb").alias("running_mb"))


def _arrival_marks(tr: DataFrame) -> DataFrame:
    return tr.select(F.col("ts_ms").alias("time"), F.lit(1).alias("arrivals"))


def running_distinct(tr: DataFrame, grid_ms: int = SAMPLE_MS, chunk_rows: int = CHUNK_ROWS,
                     samples: DataFrame | None = None) -> DataFrame:
    """Distinct users and functions running at each sample."""
    wide = _active_steps(tr, {"running": end_ms()}, chunk_rows)
    marked = wide.unionByName(_arrival_marks(tr), allowMissingColumns=True)
    return _at_samples(marked.fillna(0), ["running_users", "running_functions"], [], grid_ms, chunk_rows, samples)


def _key_moves(rows: DataFrame, changes: list, names: list[str]) -> DataFrame:
    """One row per change of a row's owner (``users``) and of its function (``functions``)."""
    moves = []
    for kind, key in (("users", "owner"), ("functions", "function")):
        for time, by in changes:
            time = F.col(time) if isinstance(time, str) else time
            moves.append(F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), time.alias("time"),
                                  *[_as_move(by.get(n, 0)).alias(n) for n in names]))
    return rows.select(F.explode(F.array(*moves)).alias("_m")).select("_m.*")


def _as_move(by) -> Column:
    return by.cast("int") if isinstance(by, Column) else F.lit(by)


def _of_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of these keys, or of all others; sent to every task, as a key's rows would meet in one."""
    named = F.broadcast(keys.select(F.col("kind").alias("_kind"), F.col("key").alias("_key")))
    return rows.join(named, (F.col("kind") == F.col("_kind")) & F.col("key").eqNullSafe(F.col("_key")), how)


def _span_steps(spans: DataFrame, names: list[str], chunk_rows: int) -> DataFrame:
    """Steps of 1 at the first and the last instant of each key's stretches without a gap, one column per name.

    A row lasts from ``time`` to its end in the column of that name, null for none.  A stretch begins at a row behind all
    ends so far, which closes the one before.
    """
    keys = ["kind", "key"]
    cut = with_widths(spans, keys, "time", chunk_rows)
    past = running(cut, keys=keys, chunk=chunk_of(cut, "time"), order=["time"],
                   maxes={f"_{n}": F.col(n) for n in names}, exclusive=True)

    def step(name, time, by):
        return F.struct(time.alias("time"), *[F.lit(by if n == name else 0).alias(n) for n in names])

    steps = []
    for n in names:
        begins = F.col(n).isNotNull() & (F.col(f"_{n}").isNull() | (F.col("time") > F.col(f"_{n}")))
        steps += [F.when(begins, step(n, F.col("time"), 1)), F.when(begins & F.col(f"_{n}").isNotNull(), step(n, F.col(f"_{n}"), -1))]
    last = spans.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names])
    closing = [F.when(F.col(n).isNotNull(), step(n, F.col(n), -1)) for n in names]
    return (past.select("kind", F.explode(F.array_compact(F.array(*steps))).alias("_s"))
            .unionByName(last.select("kind", F.explode(F.array_compact(F.array(*closing))).alias("_s")))
            .select("kind", "_s.*"))


def _active_steps(rows: DataFrame, ends: dict[str, Column], chunk_rows: int, where: dict[str, Column] | None = None) -> DataFrame:
    """Steps of the number of active users and functions, one column each per name.

    A key is active from the start of each of its rows, ``where`` that holds, to the row's end of that name.  A key with a
    row that has no end, or one before its start, has no such stretches: its moves are added up one by one.
    """
    where, names = where or {}, list(ends)
    regular = F.lit(True)
    for end in ends.values():
        regular = regular & F.coalesce(end >= F.col("ts_ms"), F.lit(False))
    kinds = {"users": "owner", "functions": "function"}

    def by_kind(of, *columns):
        return of.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), *columns)
                                             for kind, key in kinds.items()])).alias("_k")).select("_k.*")

    odd = materialise(by_kind(rows.where(~regular)).distinct())
    spans = by_kind(rows, F.col("ts_ms").alias("time"), *[F.when(where.get(n, F.lit(True)), end).alias(n) for n, end in ends.items()])
    if odd.isEmpty():
        steps = _span_steps(spans, names, chunk_rows)
    else:
        by = {n: where[n].cast("int") if n in where else F.lit(1) for n in names}
        moves = _key_moves(rows, [("ts_ms", by), *[(end, {n: -by[n]}) for n, end in ends.items()]], names)
        levels = level_steps(_of_keys(moves, odd, "left_semi"), ["kind", "key"], names, is_active, chunk_rows)
        steps = (_span_steps(_of_keys(spans, odd, "left_anti"), names, chunk_rows)
                 .unionByName(levels.select("kind", "time", *names)))
    return steps.select("time", *[F.when(F.col("kind") == kind, F.col(n)).otherwise(0).alias(f"{n}_{kind}")
                                  for n in names for kind in kinds])


def gauges(starts: DataFrame, keepalive_ms: int = KEEPALIVE_MS, grid_ms: int = SAMPLE_MS,
           chunk_rows: int = CHUNK_ROWS, samples: DataFrame | None = None) -> DataFrame:
    """All gauges from classified starts; with optimised gauges when the starts have them."""
    starts = materialise(starts)
    optimised = "optimised" in starts.columns
    freed = F.least(F.coalesce("reused_at", end_ms() + F.lit(keepalive_ms)),
                    end_ms() + F.lit(keepalive_ms))
    ends, where = {"running": end_ms(), "held": freed}, {}
    if optimised:
        ends["running_optimised"], where["running_optimised"] = end_ms(), F.col("optimised")
    by_key = _active_steps(starts, ends, chunk_rows, where)
    names = ["running_users", "running_functions", "held_users", "held_functions"]
    if optimised:
        names.append("running_optimised_functions")
        by_key = by_key.drop("running_optimised_users")

    mb = F.col("memory_mb").cast("bigint")
    flags = {"cold": F.col("cold").cast("int")}
    if optimised:
        flags["optimised_cold"] = (F.col("cold") & F.col("optimised")).cast("int")

    def change(time, n, running_mb, cached_mb, arrival):
        return F.struct(
            time.alias("time"), F.lit(n).alias("running_invocations"),
            running_mb.alias("running_mb"), cached_mb.alias("cached_mb"),
            F.lit(int(arrival)).alias("arrivals"), F.lit(int(arrival)).alias("invocations"),
            *[(c if arrival else F.lit(0)).alias(name) for name, c in flags.items()])

    none = F.lit(0).cast("bigint")
    per_row = starts.select(F.explode(F.array(
        change(F.col("ts_ms"), 1, mb, none, True),
        change(end_ms(), -1, -mb, mb, False),
        change(freed, 0, none, -mb, False))).alias("_c")).select("_c.*")
    # Add up per instant before the rarer key steps join in.
    sums = ["running_invocations", "running_mb", "cached_mb"]
    counts = ["invocations", *flags]
    both = per_row.unionByName(by_key, allowMissingColumns=True)
    at = _at_samples(both.fillna(0), [*sums, *names], counts, grid_ms, chunk_rows, samples)
    out = (at.withColumn("cached_users", F.col("held_users") - F.col("running_users"))
           .withColumn("cached_functions", F.col("held_functions") - F.col("running_functions")))
    return out.select(*GAUGES, *(OPTIMISED_GAUGES if optimised else []))


@dataclass(frozen=True)
class IsolationRule:
    """Which invocations share VMs: those with equal ``keys``, columns of the trace.

    ``vms`` makes a number of VMs of a group's running memory in MB, 0 of 0; without it they are whole VMs of ``vm_mb``.
    """

    keys: tuple[str, ...]
    vms: Callable[[Column], Column] | None = None


RULES = {"function": IsolationRule(("function",)), "owner": IsolationRule(("owner",))}


def _vm_moves(tr: DataFrame, keys: list[str]) -> DataFrame:
    """Moves of the level each VM count is taken from, each function at its first-seen size."""
    sized_by = list(dict.fromkeys([*keys, "function"]))
    first = tr.groupBy(*sized_by).agg(F.min_by("memory_mb", arrival_order()).cast("bigint").alias("_mb"))
    sized = tr.select(*sized_by, "ts_ms", "duration_ms").join(first, sized_by)
    return sized.select(*keys, F.explode(F.array(
        F.struct(F.col("ts_ms").alias("time"), F.col("_mb").alias("vms")),
        F.struct(end_ms().alias("time"), (-F.col("_mb")).alias("vms")))).alias("_m")).select(*keys, "_m.*")


def vm_footprint(tr: DataFrame, rule: str | IsolationRule = "owner", vm_mb: int = VM_MB,
                 grid_ms: int = SAMPLE_MS, chunk_rows: int = CHUNK_ROWS, samples: DataFrame | None = None) -> DataFrame:
    """Memory taken by VMs at each sample under an isolation rule.

    ``invocation``: the plain sum.  ``function``, ``owner`` or a rule of one's own: the group's
    running memory, each function at its first-seen size in the group, in VMs.
    """
    if rule == "invocation":
        plain = running_gauges(tr, grid_ms, chunk_rows, samples)
        return plain.select("ts_ms", F.floor(F.col("running_mb") / vm_mb).alias("vms"),
                            F.col("running_mb").alias("footprint_mb"))
    rule = RULES[rule] if isinstance(rule, str) else rule
    vms = rule.vms or (lambda mb: ceil_div(mb, vm_mb))
    steps = level_steps(_vm_moves(tr, list(rule.keys)), list(rule.keys), ["vms"], vms, chunk_rows)
    marked = steps.select("time", "vms").unionByName(
        _arrival_marks(tr), allowMissingColumns=True).fillna(0)
    at = _at_samples(marked, ["vms"], [], grid_ms, chunk_rows, samples)
    return at.select("ts_ms", "vms", (F.col("vms") * vm_mb).alias("footprint_mb"))


def capacity_check(footprint: DataFrame, workers: int = WORKERS, mb: int = WORKER_MB) -> DataFrame:
    """Samples whose demand exceeds what the workers hold, with the shortfall as ``headroom_mb``."""
    return (footprint.withColumn("headroom_mb", F.lit(workers * mb) - F.col("footprint_mb"))
            .where("headroom_mb < 0"))


def worker_summary(log: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per worker: distinct functions and owners, requests and peak running memory.

    ``log`` is a trace with a ``worker`` column.
    """
    pairs = log.groupBy("worker", "owner", "function").agg(F.count("*").alias("n"))
    seen = pairs.groupBy("worker").agg(F.count("*").alias("functions"),
                                       F.sum("n").alias("requests"))
    owners = (pairs.select("worker", "owner").distinct().groupBy("worker")
              .agg(F.count("*").alias("owners")))
    mb = F.col("memory_mb").cast("bigint")
    moves = log.select("worker", F.explode(F.array(
        F.struct(F.col("ts_ms").alias("time"), mb.alias("move")),
        F.struct(end_ms().alias("time"), (-mb).alias("move")))).alias("_m")).select("worker", "_m.*")
    at = moves.groupBy("worker", "time").agg(F.sum("move").alias("move"))
    cut = with_widths(at, ["worker"], "time", chunk_rows)
    peak = (running(cut, keys=["worker"], chunk=chunk_of(cut, "time"), order=["time"], sums={"level": F.col("move")})
            .groupBy("worker").agg(F.max("level").alias("peak_mb")))
    return seen.join(owners, "worker").join(peak, "worker")
