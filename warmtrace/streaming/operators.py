"""The trace operators on Structured Streaming.

Event time is the millisecond time of a row.  Rows may come in any order up to
the watermark delay; the stateful operators hold a function's rows until the
watermark has passed them, so they see each function in time order and agree
with the batch operators on the same rows.  Spark drops later rows; ``mark_late``
tells them apart before that, so that they can be kept and counted.  An input
that ends is run by ``run_to_end``, which also gives what the watermark alone
would leave held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..model import (HOT_COLD_STARTS, HOT_PERIOD_MS, KEEPALIVE_MS, SAMPLE_MS, end_ms)
from ..sources.readers import parse_trace

DELAY = "10 seconds"
TRACE_STREAM_SCHEMA = "value string"
# Rows at this time or later (the year 9999) only say that the input has ended.
CLOSING_MS = 253_370_764_800_000
LATE_GROUPS = 256


def _numbered(batches):
    """Arrow step: number the lines of each block of a file; a task reads a block from its start to its end."""
    import numpy as np
    import pyarrow as pa

    block, at = None, 0
    for batch in batches:
        paths, starts = batch.column("path").to_pylist(), batch.column("start").to_pylist()
        number = np.empty(batch.num_rows, np.int64)
        for i, key in enumerate(zip(paths, starts)):
            block, at = key, at + 1 if key == block else 0
            number[i] = at
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], [*batch.schema.names, "line"])


def stream_load(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A growing folder of trace files; ``seq`` is a hash of the file, its block and the line's number in it.

    Equal lines are rows of their own, and a batch that is run again numbers its lines alike.
    """
    lines = (spark.readStream.schema(TRACE_STREAM_SCHEMA)
             .option("maxFilesPerTrigger", files_per_trigger).text(folder))
    placed = lines.select("value", F.col("_metadata.file_path").alias("path"),
                          F.col("_metadata.file_block_start").alias("start"))
    numbered = placed.mapInArrow(_numbered, "value string, path string, start bigint, line bigint")
    keyed = numbered.select("value", F.xxhash64("path", "start", "line").alias("row_pos"))
    return parse_trace(keyed).drop("language", "benchmark")


def with_event_time(tr: DataFrame, delay: str = DELAY) -> DataFrame:
    """Event time and its watermark; closing rows move the watermark and go no further."""
    timed = (tr.withColumn("event_time", F.timestamp_millis("ts_ms"))
             .withWatermark("event_time", delay))
    # A filter on the event time itself stays behind the watermark.
    return timed.where(F.col("event_time") < F.timestamp_millis(F.lit(CLOSING_MS)))


def advance(tr: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Run ``step`` over what is new in a stream; its rows go to a table under ``folder``, and it waits there for more."""
    spark = tr.sparkSession
    closing = f"{folder}/closing"
    spark.createDataFrame([], tr.schema).write.mode("ignore").parquet(closing)
    out = step(tr.unionByName(spark.readStream.schema(tr.schema).parquet(closing)))
    _run(out, folder)
    return out


def run_to_end(tr: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """All rows of ``step`` over a stream whose input is complete, as a table under ``folder``.

    The stream runs over what is there.  Then a closing row comes in and the same query, from its own
    checkpoint, gives what it still held.  A run that was broken off goes on where it was when called again.
    """
    spark = tr.sparkSession
    out = advance(tr, step, folder)
    values = [F.lit(CLOSING_MS if f.name == "ts_ms" else None).cast(f.dataType).alias(f.name) for f in tr.schema.fields]
    spark.range(1).select(*values).write.mode("append").parquet(f"{folder}/closing")
    _run(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def _run(out: DataFrame, folder: str, by: str | None = None) -> None:
    writer = (out.writeStream.format("parquet").option("path", f"{folder}/rows")
              .option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True))
    (writer.partitionBy(by) if by else writer).start().awaitTermination()


def _with_late(tr: DataFrame) -> StructType:
    return StructType([*tr.schema.fields, StructField("late", BooleanType())])


def mark_late(tr: DataFrame, delay: str = DELAY) -> DataFrame:
    """All rows, with ``late``: at or before the watermark when they came in.

    Nothing is held and no row is dropped, not even one without a time; rows are spread by a hash, so that
    a frequent function is no group of its own.
    """
    fields = tr.columns

    def step(key, frames, state):
        watermark = state.getCurrentWatermarkMs()
        for frame in frames:
            yield frame[fields].assign(late=frame["ts_ms"] <= watermark)

    timed = tr.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)
    spread = F.pmod(F.xxhash64(*fields), F.lit(LATE_GROUPS))
    # Without a timeout Spark leaves late rows in.
    return (timed.select("event_time", spread.alias("_spread"), *fields).groupBy("_spread")
            .applyInPandasWithState(step, _with_late(tr), "none int", "append", "NoTimeout")
            .withColumn("late", F.coalesce("late", F.lit(False))))


def split_late(tr: DataFrame, folder: str, delay: str = DELAY) -> tuple[DataFrame, DataFrame]:
    """Run ``mark_late`` over what is there: a stream of the rows on time, and a table of the late ones.

    Called again with the same folder, only what is new is read, against the watermark of all before.
    A stream that is advanced after each call, with the same delay, loses none of the rows on time.
    """
    spark, schema = tr.sparkSession, _with_late(tr)
    _run(mark_late(tr, delay), folder, "late")
    # Read through the sink's own log, so that files of lost tasks are left out.
    rows = f"{folder}/rows"
    return (spark.readStream.schema(schema).parquet(rows).where("not late").drop("late"),
            spark.read.schema(schema).parquet(rows).where("late").drop("late"))


def stream_sample_counts(tr: DataFrame, grid_ms: int = SAMPLE_MS, delay: str = DELAY) -> DataFrame:
    """Invocations per grid bucket, and cold starts where rows carry the flag."""
    counts = [F.max("ts_ms").alias("ts_ms"), F.count("*").alias("invocations")]
    if "cold" in tr.columns:
        counts.append(F.count_if("cold").alias("cold"))
    timed = with_event_time(tr, delay)
    return (timed.groupBy(F.window("event_time", f"{grid_ms} milliseconds"))
            .agg(*counts).drop("window"))


def active_sessions(timed: DataFrame, keepalive_ms: int = KEEPALIVE_MS) -> DataFrame:
    """Stretches in which a function runs or is cached; touching stretches join."""
    gap = F.concat((F.col("duration_ms") + F.lit(keepalive_ms)).cast("string"), F.lit(" milliseconds"))
    sessions = (timed.groupBy("function", F.session_window("event_time", gap))
                .agg(F.count("*").alias("invocations"), F.min("ts_ms").alias("first_ms"),
                     F.max(end_ms() + F.lit(keepalive_ms)).alias("until_ms")))
    return sessions.select("function", "first_ms", "until_ms", "invocations")


def stream_active_sessions(tr: DataFrame, keepalive_ms: int = KEEPALIVE_MS,
                           delay: str = DELAY) -> DataFrame:
    return active_sessions(with_event_time(tr, delay), keepalive_ms)


START_FIELDS = ["ts_ms", "seq", "owner", "memory_mb", "duration_ms"]


def stream_classify_starts(tr: DataFrame, keepalive_ms: int = KEEPALIVE_MS,
                           delay: str = DELAY) -> DataFrame:
    """Each arrival with ``cold``, ``previous`` (the row it took over) and ``container_id``."""
    fields, keepalive = list(START_FIELDS), keepalive_ms

    def step(key, frames, state):
        import heapq

        import pandas as pd

        held, pool = [], []
        if state.exists:
            saved = state.get
            held = list(zip(*saved[:5]))
            pool = list(zip(*saved[5:]))
        for frame in frames:
            held.extend(zip(*[frame[f].tolist() for f in fields]))
        watermark = state.getCurrentWatermarkMs()
        held.sort()
        ready = 0
        while ready < len(held) and held[ready][0] <= watermark:
            ready += 1
        out = []
        heapq.heapify(pool)
        for ts, seq, owner, memory, duration in held[:ready]:
            while pool and ts >= pool[0][0] + keepalive:
                heapq.heappop(pool)
            if pool and pool[0][0] <= ts:
                _, _, previous, container = heapq.heappop(pool)
            else:
                previous, container = None, seq
            heapq.heappush(pool, (ts + duration, ts, seq, container))
            out.append((key[0], ts, owner, seq, memory, duration, previous is None, previous, container))
        held = held[ready:]
        while pool and watermark >= pool[0][0] + keepalive:
            heapq.heappop(pool)
        if held or pool:
            state.update(tuple([list(c) for c in zip(*held)] or [[]] * 5)
                         + tuple([list(c) for c in zip(*pool)] or [[]] * 4))
            wake = min([held[0][0]] if held else [pool[0][0] + keepalive])
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        elif state.exists:
            state.remove()
        if not out:
            return
        columns = ["function", "ts_ms", "owner", "seq", "memory_mb", "duration_ms", "cold",
                   "previous", "container_id"]
        result = pd.DataFrame(out, columns=columns)
        result["previous"] = result["previous"].astype("Int64")
        yield result

    result = ("function string, ts_ms bigint, owner string, seq bigint, memory_mb int, "
              "duration_ms bigint, cold boolean, previous bigint, container_id bigint")
    saved = ("held_ts array<bigint>, held_seq array<bigint>, held_owner array<string>, "
             "held_mb array<int>, held_ms array<bigint>, pool_end array<bigint>, "
             "pool_ts array<bigint>, pool_seq array<bigint>, "
             "pool_container array<bigint>")
    timed = with_event_time(tr, delay)
    return (timed.select("event_time", "function", *fields).groupBy("function")
            .applyInPandasWithState(step, result, saved, "append", "EventTimeTimeout"))


def stream_hot_functions(cold: DataFrame, n: int = HOT_COLD_STARTS, period_ms: int = HOT_PERIOD_MS,
                         delay: str = DELAY) -> DataFrame:
    """Functions with their ``n + 1``-th cold start within ``period_ms``, told once."""
    size, period = n, period_ms

    def step(key, frames, state):
        import pandas as pd

        held, ring, hot = [], [], False
        if state.exists:
            held_ts, ring, hot = state.get
            held, ring = list(held_ts), list(ring)
        for frame in frames:
            held.extend(frame["ts_ms"].tolist())
        watermark = state.getCurrentWatermarkMs()
        held.sort()
        ready = [ts for ts in held if ts <= watermark]
        since = None
        for ts in ready:
            if hot:
                break
            if len(ring) == size and ring[0] >= ts - period:
                hot, since = True, ts
            ring = [*ring, ts][-size:]
        held = [] if hot else held[len(ready):]
        # A function stays hot for good; one bit of it is kept.
        state.update((held, [] if hot else ring, hot))
        if held:
            state.setTimeoutTimestamp(max(held[0], watermark + 1))
        if since is not None:
            yield pd.DataFrame({"function": [key[0]], "hot_since": [since]})

    timed = with_event_time(cold, delay)
    return (timed.select("event_time", "function", "ts_ms").groupBy("function")
            .applyInPandasWithState(step, "function string, hot_since bigint",
                                    "held array<bigint>, ring array<bigint>, hot boolean",
                                    "append", "EventTimeTimeout"))
