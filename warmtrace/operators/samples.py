"""Sample instants that depend on each other: the next one is the first arrival far enough behind the last.

Following them is an orbit of a jump function over the sorted arrivals.  It is solved in parallel: time is cut into
chunks, and each chunk finds for every sample instant that could be the last one before it which instant is the last one
inside it.  Orbits run together, so that few different answers are left.  They are composed along the chunks, one
row each, and every chunk then follows its own part from the instant it is entered with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SAMPLE_MS
from .running import time_chunk
from .stages import materialise

CHUNK_MS = 1 << 20


def _jumps(times: np.ndarray, gap: int) -> np.ndarray:
    """For each arrival the place of the first one more than ``gap`` later."""
    return np.searchsorted(times, times + gap, "right")


def chunk_exits(times: np.ndarray, begin: int, gap: int) -> tuple[list[int], list[int | None]]:
    """The last sample inside a chunk, by the last one before it plus ``gap``.

    ``times`` are the chunk's different arrivals in order, ``begin`` its first instant.  The ``i``-th answer holds from the
    ``i``-th bound on, None where no sample is inside; the first bound is below everything.
    """
    n = len(times)
    # Entering behind a bound starts at the first arrival later than it; the last sample is before ``begin``, or 0.
    starts = int(np.searchsorted(times, max(begin - 1, 0) + gap, "right"))
    at, jump = np.arange(min(starts, n - 1) + 1), _jumps(times, gap)
    while True:
        after = jump[at]
        if (after == n).all():
            break
        at = np.where(after < n, after, at)
    last: list[int | None] = times[at].tolist()
    bounds = [np.iinfo(np.int64).min, *times[:len(at) - 1].tolist()]
    if starts == n:
        bounds.append(int(times[-1]))
        last.append(None)
    keep = [i for i in range(len(last)) if i == 0 or last[i] != last[i - 1]]
    return [bounds[i] for i in keep], [last[i] for i in keep]


def sample_times(tr: DataFrame, gap_ms: int = SAMPLE_MS, final: bool = True, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """ts_ms: the instants of the samples.

    A sample is taken at the first arrival more than ``gap_ms`` after the last one, the first after 0.  With
    ``final`` there is one at the last arrival too, where it has none.  Arrivals of one millisecond are one instant.
    A task holds the different milliseconds of one chunk, at most ``chunk_ms``; one task reads one row a chunk in order.
    No rows give no samples.
    """
    at = materialise(tr.where("ts_ms is not null").select("ts_ms").distinct())
    chunked = at.select(time_chunk("ts_ms", chunk_ms).alias("chunk"), F.col("ts_ms").cast("bigint").alias("ts_ms"))

    def exits(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        bounds, last = chunk_exits(np.sort(table["ts_ms"].to_numpy()), chunk * chunk_ms, gap_ms)
        return pa.table({"chunk": [chunk], "bounds": pa.array([bounds], pa.list_(pa.int64())), "last": pa.array([last], pa.list_(pa.int64()))})

    def entered(source):
        state = 0
        for batch in source:
            chunks, states = [], []
            for row in batch.to_pylist():
                chunks.append(row["chunk"])
                states.append(state)
                found = row["last"][int(np.searchsorted(row["bounds"], state + gap_ms, "right")) - 1]
                state = state if found is None else found
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(states, pa.int64())], names=["chunk", "state"])

    def followed(rows: pa.Table, state: pa.Table) -> pa.Table:
        times = np.sort(rows["ts_ms"].to_numpy())
        jump, out = _jumps(times, gap_ms), []
        place = int(np.searchsorted(times, state["state"][0].as_py() + gap_ms, "right"))
        while place < len(times):
            out.append(times[place])
            place = int(jump[place])
        return pa.table({"ts_ms": pa.array(out, pa.int64())})

    ends = chunked.groupBy("chunk").applyInArrow(exits, "chunk bigint, bounds array<bigint>, last array<bigint>")
    states = materialise(ends.repartition(1).sortWithinPartitions("chunk").mapInArrow(entered, "chunk bigint, state bigint"))
    out = chunked.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(followed, "ts_ms bigint")
    if final:
        out = out.unionByName(at.agg(F.max("ts_ms").alias("ts_ms")).where("ts_ms is not null")).distinct()
    return out
