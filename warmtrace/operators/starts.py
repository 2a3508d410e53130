"""Cold and warm starts under a keep-alive policy.

Every invocation leaves its container idle from its end until ``keepalive_ms``
later, whether it started cold or warm.  An arrival takes the container of its
function that became idle first, so containers are used up in the order of
their ends.  Let A be the ends so far, X those already past their keep-alive
and j the arrivals so far; the number p of containers used up or expired obeys

    p  <-  min(max(p, X) + 1, A)        (cold exactly when max(p, X) = A)

and u = p - j is clamped between two known bounds at each arrival.  Clamps
compose into clamps, so a function's history can be cut into time chunks that
are solved apart and joined by one clamp per chunk.  A function with a third of
all rows is thus spread over as many tasks as it has chunks, with the same
result as one pass over its history.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import optimised_footprint
from ..model import FUNCTION_ORDER, HOT_COLD_STARTS, HOT_PERIOD_MS, KEEPALIVE_MS, end_ms
from .running import CHUNK_ROWS, WIDTH, chunk_of, running, with_widths
from .stages import materialise

WIDEST = 1 << 62


def active_segments(tr: DataFrame, keepalive_ms: int = KEEPALIVE_MS,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number each function's stretches without an idle gap.

    A new segment starts when every earlier container of the function is past
    its keep-alive.
    """
    cut = with_widths(tr, ["function"], chunk_rows=chunk_rows)
    past = running(cut, keys=["function"], chunk=chunk_of(cut, "ts_ms"), order=FUNCTION_ORDER,
                   maxes={"_until": end_ms() + F.lit(keepalive_ms)}, exclusive=True)
    begins = F.col("_until").isNull() | (F.col("ts_ms") >= F.col("_until"))
    numbered = running(past.withColumn("_begins", begins.cast("int")).drop("_until"),
                       keys=["function"], chunk=chunk_of(cut, "ts_ms"), order=FUNCTION_ORDER,
                       sums={"segment": F.col("_begins")})
    return numbered.select(*tr.columns, "segment")


def _clamp_scan(keys: list[str], schema: str):
    """Arrow step: compose the clamps of the rows before each row, per run of ``keys``.

    Input is sorted by ``keys`` and then by time; ``lo`` and ``hi`` are the
    row's own clamp, and ``lo_before``/``hi_before`` are added.
    """
    names, widest = list(keys), WIDEST

    def steps(batches):
        import pyarrow as pa

        carried = None  # (key, lo, hi) after the last row of the previous batch
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            lo = batch.column("lo").to_numpy(zero_copy_only=False)
            hi = batch.column("hi").to_numpy(zero_copy_only=False)
            begins = np.zeros(n, dtype=bool)
            begins[0] = True
            for name in names:
                column = batch.column(name).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                begins[1:] |= column[1:] != column[:-1]
            first_key = tuple(batch.column(name)[0].as_py() for name in names)
            last_key = tuple(batch.column(name)[n - 1].as_py() for name in names)
            run = np.cumsum(begins)
            low, high = lo.copy(), hi.copy()
            if carried is not None and carried[0] == first_key:
                low[0] = min(max(carried[1], lo[0]), hi[0])
                high[0] = min(max(carried[2], lo[0]), hi[0])
            # Doubling: row i composes with the row d before it in the same run.
            longest = int(np.diff(np.flatnonzero(np.append(begins, True))).max())
            d = 1
            while d < longest:
                same = run[d:] == run[:-d]
                l2, h2 = low[d:], high[d:]
                l1 = np.where(same, np.minimum(np.maximum(low[:-d], l2), h2), l2)
                h1 = np.where(same, np.minimum(np.maximum(high[:-d], l2), h2), h2)
                low, high = np.append(low[:d], l1), np.append(high[:d], h1)
                d *= 2
            low_before = np.full(n, -widest, dtype=np.int64)
            high_before = np.full(n, widest, dtype=np.int64)
            low_before[1:] = np.where(begins[1:], -widest, low[:-1])
            high_before[1:] = np.where(begins[1:], widest, high[:-1])
            if carried is not None and carried[0] == first_key:
                low_before[0], high_before[0] = carried[1], carried[2]
            carried = (last_key, int(low[-1]), int(high[-1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(low_before), pa.array(high_before)],
                [*batch.schema.names, "lo_before", "hi_before"])

    return steps, schema + ", lo_before bigint, hi_before bigint"


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _scanned(df: DataFrame, keys: list[str]) -> DataFrame:
    step, schema = _clamp_scan(keys, _ddl(df))
    return df.mapInArrow(step, schema)


def _pool(tr: DataFrame, keepalive_ms: int, chunk_rows: int) -> DataFrame:
    """Arrivals with a cold flag and the rank of the container they take; idle containers with theirs.

    One row per arrival (``kind`` 0) and per end (``kind`` 1).
    """
    payload = [c for c in tr.columns if c not in ("function", "ts_ms", "seq")]
    # Kinds 0, 1, 2: arrival, end, end of the keep-alive.
    moments = F.array("ts_ms", end_ms(), end_ms() + F.lit(keepalive_ms))
    # Only arrivals carry the payload through the shuffle.
    cut = with_widths(tr, ["function"], chunk_rows=chunk_rows)
    events = (cut.select("*", F.posexplode(moments).alias("kind", "time"))
              .select("function", "ts_ms", "seq", "kind", "time",
                      *[c for c in cut.columns if c == WIDTH],
                      *[F.when(F.col("kind") == 0, F.col(c)).alias(c) for c in payload]))
    counted = running(
        events, keys=["function"], chunk=chunk_of(events, "time"),
        order=["time", "ts_ms", "seq", "kind"], keep_chunk="chunk", keep_row=True,
        sums={"arrived": (F.col("kind") == 0).cast("bigint"),
              "idle": (F.col("kind") == 1).cast("bigint"),
              "expired": (F.col("kind") == 2).cast("bigint")}).where("kind < 2")
    # The clamp of an arrival; an end leaves the state as it is.
    arrival = F.col("kind") == 0
    high = F.col("idle") - F.col("arrived")
    low = F.least(F.col("expired") - F.col("arrived") + 1, high)
    bounded = (counted
               .withColumn("spent", F.col("expired") == F.col("idle"))
               .withColumn("lo", F.when(arrival, low).otherwise(F.lit(-WIDEST)))
               .withColumn("hi", F.when(arrival, high).otherwise(F.lit(WIDEST)))
               .drop("expired")
               .sortWithinPartitions("function", "chunk", "_row", "time", "ts_ms", "seq", "kind").drop("_row"))
    return materialise(_scanned(bounded, ["function", "chunk"]).drop("time", WIDTH))


def _resolved(pool: DataFrame) -> DataFrame:
    """Arrivals with ``cold`` and, when warm, the rank ``taken`` of the container they take."""
    arrivals = pool.where("kind = 0")
    # The clamp of a whole chunk is that of its last arrival.
    low = F.least(F.greatest("lo_before", "lo"), "hi")
    high = F.least(F.greatest("hi_before", "lo"), "hi")
    chunks = (arrivals.groupBy("function", "chunk")
              .agg(F.max_by(low, "arrived").alias("lo"), F.max_by(high, "arrived").alias("hi"))
              .repartition("function").sortWithinPartitions("function", "chunk"))
    start = _scanned(chunks, ["function"]).select(
        "function", "chunk",
        F.least(F.greatest(F.lit(0), "lo_before"), "hi_before").alias("_start"))
    reach = F.greatest(F.least(F.greatest("_start", "lo_before"), "hi_before"), "lo")
    return (arrivals.join(start, ["function", "chunk"])
            .withColumn("cold", F.col("spent") | (reach > F.col("hi")))
            .withColumn("taken", F.when(~F.col("cold"), reach + F.col("arrived"))))


def cold_starts(tr: DataFrame, keepalive_ms: int = KEEPALIVE_MS,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The trace with a ``cold`` flag only; cheaper than ``classify_starts``."""
    found = _resolved(_pool(tr, keepalive_ms, chunk_rows))
    return found.select(*tr.columns, "cold")


def _linked(tr: DataFrame, keepalive_ms: int, chunk_rows: int, previous: bool) -> DataFrame:
    """Cold flags, when each container is taken again, and from which row it was taken."""
    pool = _pool(tr, keepalive_ms, chunk_rows)
    found = _resolved(pool)
    idle = pool.where("kind = 1").select("function", F.col("idle").alias("_rank"), "seq")
    takers = found.where(~F.col("cold")).select(
        "function", F.col("taken").alias("_rank"), F.col("ts_ms").alias("reused_at"),
        F.col("seq").alias("reused_by"))
    reuse = idle.join(takers, ["function", "_rank"]).drop("_rank")
    if previous:
        reuse = materialise(reuse)
    out = (found.select(*tr.columns, "cold")
           .join(reuse, ["function", "seq"], "left"))
    if previous:
        out = out.join(reuse.select("function", F.col("reused_by").alias("seq"),
                                    F.col("seq").alias("previous")), ["function", "seq"], "left")
    return out


def _roots(run: np.ndarray, seq: np.ndarray, link: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first row of each row's chain, and the places that are linked to, by pointer doubling.

    A link points at the row of that ``seq`` in the same run; one that points at none begins a chain.
    """
    values, code = np.unique(np.concatenate([seq, link[linked]]), return_inverse=True)
    names = run * len(values) + code[:len(seq)]
    order = np.argsort(names)
    wanted = run[linked] * len(values) + code[len(seq):]
    at = np.minimum(np.searchsorted(names[order], wanted), len(seq) - 1)
    found = names[order][at] == wanted
    parent = np.arange(len(seq))
    targets = order[at[found]]
    parent[np.flatnonzero(linked)[found]] = targets
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent, targets
        parent = above


def _head_step(keys: list[str], schema: str):
    """Arrow step: the first row of each row's container in its run of ``keys``, by the links ``previous``.

    Rows come in time order, so that a link points at a row before, or out of the run.  Between batches only the rows of
    the open run that will still be taken (``_kept``) are remembered.
    """
    def steps(batches):
        import pyarrow as pa

        last, held_seq, held_head = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in keys]
            new = np.zeros(len(batch), bool)
            for column in columns:
                new[1:] |= column[1:] != column[:-1]
            if last != tuple(c[0] for c in columns):
                held_seq, held_head = held_seq[:0], held_head[:0]
            n = len(held_seq)
            run = np.concatenate([np.zeros(n, np.int64), np.cumsum(new)])
            seq = np.concatenate([held_seq, batch.column("seq").to_numpy()])
            links = batch.column("previous")
            linked = np.concatenate([np.zeros(n, bool), links.is_valid().to_numpy(zero_copy_only=False)])
            link = np.concatenate([held_seq, links.fill_null(0).to_numpy()])
            root, taken = _roots(run, seq, link, linked)
            head = np.concatenate([held_head, seq[n:]])[root]
            stays = np.concatenate([np.ones(n, bool), batch.column("_kept").to_numpy(zero_copy_only=False)]) & (run == run[-1])
            stays[taken] = False
            last, held_seq, held_head = tuple(c[-1] for c in columns), seq[stays], head[stays]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head[n:], pa.int64())], [*batch.schema.names, "head"])

    return steps, schema + ", head bigint"


def _ranked(enter: DataFrame) -> DataFrame:
    """function, head, container_id: where the pointers ``above`` of first rows end, by pointer doubling.

    Each round joins the pointers with themselves, and doubles how far they reach: as many rounds as the chunks that the
    longest container lives through have binary digits.  A row is a container in a chunk; no function is in one task.
    """
    pointers = materialise(enter.select("function", F.col("seq").alias("head"), "above"))
    while True:
        hop = pointers.select("function", F.col("head").alias("above"), F.col("above").alias("_next"))
        pointers = materialise(pointers.select("function", "head", "above").join(hop, ["function", "above"], "left").select(
            "function", "head", F.coalesce("_next", "above").alias("above"), F.col("_next").isNotNull().alias("moved")))
        if pointers.where("moved").isEmpty():
            return pointers.select("function", "head", F.col("above").alias("container_id"))


def _chains(linked: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the first row of their container in their time chunk, and a table of those first rows.

    Each chunk is followed apart; then only the first rows, one per container and chunk, are followed from chunk to chunk.
    """
    keys = ["function", "chunk"]
    linked = materialise(linked)
    cut = with_widths(linked, ["function"], chunk_rows=chunk_rows)
    rows = (cut.withColumn("chunk", chunk_of(cut, "ts_ms")).drop(WIDTH)
            .withColumn("_kept", F.col("reused_by").isNotNull())
            .repartition(*keys).sortWithinPartitions(*keys, *FUNCTION_ORDER))
    step, schema = _head_step(keys, _ddl(rows))
    rows = materialise(rows.mapInArrow(step, schema).drop("_kept"))
    enter = rows.where(F.col("previous").isNotNull() & (F.col("head") == F.col("seq")))
    above = rows.select("function", F.col("seq").alias("previous"), F.col("head").alias("above"))
    entered = _ranked(enter.select("function", "seq", "previous").join(above, ["function", "previous"]))
    begun = rows.where("cold").select("function", F.col("seq").alias("head"),
                                      F.col("seq").alias("container_id"))
    return rows, begun.unionByName(entered)


def classify_starts(tr: DataFrame, keepalive_ms: int = KEEPALIVE_MS, chunk_rows: int = CHUNK_ROWS,
                    containers: bool = False) -> DataFrame:
    """Add ``cold`` and ``reused_at`` (when the container is next taken, null if never).

    With ``containers`` also ``container_id``, the ``seq`` of the cold start the
    container began with.  ``(function, seq)`` must identify a row and durations
    must not be negative.
    """
    linked = _linked(tr, keepalive_ms, chunk_rows, containers)
    if not containers:
        return linked.select(*tr.columns, "cold", "reused_at")
    rows, heads = _chains(linked, chunk_rows)
    return (rows.join(heads, ["function", "head"])
            .select(*tr.columns, "cold", "reused_at", "container_id"))


def hot_cold_starts(cold: DataFrame, n: int = HOT_COLD_STARTS, period_ms: int = HOT_PERIOD_MS,
                    zero_fill: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``hot``: the function had ``n`` cold starts within ``period_ms`` before, now or earlier.

    A chunk also sees the cold starts up to ``period_ms`` before it, which is
    all the rule can reach.  ``zero_fill`` counts missing predecessors as
    starts at time 0.
    """
    wide = with_widths(cold, ["function"], chunk_rows=chunk_rows).withColumn(
        WIDTH, F.when(F.col(WIDTH).isNotNull(), F.greatest(F.col(WIDTH), F.lit(period_ms))))
    own = chunk_of(wide, "ts_ms")
    reaches_next = F.coalesce((own + 1) * F.col(WIDTH) - F.col("ts_ms") <= F.lit(period_ms), F.lit(False))
    seen = wide.withColumn("_w", F.explode(F.when(reaches_next, F.array(own, own + 1))
                                           .otherwise(F.array(own)))).repartition("function", "_w")
    w = Window.partitionBy("function", "_w").orderBy(*FUNCTION_ORDER)
    since = F.col("ts_ms") - F.lit(period_ms)
    nth = F.lag("ts_ms", n).over(w)
    if zero_fill:
        hit = (F.row_number().over(w) > 1) & (F.coalesce(nth, F.lit(0)) >= since)
    else:
        hit = F.coalesce(nth >= since, F.lit(False))
    hits = (seen.withColumn("_hit", hit.cast("int")).where(F.col("_w") == own).drop("_w"))
    return (running(hits, keys=["function"], chunk=chunk_of(hits, "ts_ms"), order=FUNCTION_ORDER,
                    maxes={"_hot": F.col("_hit")})
            .withColumn("hot", F.col("_hot") == 1).drop("_hot", "_hit", WIDTH))


def hot_functions(cold: DataFrame, n: int = HOT_COLD_STARTS, period_ms: int = HOT_PERIOD_MS,
                  zero_fill: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Functions that became hot, with the time of the cold start that made them so."""
    flags = hot_cold_starts(cold, n, period_ms, zero_fill, chunk_rows)
    return (flags.where("hot").groupBy("function")
            .agg(F.min("ts_ms").alias("hot_since"), F.count("*").alias("hot_cold_starts")))


def classify_optimised(tr: DataFrame, keepalive_ms: int = KEEPALIVE_MS, n: int = HOT_COLD_STARTS,
                       period_ms: int = HOT_PERIOD_MS, zero_fill: bool = False,
                       chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Starts where cold starts of hot functions run optimised, in less memory.

    A container keeps the memory and the ``optimised`` flag it began with, so
    warm rows take both from the cold start of their container.
    """
    rows, heads = _chains(_linked(tr, keepalive_ms, chunk_rows, True), chunk_rows)
    cold = rows.where("cold").select("function", "ts_ms", "seq", "memory_mb")
    flagged = hot_cold_starts(cold, n, period_ms, zero_fill, chunk_rows).select(
        "function", F.col("seq").alias("container_id"), F.col("hot").alias("optimised"),
        F.when(F.col("hot"), optimised_footprint(F.col("memory_mb")))
        .otherwise(F.col("memory_mb")).alias("memory_mb"))
    heads = heads.join(flagged, ["function", "container_id"])
    others = [c for c in tr.columns if c != "memory_mb"]
    return (rows.drop("memory_mb").join(heads, ["function", "head"])
            .select(*others, "memory_mb", "cold", "reused_at", "container_id", "optimised")
            .select(*tr.columns, "cold", "reused_at", "container_id", "optimised"))
