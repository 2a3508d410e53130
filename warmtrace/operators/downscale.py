"""Making a trace smaller: by popularity, owner, chance, concurrency or memory.

Concurrency and memory caps admit rows greedily in time order: a row is dropped
if the admitted rows still running plus itself would exceed the cap.  That is a
recurrence over one time line, so it is reduced to where it matters.  A row
whose whole input load (all running rows, admitted or not) stays within the cap
is surely admitted.  Only the *contested* rest is decided in order, against the
known load of the sure rows, and that rest falls apart into pieces wherever no
contested row is running.  Pieces are decided in parallel with a heap of the
running rows, over packed blocks of what decides; the rows themselves stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash32, shuffle_key
from ..model import ORDER, end_ms
from .aggregate import count_by_function
from .expand import keep_selected
from .running import CHUNK_ROWS, chunk_of, running, with_range, with_widths
from .stages import materialise
from .starts import _ddl

# A cap is split over so many shards at most.
MOST_SHARDS = 256
# So many contested rows go as one to the task that decides them, with these columns.
BLOCK_ROWS = 1024
DECIDING = ["_piece", "ts_ms", "_end", "_weight", "_sure_load", "_limit"]


def owners_by_functions(tr: DataFrame) -> DataFrame:
    return (tr.select("owner", "function").distinct().groupBy("owner")
            .agg(F.count("*").alias("functions")))


def top_owners(tr: DataFrame, n: int, basis: DataFrame | None = None) -> DataFrame:
    """Keep the ``n`` owners with the most distinct functions, ties by name.

    Owners are ranked on ``basis`` when given (for example the trace before it
    was downscaled), else on the current rows.
    """
    ranked = owners_by_functions(tr if basis is None else basis)
    best = ranked.orderBy(F.desc("functions"), "owner").limit(n)
    return keep_selected(tr, best, "owner")


def popularity_band(tr: DataFrame, n: int) -> DataFrame:
    """The ``n`` functions around the median by invocations, ties in hashed order."""
    per = count_by_function(tr).withColumn("_key", shuffle_key(F.col("function")))
    # Many rare functions share a count, so the ranges go on by the leading digits of the hashed order.
    lead = F.col("invocations") * 65_536 + F.conv(F.substring("_key", 1, 4), 16, 10).cast("bigint")
    per = with_range(per.withColumn("_lead", lead), "_lead")
    ranked = running(per, keys=[], chunk=F.col("_range"), order=["_lead", "_key", "function"],
                     sums={"rank": F.lit(1)})
    functions = per.select(F.count("*")).scalar()
    skip = F.floor(F.greatest(functions - n, F.lit(0)) / 2)
    return (ranked.where((F.col("rank") > skip) & (F.col("rank") <= skip + n))
            .select("function", "invocations", "rank"))


def middle_functions(tr: DataFrame, n: int) -> DataFrame:
    """Keep the rows of the ``n`` functions of median popularity."""
    return keep_selected(tr, popularity_band(tr, n), "function")


def thin_random(tr: DataFrame, x: int, seed: int = 0) -> DataFrame:
    """Keep each row with probability 1 / x, repeatably."""
    return tr.where(hash32(F.col("function"), F.col("seq"), seed) % x == 0)


def _packed(keys: list[str], schema: str):
    """Arrow step: one row for each run of ``keys``, what decides its rows compressed in ``_rows``."""

    def steps(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            begins = np.zeros(len(batch), bool)
            begins[0] = True
            for name in keys:
                column = batch.column(name).dictionary_encode("encode").indices.to_numpy()
                begins[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(begins)
            rows = batch.select(DECIDING)
            packed = []
            for lo, hi in zip(at, np.append(at[1:], len(batch))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_batch(rows.slice(lo, hi - lo))
                packed.append(sink.getvalue().to_pybytes())
            first = batch.select([*keys, "_place"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(packed, pa.binary())],
                                             [*first.schema.names, "_rows"])

    return steps, schema + ", `_rows` binary"


def _greedy(by: list[str], schema: str):
    """Arrow step: admit packed contested rows in order, piece by piece; the places of those admitted."""
    names = [*by, "_home"]

    def steps(batches):
        import heapq

        import pyarrow as pa

        home, live, held = None, [], 0
        for batch in batches:
            homes = zip(*[batch.column(n).to_pylist() for n in names])
            places = batch.column("_place").to_pylist()
            for row, (h, place, rows) in enumerate(zip(homes, places, batch.column("_rows"))):
                if h != home:
                    home, live, held = h, [], 0
                columns = pa.ipc.open_stream(rows.as_buffer()).read_next_batch().select(DECIDING).columns
                admitted = []
                for begin, ts, end, weight, base, limit in zip(*[c.to_pylist() for c in columns]):
                    if begin == place:
                        live, held = [], 0
                    while live and live[0][0] <= ts:
                        held -= heapq.heappop(live)[1]
                    if base + held + weight <= limit:
                        heapq.heappush(live, (end, weight))
                        held += weight
                        admitted.append(place)
                    place += 1
                of = batch.select(by).take(pa.array(np.full(len(admitted), row)))
                yield pa.RecordBatch.from_arrays([*of.columns, pa.array(admitted, pa.int64())], [*by, "_place"])

    return steps, schema


def _arrival_load(rows: DataFrame, weight: Column, by: list[str], name: str) -> DataFrame:
    """Add to each row the weight running when it arrives, itself included."""
    columns = rows.columns
    moves = (rows.withColumn("_w", weight)
             .select("*", F.posexplode(F.array("ts_ms", end_ms())).alias("_kind", "_time"))
             .withColumn("_move", F.when(F.col("_kind") == 0, F.col("_w")).otherwise(-F.col("_w"))))
    loaded = running(moves, keys=by, chunk=chunk_of(moves, "_time"),
                     order=["_time", *ORDER, "_kind"], sums={name: F.col("_move")})
    return loaded.where("_kind = 0").select(*columns, name)


def _admit(tr: DataFrame, weight: Column, by: list[str], chunk_rows: int) -> DataFrame:
    """Rows admitted under the cap in column ``_limit``, one cap per ``by``."""
    columns = [c for c in tr.columns if c != "_limit"]
    rows = with_widths(tr, by, chunk_rows=chunk_rows).withColumn("_weight", weight.cast("bigint"))
    load = _arrival_load(rows, F.col("_weight"), by, "_load")
    load = materialise(load.withColumn("_contested", F.col("_load") > F.col("_limit")).drop("_load"))
    sure = load.where(~F.col("_contested"))
    known = _arrival_load(load, F.when(F.col("_contested"), 0).otherwise(F.col("_weight")),
                          by, "_sure_load")
    contested = materialise(known.where("_contested").withColumn("_end", end_ms()))
    chunk = chunk_of(contested, "ts_ms")
    after = running(contested, keys=by, chunk=chunk, order=ORDER, sums={"_place": F.lit(1)},
                    maxes={"_until": F.col("_end")}, exclusive=True)
    free = F.col("_until").isNull() | (F.col("ts_ms") >= F.col("_until"))
    # A piece is named by the place of its first row.
    pieces = materialise(running(after.withColumn("_free", F.when(free, F.col("_place"))).drop("_until"), keys=by,
                                 chunk=chunk, order=ORDER, maxes={"_piece": F.col("_free")}))
    admitted = _admitted(pieces, by).select(*[F.col(n).alias(f"_of_{n}") for n in [*by, "_place"]])
    same = [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in by] + [F.col("_place") == F.col("_of__place")]
    decided = pieces.join(admitted, same, "left_semi")
    return sure.select(*columns).unionByName(decided.select(*columns))


def _admitted(pieces: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``_place`` of the contested rows that are admitted.

    Rows are packed by blocks in parallel, so that a long piece, which is one task's work, takes little of its
    memory.  The pieces that begin in one block are decided by one task.
    """
    home, block = (F.call_function("div", F.col(c), F.lit(BLOCK_ROWS)) for c in ("_piece", "_place"))
    keys = [*by, "_home", "_block"]
    rows = pieces.select(*by, home.alias("_home"), block.alias("_block"), "_place", *DECIDING)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_place")
    step, schema = _packed(keys, _ddl(rows.select(*keys, "_place")))
    packed = rows.mapInArrow(step, schema)
    packed = packed.repartition(*by, "_home").sortWithinPartitions(*by, "_home", "_place")
    step, schema = _greedy(by, _ddl(packed.select(*by, "_place")))
    return packed.mapInArrow(step, schema)


def _shards(tr: DataFrame, limit: int, weight: Column, shards: int | None) -> int:
    """How many shards the cap may have so that each one's part holds the heaviest row that fits the cap.

    A heavier part of the trace would be lost whole otherwise.  Rows over the cap fit nowhere, in either mode.
    """
    heaviest = tr.agg(F.max(F.when(weight <= limit, weight))).first()[0]
    most = max(1, limit // max(1, heaviest or 1))
    if shards is not None and shards > most:
        raise ValueError(f"with {shards} shards a row of weight {heaviest} does not fit a shard's part of {limit}; at most {most} do")
    return min(most, MOST_SHARDS) if shards is None else shards


def _cap(tr: DataFrame, limit: int, weight: Column, mode: str, by: Sequence[str] | None,
         shards: int | None, seed: int, chunk_rows: int) -> DataFrame:
    if mode == "sharded":
        shards = _shards(tr, limit, weight, shards)
        shard = (hash32(F.col("function"), F.col("seq"), seed) % shards).cast("int")
        quota = F.lit(limit // shards) + (F.col("_shard") < limit % shards).cast("int")
        rows = tr.withColumn("_shard", shard).withColumn("_limit", quota.cast("bigint"))
        return _admit(rows, weight, [*(by or []), "_shard"], chunk_rows).drop("_shard")
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    rows = tr.withColumn("_limit", F.lit(limit).cast("bigint"))
    return _admit(rows, weight, list(by or []), chunk_rows)


def cap_concurrency(tr: DataFrame, n: int, mode: str = "sharded", by: Sequence[str] | None = None,
                    shards: int | None = None, seed: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Drop rows that would make more than ``n`` run at once, in all or of one ``by``.

    ``sharded`` splits the cap over hashed shards: never exceeded and decided in parallel, but another and
    smaller selection than the greedy one.  Each shard's part holds any row that fits the cap, so rows
    that do not overlap all stay; a number of ``shards`` that breaks this is refused.  ``exact`` admits
    precisely the greedy rows; where the cap is always reached that is one task's work for each ``by``.
    """
    return _cap(tr, n, F.lit(1), mode, by, shards, seed, chunk_rows)


def cap_memory(tr: DataFrame, mb: int, mode: str = "sharded", by: Sequence[str] | None = None,
               shards: int | None = None, seed: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Drop rows that would make running memory exceed ``mb``; modes as above."""
    return _cap(tr, mb, F.col("memory_mb"), mode, by, shards, seed, chunk_rows)


def downscale(tr: DataFrame, functions: int = 0, concurrency: int = 0, users: int = 0,
              memory: int = 0, rank_users_on: DataFrame | None = None, **caps) -> DataFrame:
    """All four limits in their fixed order; 0 skips a step."""
    if functions:
        tr = middle_functions(tr, functions)
    if concurrency:
        tr = cap_concurrency(tr, concurrency, **caps)
    if users:
        tr = top_owners(tr, users, rank_users_on)
    if memory:
        tr = cap_memory(tr, memory, **caps)
    return tr
