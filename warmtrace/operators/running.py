"""Running sums and maxima in which no task holds a whole history.

A window over ``(keys)`` puts every row of a busy key in one task, and a window
without keys puts the whole table there.  Here the order is cut into chunks:
each chunk is summarised with map-side combining, the few chunk totals are
accumulated, and each chunk then starts from a single carry row.  Rows are
shuffled once, by (keys, chunk).  Every history is cut by the same rule, into
chunks of about equal size; a short one is a single chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# A history longer than this many rows is cut into chunks of about this size.
CHUNK_ROWS = 1_000_000
WIDTH = "_width"
# A ranking is cut into so many ranges.
RANGES = 256


def time_chunk(time: str, width_ms: int) -> Column:
    """Number of the fixed-width time chunk."""
    return F.call_function("div", F.col(time), F.lit(width_ms))


def with_widths(df: DataFrame, keys: Sequence[str], time: str = "ts_ms",
                chunk_rows: int = CHUNK_ROWS, multiple_of: int = 1) -> DataFrame:
    """Add the chunk width that suits the history of each key, null where one chunk will do.

    A key with more than ``chunk_rows`` rows has chunks of about as many; only such keys are in the
    table of widths.  It goes to every task: a join that shuffles by key would put a history into one
    task, and the windows over its chunks would leave it there.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(time).alias("_lo"),
                                  F.max(time).alias("_hi"))
    span = (F.col("_hi") - F.col("_lo") + 1) * F.lit(chunk_rows).cast("double") / F.col("_n")
    width = F.greatest(F.lit(1), F.ceil(span / F.lit(multiple_of))) * F.lit(multiple_of)
    cut = stats.where(F.col("_n") > chunk_rows).select(*[F.col(k).alias(f"_of_{k}") for k in keys],
                                                       width.cast("bigint").alias(WIDTH))
    if keys:
        same = [F.col(k) == F.col(f"_of_{k}") for k in keys]
        return df.join(F.broadcast(cut), same, "left").drop(*[f"_of_{k}" for k in keys])
    return df.withColumn(WIDTH, cut.scalar())


def with_range(df: DataFrame, value: str, name: str = "_range") -> DataFrame:
    """Add the number of the range of ``value`` among all rows."""
    borders = df.select(borders_of(F.col(value))).scalar()
    return (df.withColumn("_borders", borders)
            .withColumn(name, range_of(F.col("_borders"), F.col(value))).drop("_borders"))


def range_of(borders: Column, value: Column) -> Column:
    """Number of the range of ``value`` between ascending borders; NaN is in the last, null in the first."""
    return F.coalesce(F.size(F.filter(borders, lambda b: b < value)), F.lit(0))


def borders_of(value: Column, ranges: int = RANGES) -> Column:
    """An aggregate: borders that cut ``value`` into ranges of about equally many rows, however it lies."""
    return F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges)


def chunk_of(df: DataFrame, time: str) -> Column:
    """Chunk number of the rows of ``with_widths``."""
    return F.when(F.col(WIDTH).isNull(), F.lit(0).cast("bigint")).otherwise(
        F.call_function("div", F.col(time), F.col(WIDTH)))


def running(df: DataFrame, *, keys: Sequence[str], chunk: Column, order: Sequence[str],
            sums: Mapping[str, Column] | None = None,
            maxes: Mapping[str, Column] | None = None,
            exclusive: bool = False, keep_chunk: str | None = None, keep_row: bool = False) -> DataFrame:
    """Add running sums and maxima in ``order`` within ``keys``.

    ``chunk`` must not decrease along ``order``.  With ``exclusive`` the row
    itself is left out.  A maximum over no rows is null, a sum is 0.  With ``keep_row`` a constant column
    ``_row`` stays: the rows lie by keys, chunk, ``_row`` and ``order``, and a sort by these costs nothing.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    keys = list(keys)
    last = -1 if exclusive else Window.currentRow
    marked = df.withColumn("_chunk", chunk)
    totals = marked.groupBy(*keys, "_chunk").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max(c).alias(n) for n, c in maxes.items()])
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
        *[F.max(n).over(before).alias(n) for n in maxes],
        F.lit(0).alias("_row"))
    rows = marked.select("*", *[c.alias(n) for n, c in {**sums, **maxes}.items()],
                         F.lit(1).alias("_row"))
    upto = (Window.partitionBy(*keys, "_chunk").orderBy("_row", *order)
            .rowsBetween(Window.unboundedPreceding, last))
    plain = [c for c in rows.columns if c not in sums and c not in maxes]
    # Said outright: rows that lie by key already, as after a join, would stay in one task for the windows.
    dealt = rows.unionByName(carry, allowMissingColumns=True).repartition(*keys, "_chunk")
    out = dealt.select(
        *plain,
        *[F.sum(n).over(upto).alias(n) for n in sums],
        *[F.max(n).over(upto).alias(n) for n in maxes]).where("_row = 1")
    if not keep_row:
        out = out.drop("_row")
    if keep_chunk:
        return out.withColumnRenamed("_chunk", keep_chunk)
    return out.drop("_chunk")
