"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warmtrace.operators.stages import materialise

__all__ = ["materialise", "own", "table", "remainder", "words_of", "columns", "batches", "slices", "free", "freeing", "held", "hashed_sample", "factorised", "word_list"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the number as text, modulo ``modulus``; a null id counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def own(df: DataFrame) -> str:
    """A beginning that no column of ``df`` has, for names of columns beside the caller's."""
    out = "_"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text with A-Z in lower case.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: exactly these rules.
    """
    return text.lower().split()


def hashed_sample(df: DataFrame, rows: int, order: Column) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes ``order``, ties by the columns.

    Only about four times as many are ordered, whatever the number of tasks: the others' hashes are too large.
    """
    total = max(1, df.count())
    near = df.withColumn("_hash", F.pmod(order, F.lit(1 << 32))).where(F.col("_hash") < 4.0 * rows * (1 << 32) / total)
    return near.orderBy("_hash", *df.columns).limit(rows).drop("_hash")


def factorised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of many texts at once, by the rule of ``words_of``.

    Gives for text ``i`` the codes ``codes[first[i]:first[i + 1]]``, and the different words as an
    array in the order of their codes.  A null text has no words.
    """
    kind = pa.large_string() if pa.types.is_large_string(texts.type) else pa.string()
    texts = pc.fill_null(texts, pa.scalar("", kind))
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    empty = pc.index(coded.dictionary, pa.scalar("", kind)).as_py()
    if empty >= 0:   # white space at the ends splits off empty words
        kept = codes != empty
        first = np.concatenate([[0], np.cumsum(kept)])[first]
        codes = codes[kept]
    return first, codes, coded.dictionary


def word_list(text: str) -> Column:
    """The same words in the JVM, for small tables."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                        "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Columns as Python lists; text as UTF-8 bytes."""
    out = []
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        out.append(column.to_pylist())
    return out


def slices(batch: pa.RecordBatch, text: str = "text", rows: int = 1024,
           size: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and about ``size`` bytes of text; a longer text is alone."""
    bytes_ = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
    total, first = np.cumsum(bytes_), 0
    while first < len(batch):
        before = total[first - 1] if first else 0
        last = min(first + rows, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(first, max(1, last - first))
        first = max(first + 1, last)


def free() -> None:
    """Give memory that is free in this process back to the machine: Arrow's, and the C library's where that can be asked for."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """What a worker keeps from one task to the next, made once; one thing at a time, so another one goes before.

    The workers of one operator serve the next too, and what they keep would add up.
    """
    if key not in _held:
        _held.clear()
        free()
        _held[key] = make()
    return _held[key]


def freeing(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same step of ``mapInArrow``; a worker that waits for its next task keeps no free memory of this one."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(source)
        finally:
            free()

    return run


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 16 << 20,
            weight=None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``most`` rows and about ``most_bytes``; ``weight`` gives a row's bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) if weight else 0
        if len(held) >= most or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
