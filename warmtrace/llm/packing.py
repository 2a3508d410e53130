"""Bounded-space online packing of documents into windows of a fixed number of tokens.

Every task keeps a fixed number of open windows.  A piece goes into the fullest window that still
holds it (best fit); when none does, the fullest window takes as much of the piece as it has room
for and is emitted, and the rest goes on.  What is open at the end of a task is merged, first in the
task, then over groups of tasks, until a single remainder is left, which is dealt to windows of
powers of two, that need no padding.  A task holds ``open_windows`` windows and one Arrow batch,
whatever the table's size, and no row is shuffled but the remainders.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmtrace.llm.common import batches, free, freeing, materialise, slices
from warmtrace.llm.tokens import word_tokenizer

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("full", pa.bool_())])
DDL = ("doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, "
       "sequence_id bigint, offset bigint, part bigint, full boolean")
# Remainders of so many tasks are merged by one task: at most one window each.
MERGED = 512
# Bytes of text that are split into words at once, and of ids that are handed on at once: what a worker needs beside its windows.
SLICE, WRITTEN = 1 << 20, 4 << 20


class Windows:
    """The open windows of one task.  A piece is (doc_id, start, ids, doc_tokens), ids as an array."""

    def __init__(self, window: int, most_open: int):
        self.window, self.most_open = window, most_open
        self.open: list[tuple[int, list]] = []   # (tokens, pieces), oldest first

    def add(self, doc_id, ids: np.ndarray, start: int = 0, total: int | None = None) -> Iterator[list]:
        """Place one document, or one piece of it; gives the windows that became full."""
        total = len(ids) if total is None else total
        at = 0
        while len(ids) - at >= self.window:
            yield [(doc_id, start + at, ids[at:at + self.window], total)]
            at += self.window
        while at < len(ids):
            left = len(ids) - at
            fits = [(tokens, -k) for k, (tokens, _) in enumerate(self.open) if tokens + left <= self.window]
            if fits:
                k = -max(fits)[1]
            elif len(self.open) < self.most_open:
                k = len(self.open)
                self.open.append((0, []))
            else:
                k = max(range(len(self.open)), key=lambda i: (self.open[i][0], -i))
            tokens, pieces = self.open[k]
            taken = min(left, self.window - tokens)
            pieces.append((doc_id, start + at, ids[at:at + taken], total))
            at += taken
            self.open[k] = (tokens + taken, pieces)
            if tokens + taken == self.window:
                yield self.open.pop(k)[1]

    def merge(self) -> Iterator[tuple[list, bool]]:
        """The open windows, fullest first, run together into full ones and one remainder at most."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open = []
        yield from run_together(rest, self.window)


def run_together(pieces: list, window: int) -> Iterator[tuple[list, bool]]:
    held, tokens = [], 0
    for doc_id, start, ids, total in pieces:
        while len(ids):
            taken = min(len(ids), window - tokens)
            held.append((doc_id, start, ids[:taken], total))
            start, ids, tokens = start + taken, ids[taken:], tokens + taken
            if tokens == window:
                yield held, True
                held, tokens = [], 0
    if held:
        yield held, False


def powers(pieces: list) -> Iterator[tuple[list, bool]]:
    """One remainder as windows whose lengths are the powers of two in its length, largest first."""
    left = sum(len(p[2]) for p in pieces)
    while left:
        size = 1 << left.bit_length() - 1
        made = run_together(pieces, size)
        yield next(made)[0], True
        pieces = [p for rest, _ in made for p in rest]
        left -= size


def _rows(windows: Iterator[tuple[list, bool]], round_: int, part: int) -> Iterator[tuple]:
    """Sequence ids: round, task and number in the task, side by side."""
    for number, (pieces, full) in enumerate(windows):
        sequence, offset = round_ << 59 | part << 28 | number, 0
        for doc_id, start, ids, total in pieces:
            raw = ids.tobytes()
            yield doc_id, start, len(ids), raw, zlib.crc32(raw), total, sequence, offset, part, full
            offset += len(ids)


def pack(docs: DataFrame, *, tokenizer: str, window: int = 2048, open_windows: int = 32, end_id: int = 1,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of documents and their places: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that drops white space.  ``ids`` are little-endian
    unsigned 32-bit numbers and ``ids_crc32`` their checksum.  Every id of every document is in exactly
    one piece; ``start`` counts the document's ids before it and ``doc_tokens`` includes ``end_id``.

    A null or empty text is the single id ``end_id``.  A null id is kept.  Each of several equal rows or
    rows of one id is packed on its own.  Longer documents are cut to whole windows.  An empty table gives
    no rows.  Other columns, whatever their names, are not read.
    """
    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = word_tokenizer(tokenizer), Windows(window, open_windows)
        end = np.array([end_id], "<u4")

        def made() -> Iterator[tuple[list, bool]]:
            for batch in source:
                for some in slices(batch, size=SLICE):
                    for doc_id, ids in zip(some["doc_id"].to_pylist(), words.encode(some["text"])):
                        for full in windows.add(doc_id, np.concatenate([ids, end])):
                            yield full, True
                free()
            yield from windows.merge()

        yield from batches(_rows(made(), 0, TaskContext.get().partitionId()), PIECES, most_bytes=WRITTEN, weight=lambda r: 4 * r[2])

    named = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    # Written once: the remainders and the full windows must come from the same run of each task.
    placed = materialise(named.mapInArrow(freeing(place), DDL))
    done, open_ = [placed.where("full")], placed.where("not full")
    tasks = (placed.agg(F.max("part")).first()[0] or 0) + 1
    round_ = 0
    while True:
        round_ += 1
        tasks = -(-tasks // MERGED)
        merged = materialise(_merge(open_, window, round_, last=tasks == 1))
        done.append(merged.where("full"))
        open_ = merged.where("not full")
        if tasks == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "full")


def _merge(open_: DataFrame, window: int, round_: int, last: bool) -> DataFrame:
    """Run the remainders of each ``MERGED`` tasks together: at most so many windows in a group."""
    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "sequence_id", "offset"], kind="stable")
        ids = [np.frombuffer(raw, "<u4") for raw in frame.ids]
        doc_ids = [None if pd.isna(d) else int(d) for d in frame.doc_id]
        pieces = list(zip(doc_ids, frame.start.tolist(), ids, frame.doc_tokens.tolist()))

        def made() -> Iterator[tuple[list, bool]]:
            for pieces_, full in run_together(pieces, window):
                if full or not last:
                    yield pieces_, full
                else:
                    yield from powers(pieces_)

        table = pa.Table.from_batches(batches(_rows(made(), round_, int(key[0])), PIECES), PIECES)
        return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return (open_.groupBy(F.expr(f"part div {MERGED}").alias("group"))
            .applyInPandas(merge, DDL))
