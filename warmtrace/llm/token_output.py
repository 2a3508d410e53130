"""Token ids as fixed-width matrices: best-fit-decreasing packing and what a trainer reads with it.

Every task gathers documents up to ``block_tokens`` tokens, cuts overlong ones into whole windows and a
rest, and places the rests from long to short, each into the window with the least room that still holds
it.  The windows of a block are found through a segment tree over their free room: one descent for each
piece.  Blocks are independent, so nothing is shuffled and a lost task repeats only its own blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmtrace.llm.common import batches, slices
from warmtrace.llm.tokens import word_tokenizer

ROWS = pa.schema([("sequence_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
                  ("cu_seqlens", pa.list_(pa.int32())), ("tokens", pa.int32()), ("input_ids", pa.binary()),
                  ("position_ids", pa.binary())])
DDL = ("sequence_id bigint, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, tokens int, "
       "input_ids binary, position_ids binary")


class Rooms:
    """A segment tree over the free room 0..window: how many windows have it.  ``fit`` finds the least room that holds a length."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, which: int) -> None:
        self.windows[room].append(which)
        self._change(room, 1)

    def fit(self, length: int) -> tuple[int, int] | None:
        """Take out a window with the least room of at least ``length``: (room, window)."""
        at = self.leaves + length
        while not self.count[at]:
            while at & 1:          # a right child: its parent's right neighbour comes next
                at >>= 1
                if at == 0:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._change(room, -1)
        return room, self.windows[room].pop()

    def _change(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """The window of each piece and how many windows there are; lengths are 1 to ``window``."""
    rooms, out, made = Rooms(window), np.empty(len(lengths), np.int64), 0
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        found = rooms.fit(length)
        room, which = found if found else (window, made)
        made += found is None
        out[piece] = which
        if room > length:
            rooms.put(room - length, which)
    return out, made


def pack_block(docs: list[tuple], window: int, pad_id: int, kind: str) -> Iterator[tuple]:
    """The windows of a block of (doc_id, ids): doc_ids, starts, cu_seqlens, tokens, input_ids, position_ids."""
    pieces = [(doc_id, at, ids[at:at + window]) for doc_id, ids in docs for at in range(0, len(ids), window)]
    place, made = best_fit_decreasing(np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces)), window)
    order = np.argsort(place, kind="stable")
    for own in np.split(order, np.searchsorted(place[order], np.arange(1, made))) if made else []:
        mine = [pieces[k] for k in own]
        sizes = np.array([len(p[2]) for p in mine])
        ends = np.cumsum(sizes)
        row = np.full(window, pad_id, kind)
        row[:ends[-1]] = np.concatenate([p[2] for p in mine])
        position = np.zeros(window, "<u4")
        # Positions start again with every piece; a later piece of a document starts again too.
        position[:ends[-1]] = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        yield ([p[0] for p in mine], [p[1] for p in mine], [0, *ends.tolist()], int(ends[-1]), row.tobytes(), position.tobytes())


def matrices(docs: DataFrame, *, tokenizer: str, window: int = 2048, end_id: int = 1, pad_id: int = 0,
             kind: str = "<u2", block_tokens: int = 4_000_000) -> DataFrame:
    """One row a window: sequence_id, doc_ids, starts, cu_seqlens, tokens, input_ids, position_ids.

    ``input_ids`` is a row of the id matrix in numbers of ``kind`` (``<u2`` or ``<u4``), padded with
    ``pad_id`` behind ``tokens``; ``cu_seqlens`` are the piece borders from 0 to ``tokens``;
    ``position_ids`` (``<u4``) counts from 0 in every piece; piece ``i`` holds the ids of document
    ``doc_ids[i]`` from its ``starts[i]``-th on.  ``matrix`` reads the ids back, without loss.

    A null or empty text is ``end_id`` alone; every text ends with it.  Rows of a null or repeated id are
    documents of their own.  A task holds one block, or one document if it is longer.  An empty table
    gives no rows.  Only doc_id and text are read.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_tokenizer(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")

        def blocks() -> Iterator[list[tuple]]:
            held, size = [], 0
            for batch in source:
                for some in slices(batch):
                    for doc_id, ids in zip(some["doc_id"].to_pylist(), words.encode(some["text"])):
                        if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                            raise ValueError(f"an id does not fit {kind}")
                        held.append((doc_id, np.concatenate([ids, end]).astype(kind)))
                        size += len(ids) + 1
                        if size >= block_tokens:
                            yield held
                            held, size = [], 0
            if held:
                yield held

        rows = (row for block in blocks() for row in pack_block(block, window, pad_id, kind))
        yield from batches(((part << 33 | n, *row) for n, row in enumerate(rows)), ROWS, weight=lambda r: 8 * window)

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, DDL)


def write(rows: DataFrame, path: str) -> None:
    """Write windows as Parquet; one file a task, ready to be read as matrices."""
    rows.write.option("compression", "zstd").parquet(path)


def matrix(rows: list, column: str, kind: str) -> np.ndarray:
    """Windows that were read back, as a matrix: one row each."""
    return np.stack([np.frombuffer(bytes(r[column]), kind) for r in rows])


