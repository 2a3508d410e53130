"""The prefix trie of conversations: one node for every different sequence of first turns.

Conversations are sequences of turn ids, 128-bit hashes of role and text.  Spark deals them by ranges of (sequence,
conversation) and sorts each range.  A range is taken in blocks: a padded matrix of turn ids, ordered by numpy's
lexsort; the rows where a column changes, or one before it did, start a node of that depth, and ``reduceat`` sums up the
rows of every node at every depth.

A node that holds the first or last row of its block may go on in another block.  Of such nodes a block hands on two
rows with what it knows of each depth, and these are dealt, sorted and summed up in the same way until one block is
left: every round has thousands of times fewer rows.  A block is bounded by rows and cells, whatever the ranges are;
a first turn or a whole sequence that most conversations share is spread over as many blocks as it fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmtrace.llm.common import materialise

ID = 16                      # bytes of a turn id
# Rows and matrix cells of a block; a block of longer sequences than these cells allow has a few rows nevertheless.
ROWS, CELLS, FEW = 16_384, 2_000_000, 64
PIECE = 65_536               # conversation ids in one piece of a list
NONE = hashlib.sha256(b"").hexdigest()
FIRST = np.iinfo(np.int64).max

NODE = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_key", pa.binary()),
                  ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                  ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
HELD = ("n", "least", "children", "leaves", "saved")
EDGE = pa.schema([("path", pa.binary()), ("words", pa.list_(pa.int32())), *[(c, pa.list_(pa.int64())) for c in HELD]])
PART = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
ROW = pa.schema([("node", pa.struct(NODE)), ("edge", pa.struct(EDGE)), ("part", pa.struct(PART))])
EDGE_DDL = "path binary, words array<int>, " + ", ".join(f"{c} array<bigint>" for c in HELD)
ROW_DDL = ("node struct<key binary, conv_id bigint, depth bigint, parent_key binary, parent_conv_id bigint, n_convs bigint, "
           "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string>, "
           "edge struct<" + EDGE_DDL.replace(" binary", ": binary").replace(" array", ": array") + ">, "
           "part struct<key: binary, first: bigint, ids: string>")


def sequences(conversations: DataFrame, *also: str) -> DataFrame:
    """conv_id, the columns ``also``, turns array<struct<turn, id, words>>: every conversation's turns in order.

    Turns are ordered by ``turn``, null first, equal ones by their ids.  ``id`` is a hash (32 hex digits) of role and
    text, null ones being empty; ``words`` counts the words ``[^\\x20\\x09-\\x0D]+`` of the text.  Rows without a
    ``conv_id`` are no conversation.  ``also`` are columns that depend on ``conv_id`` alone, the first of which deals
    out the rows.  Other columns are not read; an empty table gives no rows.  One conversation's ids are one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID).alias("id"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), *also, turn.alias("t"))
    rows = rows.repartition(F.col(also[0])) if also else rows
    return rows.groupBy(*also, "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


@dataclass
class Depth:
    """The nodes of one depth in a block, in order."""

    start: np.ndarray        # their first rows
    edge: np.ndarray         # whether they may go on outside the block
    held: dict[str, np.ndarray]
    words: np.ndarray        # of their last texts


def matrix(paths: list[bytes], words: list, cells: dict[str, list] | None, conv_ids: np.ndarray | None):
    """A block of rows in order: padded codes of turn ids, 0 for none; lengths, words, cells, and the order."""
    lengths = np.fromiter(map(len, paths), np.int64, len(paths)) // ID
    parts = np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((parts[:, 1], parts[:, 0]))
    new = np.ones(len(parts), bool)
    new[1:] = (parts[order][1:] != parts[order][:-1]).any(1)
    code = np.empty(len(parts), np.int32)
    code[order] = np.cumsum(new)
    deep = int(lengths.max(initial=0))
    at = np.repeat(np.arange(len(paths)), lengths), np.arange(len(parts)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes, count = np.zeros((len(paths), deep), np.int32), np.zeros((len(paths), deep), np.int32)
    codes[at] = code
    count[at] = np.concatenate([np.asarray(w, np.int32) for w in words]) if len(parts) else 0
    least = conv_ids if cells is None else np.zeros(len(paths), np.int64)
    order = np.lexsort((least, *codes.T[::-1]))
    if cells is None:
        one, zero = (np.broadcast_to(np.int64(x), (len(paths), deep + 1)) for x in (1, 0))
        held = {"n": one, "least": np.broadcast_to(conv_ids[order, None], one.shape), "children": zero, "leaves": zero, "saved": zero}
    else:
        held = {}
        for name in HELD:
            held[name] = np.zeros((len(paths), deep + 1), np.int64)
            for row, k in enumerate(order):
                held[name][row, :lengths[k] + 1] = cells[name][k]
    return codes[order], lengths[order], count[order], held, order


def depths(codes: np.ndarray, lengths: np.ndarray, words: np.ndarray, held: dict[str, np.ndarray], whole: bool) -> list[Depth]:
    """The nodes of an ordered block by depth, with the sums over their rows."""
    rows, deep = codes.shape
    out, changed = [], np.zeros(rows, bool)
    changed[0] = True
    for d in range(deep + 1):
        if d:
            changed[1:] |= codes[1:, d - 1] != codes[:-1, d - 1]
        there = np.flatnonzero(lengths >= d)
        first = np.flatnonzero(changed[there])
        start, last = there[first], there[np.append(first[1:], len(there)) - 1]
        sums = {c: (np.minimum if c == "least" else np.add).reduceat(held[c][there, d], first) for c in HELD}
        edge = ((start == 0) | (last == rows - 1)) & (not whole)
        out.append(Depth(start, edge, sums, words[start, d - 1] if d else np.zeros(len(start), np.int32)))
    return out


def totals(found: list[Depth]) -> None:
    """Adds to every node what the whole nodes below it have; a node that may go on keeps its own share back."""
    for d in range(len(found) - 1, -1, -1):
        here = found[d].held
        if d + 1 < len(found):
            below = found[d + 1]
            whole = ~below.edge
            parent = np.searchsorted(found[d].start, below.start[whole], "right") - 1
            np.add.at(here["children"], parent, 1)
            for c in ("leaves", "saved"):
                np.add.at(here[c], parent, below.held[c][whole])
        whole = ~found[d].edge
        here["leaves"][whole] += here["children"][whole] == 0
        here["saved"][whole] += (here["n"][whole] - 1) * found[d].words[whole]


def _keys(path: bytes) -> list[bytes]:
    """Names of all prefixes of a sequence."""
    name = hashlib.sha256()
    out = [name.digest()[:ID]]
    for at in range(0, len(path), ID):
        name.update(path[at:at + ID])
        out.append(name.digest()[:ID])
    return out


def block(paths: list[bytes], words: list, cells: dict[str, list] | None = None, conv_ids: np.ndarray | None = None,
          whole: bool = False) -> tuple[pa.Table, pa.Table, pa.Table]:
    """Whole nodes, rows for the next round and lists of conversations of nodes that may go on.

    Rows of the first round have ``conv_ids``, later ones ``cells``; ``whole`` marks the only block of a round.
    """
    codes, lengths, count, held, order = matrix(paths, words, cells, conv_ids)
    found = depths(codes, lengths, count, held, whole)
    totals(found)
    ends, parts = {}, []
    if cells is None:
        # Conversations that end at a node are its first rows.
        stop = np.flatnonzero(np.append((np.diff(lengths) != 0) | (codes[1:] != codes[:-1]).any(1), True)) + 1
        for begin, end in zip(np.append(0, stop[:-1]).tolist(), stop.tolist()):
            ends[begin, int(lengths[begin])] = conv_ids[order[begin:end]].tolist()
    keys = {row: _keys(paths[order[row]]) for row in ([0, len(paths) - 1] if cells is None else range(len(paths)))}
    last = len(paths) - 1
    nodes = []
    for d, level in enumerate(found):
        keep = np.flatnonzero(~level.edge)
        for row in level.start[level.edge].tolist():
            if (row, d) in ends:
                ids = ends[row, d]
                at_key = keys[0 if row == 0 else last][d]
                parts += [(at_key, ids[k], ",".join(map(str, ids[k:k + PIECE]))) for k in range(0, len(ids), PIECE)]
        if not len(keep):
            continue
        start = level.start[keep]
        if d:
            above = found[d - 1]
            parent = np.searchsorted(above.start, start, "right") - 1
            row_of = above.start[parent]
            open_ = above.edge[parent]
            # A parent that goes on holds the first or the last row.
            parent_key = [(keys[0 if r == 0 else last][d - 1]) if o else None for r, o in zip(row_of.tolist(), open_.tolist())]
            parent_conv = pa.array(above.held["least"][parent], mask=open_)
        else:
            parent_key, parent_conv = [None], pa.array([None], pa.int64())
        digest = [hashlib.sha256(",".join(map(str, ends[s, d])).encode()).hexdigest() if (s, d) in ends else NONE for s in start.tolist()]
        nodes.append(pa.table([pa.array([keys[s][d] if cells is not None else None for s in start.tolist()], pa.binary()),
            pa.array(level.held["least"][keep]), pa.array(np.full(len(keep), d)), pa.array(parent_key, pa.binary()), parent_conv,
            *[pa.array(level.held[c][keep]) for c in ("n", "children", "leaves", "saved")], pa.array(digest)], schema=NODE))
    edges = []
    if not whole:
        for row in dict.fromkeys([0, last]):
            made = {c: [] for c in HELD}
            for d in range(int(lengths[row]) + 1):
                at = 0 if row == 0 else len(found[d].start) - 1
                mine = row == 0 or found[d].start[at] != 0
                for c in HELD:
                    made[c].append(int(found[d].held[c][at]) if mine else FIRST if c == "least" else 0)
            edges.append({"path": paths[order[row]], "words": list(words[order[row]]), **made})
    return (pa.concat_tables(nodes) if nodes else NODE.empty_table(), pa.Table.from_pylist(edges, EDGE),
            pa.Table.from_pylist([dict(zip(PART.names, p)) for p in parts], PART))


def _rows(tables: tuple[pa.Table, pa.Table, pa.Table]) -> Iterator[pa.RecordBatch]:
    for which, table in enumerate(tables):
        for batch in table.combine_chunks().to_batches(max_chunksize=10_000):
            columns = [pa.nulls(len(batch), f.type) for f in ROW]
            columns[which] = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays(columns, schema=ROW)


def _blocks(source: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[dict]]:
    held, deepest = [], 0
    for batch in source:
        for at in range(0, len(batch), 1024):
            for row in batch.slice(at, 1024).to_pylist():
                deep = max(deepest, len(row["path"]) // ID + 1)
                if held and (len(held) >= rows or len(held) >= min(rows, FEW) and deep * (len(held) + 1) > CELLS):
                    yield held
                    held, deep = [], len(row["path"]) // ID + 1
                held.append(row)
                deepest = deep
    if held:
        yield held


def _reduced(rows: int, whole: bool, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def reduce(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last round's rows are bounded by the caller and are one block.
        for held in _blocks(source, FIRST if whole else rows):
            paths, words = [r["path"] for r in held], [r["words"] for r in held]
            if first:
                made = block(paths, words, conv_ids=np.array([r["conv_id"] for r in held], np.int64))
            else:
                made = block(paths, words, {c: [r[c] for r in held] for c in HELD}, whole=whole)
            yield from _rows(made)

    return reduce


def _hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 from the pieces of each list, in order; one piece is in memory at a time."""
    key, name, done = None, None, []
    for batch in source:
        for at in range(0, len(batch), 16):
            for row in batch.slice(at, 16).to_pylist():
                if row["key"] != key:
                    if name is not None:
                        done.append((key, name.hexdigest()))
                    key, name = row["key"], hashlib.sha256()
                else:
                    name.update(b",")
                name.update(row["ids"].encode())
    if name is not None:
        done.append((key, name.hexdigest()))
    for at in range(0, len(done), 10_000):
        some = done[at:at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.binary()), pa.array([d for _, d in some])],
                                         names=["key", "ends_sha256"])


def trie(convs: DataFrame, *, rows: int = ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node.

    ``convs`` has conv_id and turns, an array of structs with ``id`` (32 hex digits) and ``words``; no column may be
    null, and a conv_id is there once.  ``conv_id`` is a node's smallest member, ``parent_conv_id`` that of its parent (null for the root), ``n_leaves``
    counts the childless nodes of its subtree and ``saved_tokens`` sums (members - 1) x words of the last text over it;
    ``ends_sha256`` is of the decimal ids of the members that end there, ascending, comma-joined.  Conversations without
    turns end at the root; an empty table has no nodes.  ``rows`` bounds the rows of a block.
    """
    ids = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    plain = materialise(convs.select("conv_id", F.unhex(ids).alias("path"), F.transform("turns", lambda t: t["words"].cast("int")).alias("words")))
    dealt = plain.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    made = [materialise(dealt.mapInArrow(_reduced(rows, False, True), ROW_DDL))]
    while True:
        edges = made[-1].where("edge is not null").select("edge.*")
        size = edges.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("n")), F.lit(0)).alias("deep")).first()
        if size["n"] == 0:
            break
        last = size["n"] <= max(rows, FEW) and size["n"] * size["deep"] <= CELLS or size["n"] <= FEW
        dealt = edges.coalesce(1) if last else edges.repartitionByRange(-(-size["n"] // rows) + 1, "path").sortWithinPartitions("path")
        made.append(materialise(dealt.mapInArrow(_reduced(rows, last, False), ROW_DDL)))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    late = None
    for round_ in made[1:]:
        nodes = round_.where("node is not null").select("node.*")
        late = nodes if late is None else late.unionByName(nodes)
    early = made[0].where("node is not null").select("node.*")
    if late is None:
        return early.select(*out)
    parts = made[0].where("part is not null").select("part.*").repartition("key").sortWithinPartitions("key", "first")
    lists = parts.mapInArrow(_hashed, "key binary, ends_sha256 string")
    late = materialise(late.drop("ends_sha256").join(lists, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE))))
    every = early.unionByName(late)
    parents = late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    joined = every.where("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("found"))
    return every.where("parent_key is null").select(*out).unionByName(joined.select(*out))
