"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

One pass over the texts finds where word n-grams of test items occur and keeps those passages, with
enough words on both sides for the longest item.  Counted over all documents, an n-gram is a seed of its
item when it is rare, or the rarest of some window of the item: no item, and no stretch of it, is
without seeds however often it leaked.  A passage is aligned with every item of which it has a seed, and
with every item of which it has ``SEVERAL`` different n-grams, rare or not: where many copies were edited
alike, what they still share with their item is not rare.

The test items are taken in blocks of at most ``BLOCK_WORDS`` words, one pass each, so what workers hold
has a bound for any benchmark.  Nothing is shuffled but seed counts and the best alignments.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmtrace.llm.common import batches, factorised, freeing, materialise, own, slices

BLOCK_WORDS = 500_000
NGRAM = 4
# An n-gram in at most this share of the documents is rare.
RARE = 1e-4
# Of so many neighbouring n-grams of an item the rarest is a seed in any case.
WINDOW = 8
SEVERAL = 3
MATCH, MISS, GAP = 2, -1, -1
# Punctuation at the ends of words does not count.
MARKS = " .,;:!?\"'()[]{}<>|*#&$%-_/\\"
FOUND = "doc_id bigint, text_hash bigint, item_id bigint, score double, matched int, first_word bigint, words bigint, passage string"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of all words without marks: hashes, codes, where each text begins, and the different words."""
    first, codes, seen = factorised(texts)
    bare = pc.utf8_trim(seen, characters=MARKS)
    hashes = pd.util.hash_array(bare.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    kept = (pc.utf8_length(bare).to_numpy(zero_copy_only=False) > 0)[codes]
    return hashes[codes[kept]], codes[kept], np.concatenate([[0], np.cumsum(kept)])[first], bare


def _ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words that begin at each word; only those that fit."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ (hashes[k:k + len(out)] * _MIX[k])) * _MIX[-1 - k]
    return out ^ (out >> np.uint64(29))


@dataclass
class Items:
    """A block of test items: their words as hashes, and which n-grams belong to which."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray            # sorted, different
    of: list[list[int]]          # items of each n-gram
    n: int
    reach: int                   # words on either side of a hit

    @staticmethod
    def of_texts(ids: list[int], texts: list[str], n: int) -> Items:
        hashes, _, first, _ = _word_hashes(pa.array(texts, pa.string()))
        words = [hashes[a:b] for a, b in zip(first, first[1:])]
        owners: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            for gram in dict.fromkeys(_ngrams(w, n).tolist()):
                owners[gram].append(k)
        grams = np.array(sorted(owners), np.uint64)
        return Items(ids, words, grams, [owners[g] for g in grams.tolist()], n, max([2, *map(len, words)]) * 3 // 2)

    def seeds(self, seen_in: np.ndarray, documents: int) -> dict[int, list[int]]:
        """The items that each n-gram (by its place in ``grams``) is a seed of."""
        out: dict[int, set[int]] = defaultdict(set)
        for k, w in enumerate(self.words):
            place = np.searchsorted(self.grams, _ngrams(w, self.n))
            often = seen_in[place]
            for p in place[often <= max(1.0, RARE * documents)].tolist():
                out[p].add(k)
            for at in range(max(1, len(place) - WINDOW + 1) if len(place) else 0):
                out[int(place[at + int(often[at:at + WINDOW].argmin())])].add(k)
        return {p: sorted(k) for p, k in out.items()}


def _passages(docs: DataFrame, items, n: int) -> DataFrame:
    """doc_id, text_hash, first_word, words (their hashes), text, hits (n-gram, place): stretches around n-grams of items."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first_word", pa.int64()),
                        ("words", pa.binary()), ("text", pa.string()), ("grams", pa.list_(pa.int32())),
                        ("places", pa.list_(pa.int32()))])

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        maybe = np.zeros(1 << 22, bool)
        maybe[block.grams >> np.uint64(42)] = True

        def rows() -> Iterator[tuple]:
            for batch in source:
                for some in slices(batch):
                    yield from _around(some, block, maybe)

        yield from batches(rows(), schema, weight=lambda r: len(r[3]) + len(r[4]))

    def _around(some: pa.RecordBatch, block: Items, maybe: np.ndarray) -> Iterator[tuple]:
        hashes, codes, first, bare = _word_hashes(some["text"])
        grams = _ngrams(hashes, n)
        at = np.nonzero(maybe[grams >> np.uint64(42)])[0]
        place = np.minimum(np.searchsorted(block.grams, grams[at]), max(len(block.grams) - 1, 0))
        text = np.searchsorted(first, at, "right") - 1
        same = (block.grams[place] == grams[at]) & (at + n <= first[text + 1]) if len(at) else np.zeros(0, bool)
        at, place, text = at[same], place[same], text[same]
        cuts = np.nonzero((np.diff(text) != 0) | (np.diff(at) > 2 * block.reach))[0] + 1
        for hits in np.split(np.arange(len(at)), cuts):
            if len(hits):
                t = int(text[hits[0]])
                begin = max(int(first[t]), int(at[hits[0]]) - block.reach)
                end = min(int(first[t + 1]), int(at[hits[-1]]) + n + block.reach)
                words = " ".join(bare.take(pa.array(codes[begin:end])).to_pylist())
                yield (some["doc_id"][t].as_py(), some["text_hash"][t].as_py(), begin - int(first[t]),
                       hashes[begin:end].tobytes(), words, place[hits].tolist(), (at[hits] - begin).tolist())

    return docs.mapInArrow(freeing(find), "doc_id bigint, text_hash bigint, first_word bigint, words binary, text string, "
                                          "grams array<int>, places array<int>")


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and the place behind its last word in the passage."""
    slope = -GAP * np.arange(len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = above[:-1] + np.where(passage == word, MATCH, MISS)
        row = np.maximum(np.maximum(row, above + GAP), 0)
        above = np.maximum.accumulate(row + slope) - slope
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


def _aligned(passages: DataFrame, shared) -> DataFrame:
    """The alignments of passages with the items of their seeds."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                        ("matched", pa.int32()), ("first_word", pa.int64()), ("words", pa.int64()), ("passage", pa.string())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seeds, least = shared.value
        known: dict[tuple, tuple] = {}

        def one(raw: bytes, grams: list[int], places: list[int]) -> tuple:
            """Per item: place, score, begin and end; copies of a passage are aligned once."""
            near: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for gram, place in zip(grams, places):
                for k in block.of[gram]:
                    near[k].append((place, gram))
            words, out = np.frombuffer(raw, np.uint64), []
            for k, hits in near.items():
                item = block.words[k]
                reach = len(item) * 3 // 2
                at = np.array([place for place, _ in hits])
                # Hits far apart are aligned apart: the longest alignment reaches no further.
                for group in np.split(np.arange(len(at)), np.nonzero(np.diff(at) > 2 * reach)[0] + 1):
                    own = {hits[h][1] for h in group}
                    if len(own) < SEVERAL and not any(k in seeds.get(gram, ()) for gram in own):
                        continue
                    low, high = max(0, int(at[group[0]]) - reach), int(at[group[-1]]) + block.n + reach
                    score, end = align(words[low:high], item)
                    if score >= least * MATCH * len(item):
                        _, back = align(words[low:low + end][::-1], item[::-1])
                        out.append((k, score / (MATCH * len(item)), low + end - back, low + end))
            return tuple(out)

        def rows() -> Iterator[tuple]:
            for batch in source:
                for r in batch.to_pylist():
                    key = r["words"], tuple(r["grams"])
                    if key not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[key] = one(r["words"], r["grams"], r["places"])
                    found = known[key]
                    if found:
                        words = r["text"].split(" ")
                        for k, score, begin, end in found:
                            matched = int(np.isin(np.frombuffer(r["words"], np.uint64)[begin:end], block.words[k]).sum())
                            yield (r["doc_id"], r["text_hash"], block.ids[k], score, matched, r["first_word"] + begin,
                                   end - begin, " ".join(words[begin:end]))

        yield from batches(rows(), schema, weight=lambda r: len(r[7]))

    return passages.mapInArrow(freeing(run), FOUND)


def _blocks(benchmark: DataFrame, most_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks; the driver holds one block at a time."""
    held, size = [], 0
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for item_id, text in items.orderBy("item_id", "text").toLocalIterator():
        words = len(text.split())
        if held and size + words > most_words:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += words
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5, n: int = NGRAM,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text_hash, item_id, score, matched, first_word, words, passage: which items leaked into which documents.

    ``score`` is the best local alignment of the item with a passage of the document, over the score of
    the item with itself; rows have at least ``least``.  Words are in lower case without marks at their
    ends.  ``passage`` is the aligned stretch, ``words`` its length, ``first_word`` how many words are
    before it, ``matched`` how many of them the item has.  One row for each document row and item: its best
    alignment, of equal ones the first.

    Null and empty texts and items match nothing, as do items shorter than ``n`` words.  A null doc_id is
    an id like any other; rows with equal id and text give one row.  Empty tables give no rows.  Of other
    columns none is read.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    total = docs.count()
    out = None
    for block in _blocks(benchmark, block_words):
        items = Items.of_texts([i for i, _ in block], [t for _, t in block], n)
        if not len(items.grams):
            continue
        passages = materialise(_passages(read, spark.sparkContext.broadcast(items), n))
        seen = np.zeros(len(items.grams))
        # One number for each n-gram of the block.
        for row in (passages.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").count().toLocalIterator()):
            seen[row["gram"]] = row["count"]
        found = _aligned(passages, spark.sparkContext.broadcast((items, items.seeds(seen, total), least)))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], FOUND)
    best = F.max_by(F.struct("score", "matched", "first_word", "words", "passage"), F.struct("score", -F.col("first_word")))
    return out.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best")).select("doc_id", "text_hash", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, with all their columns as they are."""
    leaked, hash_ = own(docs) + "leaked", own(docs) + "hash"
    found = leaks(docs, benchmark, **options).select(F.col("doc_id").alias(leaked), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(found, F.col("doc_id").cast("bigint").eqNullSafe(F.col(leaked)) & (F.xxhash64("text") == F.col(hash_)), "left_anti")
