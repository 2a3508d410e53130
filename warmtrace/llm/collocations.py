"""Phrases whose words are together more often than chance has it, mined by a trie of hash containers.

A task counts the phrases of one to three words in a trie over word numbers.  The trie is shallow: its leaves are hash
containers, each for a range of prefixes.  A container that grows too large bursts into two, between two first words
or else between two second words of one.  A trie that grows too large spills its largest containers, which are whole
subtrees, as runs sorted by words.  A run is cut by its phrases' first two words into prefix partitions, each one row of
compressed text; Spark brings the rows of a partition together and a task merges them, one partition after the other.
So a frequent first word is spread over many tasks, and a phrase arrives once from each spill, however often it is there.

Phrases seen ``least`` times or more are a table; what scores and drops them are joins of that table with itself, whose
keys are met once on one side.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warmtrace.llm.common import batches, materialise, slices

BITS = 21                    # of a word's number in a packed phrase; 0 is no word
BURST = 32_768               # different phrases in a container
HELD = 1_200_000             # different phrases in all tries of a task
WORDS = 1 << 18              # words with a number; then all is spilled and numbers begin anew
CLASS = np.zeros(256, np.uint8)          # 0 part of a word, 1 blank, 2 border of pieces
CLASS[[0x20, 0x09]] = 1
CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
MERGED = 2_000_000           # rows of a prefix partition that are added up at once
PARTS = 8                    # prefix partitions for each of Spark's shuffle partitions
RUN = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary()), ("size", pa.int64()), ("rows", pa.int64())])
RUN_DDL = "part int, lang string, phrases binary, counts binary, size bigint, rows bigint"
COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


class HatTrie:
    """Counts of packed phrases: three numbers of ``BITS`` bits, the first word highest, 0 behind a phrase's end."""

    def __init__(self, burst: int = BURST):
        self.burst, self.size = burst, 0
        self.lows, self.containers = [0], [{}]   # a container has the keys from its low on to the next one's

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Different keys in order, and how often."""
        cuts = np.append(np.searchsorted(keys, np.array(self.lows, np.int64)), len(keys)).tolist()
        keys, counts = keys.tolist(), counts.tolist()
        full = []
        for k, (begin, end) in enumerate(zip(cuts, cuts[1:])):
            if begin == end:
                continue
            container = self.containers[k]
            before, get = len(container), container.get
            for key, n in zip(keys[begin:end], counts[begin:end]):
                container[key] = get(key, 0) + n
            self.size += len(container) - before
            if len(container) > self.burst:
                full.append(self.lows[k])
        for low in full:
            self._burst(bisect.bisect_left(self.lows, low))

    def _burst(self, k: int) -> None:
        pending = [k]
        while pending:
            k = pending.pop()
            container, low = self.containers[k], self.lows[k]
            if len(container) <= self.burst:
                continue
            keys = np.sort(np.fromiter(container, np.int64, len(container)))
            for level in (2 * BITS, BITS):
                # The border between two prefixes that is nearest to the middle.
                new = np.flatnonzero(keys[1:] >> level != keys[:-1] >> level) + 1
                if len(new):
                    at = new[np.abs(new - len(keys) // 2).argmin()]
                    cut = int(keys[at] >> level << level)
                    break
            else:
                continue   # one prefix of two words: the trie ends here
            upper = {key: container.pop(key) for key in keys[at:].tolist()}
            self.lows.insert(k + 1, cut)
            self.containers.insert(k + 1, upper)
            pending = [p + (p > k) for p in pending] + [k + 1, k]

    def spill(self, most: int) -> np.ndarray:
        """Takes out the largest containers until ``most`` phrases are left: keys and counts, as two rows."""
        taken = []
        for k in sorted(range(len(self.containers)), key=lambda k: -len(self.containers[k])):
            if self.size <= most:
                break
            container = self.containers[k]
            taken.append(np.array([list(container), list(container.values())], np.int64))
            self.size -= len(container)
            self.containers[k] = {}
        return np.concatenate(taken, axis=1) if taken else np.zeros((2, 0), np.int64)


def words_in_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """All words in order as codes, the different words, where each text begins, and whether a word begins a piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kind = CLASS[raw]
    word = kind == 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]
    start[begins] = word[begins]
    at = np.flatnonzero(start)
    length = np.cumsum(word)
    offsets = np.append(length[at] - 1, length[-1] if len(length) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(LOWER[raw[word]]))
    coded = words.dictionary_encode()
    first = np.searchsorted(at, ends)
    borders = np.cumsum(kind == 2)[at]
    new = np.ones(len(at), bool)
    new[1:] = borders[1:] != borders[:-1]
    new[first[:-1][first[:-1] < len(at)]] = True
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, first, new


class Counter:
    """The tries of a task, one for each language, over the same words."""

    def __init__(self, burst: int, held: int, most_words: int, parts: int):
        self.burst, self.held, self.most_words, self.parts = burst, held, most_words, parts
        self.tries: dict[str, HatTrie] = {}
        self.numbers: dict[str, int] = {}
        self.total: dict[str, int] = {}

    def add(self, langs: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        coded = langs.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        codes, seen, first, new = words_in_pieces(texts.take(pa.array(order)))
        if len(self.numbers) + len(seen) > max(WORDS, len(seen)):
            yield from self.spilled(0)
            self.numbers = {}
        numbers = self.numbers
        ids = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in seen.to_pylist()), np.int64, len(seen))[codes]
        inside = ~new
        names, borders = coded.dictionary.to_pylist(), np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        for lang, a, b in zip(names, first[borders[:-1]].tolist(), first[borders[1:]].tolist()):
            self.total[lang] = self.total.get(lang, 0) + b - a
            trie = self.tries.setdefault(lang, HatTrie(self.burst))
            keys = ids[a:b] << 2 * BITS
            goes_on = np.ones(b - a, bool)
            for k in range(self.most_words):
                if k:
                    goes_on = goes_on[:-1] & inside[a + k:b]
                    keys = keys[:-1] | ids[a + k:b] << BITS * (2 - k)
                trie.add(*np.unique(keys[goes_on], return_counts=True))
        if sum(t.size for t in self.tries.values()) > self.held:
            yield from self.spilled(self.held // 2)

    def spilled(self, most: int) -> Iterator[pa.RecordBatch]:
        """The largest subtrees of all languages as sorted runs; all of them for 0."""
        total = max(1, sum(t.size for t in self.tries.values()))
        words = None
        for lang, trie in self.tries.items():
            keys, counts = trie.spill(most * trie.size // total)
            if len(keys):
                words = pa.array(self.numbers, pa.string()) if words is None else words
                yield from _run(lang, keys, counts, words, self.parts)
        if not most:
            self.tries = {}

    def ended(self) -> Iterator[pa.RecordBatch]:
        yield from self.spilled(0)
        for lang, n in self.total.items():
            yield from _rows(lang, pa.array([""]), np.array([n]), np.zeros(1, np.uint16))


def _run(lang: str, keys: np.ndarray, counts: np.ndarray, words: pa.Array, parts: int) -> Iterator[pa.RecordBatch]:
    """Packed phrases by prefix partition, in the order of their words."""
    import xxhash

    mask = (1 << BITS) - 1
    split = [keys >> 2 * BITS, keys >> BITS & mask, keys & mask]
    there = np.zeros(len(words) + 1, bool)
    for w in split:
        there[w] = True
    used = np.flatnonzero(there[1:]) + 1
    some = words.take(pa.array(used - 1))
    order = pc.sort_indices(some).to_numpy()
    rank = np.zeros(len(words) + 1, np.int64)
    rank[used[order]] = np.arange(1, len(used) + 1)
    some = pa.concat_arrays([pa.array([None], pa.string()), some.take(pa.array(order))])
    names = np.fromiter((xxhash.xxh64_intdigest(w or "") >> 2 for w in some.to_pylist()), np.int64, len(some))
    ranks = rank[split[0]] << 2 * BITS | rank[split[1]] << BITS | rank[split[2]]
    order = np.argsort(ranks)
    ranks = ranks[order]
    first, second = ranks >> 2 * BITS, ranks >> BITS & mask
    part = ((names[first] ^ np.where(second > 0, names[second] >> 1, 0)) % parts).astype(np.uint16)
    dealt = np.argsort(part, kind="stable")
    ranks, part = ranks[dealt], part[dealt]
    phrases = pc.binary_join_element_wise(*[some.take(pa.array(r)) for r in (ranks >> 2 * BITS, ranks >> BITS & mask, ranks & mask)],
                                          " ", null_handling="skip")
    yield from _rows(lang, phrases, counts[order[dealt]], part)


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each partition: its phrases, a line each, and their counts, both compressed."""
    lines = pc.binary_join_element_wise(phrases, "", "\n").cast(pa.large_string())
    ends = np.frombuffer(lines.buffers()[1], np.int64)[:len(lines) + 1]
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    rows = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        text = lines.buffers()[2].slice(int(ends[a]), int(ends[b] - ends[a]))
        rows.append((int(part[a]), lang, pa.compress(text, "zstd", asbytes=True),
                     pa.compress(counts[a:b].astype("<i8").tobytes(), "zstd", asbytes=True), text.size, b - a))
    yield from batches(iter(rows), RUN, weight=lambda r: len(r[2]))


def _opened(row: dict) -> pa.Table:
    """phrase, n of one row of a run."""
    raw = np.frombuffer(pa.decompress(row["phrases"], row["size"], "zstd"), np.uint8)
    line = raw == 10
    ends = np.flatnonzero(line)
    offsets = np.append(0, ends - np.arange(len(ends))).astype(np.int64)
    phrases = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw[~line]))
    return pa.table({"phrase": phrases, "n": np.frombuffer(pa.decompress(row["counts"], 8 * row["rows"], "zstd"), "<i8")})


def _merged(source: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The counts of every partition and language, whose rows come one behind the other."""
    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("phrase").aggregate([("n", "sum")]).rename_columns(["phrase", "n"])

    def ended(key, held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        whole = added(held) if held else pa.table({"phrase": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})
        whole = whole.filter(pc.or_(pc.greater_equal(whole["n"], least), pc.equal(whole["phrase"], "")))
        for some in whole.to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(some), pa.string()), some["phrase"].cast(pa.string()), some["n"]], schema=COUNT)

    key, held, rows = None, [], 0
    for batch in source:
        for at in range(len(batch)):
            row = batch.slice(at, 1).to_pylist()[0]
            if (row["part"], row["lang"]) != key:
                yield from ended(key, held)
                key, held, rows = (row["part"], row["lang"]), [], 0
            held.append(_opened(row))
            rows += len(held[-1])
            if rows > MERGED:
                held = [added(held)]
                # What is different stays; the next time is when as much again has come.
                rows = 0
    yield from ended(key, held)


def phrase_counts(docs: DataFrame, *, least: int = 1, most_words: int = 3, burst: int = BURST, held: int = HELD,
                  text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, phrase, n: phrases of up to ``most_words`` (2 or 3) words within pieces, A-Z in lower case, with ``n`` of ``least``
    or more; and for each language that has a text the empty phrase, whose n counts all words.

    Pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+``.  A null text is empty, a null language ``und``.
    """
    if most_words not in (2, 3):
        raise ValueError("most_words is 2 or 3")

    spark = docs.sparkSession
    parts = min(1 << 16, PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(burst, held, most_words, parts)
        for batch in source:
            for some in slices(batch, size=1 << 20):
                yield from counter.add(some["lang"], some["text"])
        yield from counter.ended()

    plain = docs.select(F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    runs = plain.mapInArrow(count, RUN_DDL).repartition("part").sortWithinPartitions("part", "lang")
    return runs.mapInArrow(lambda source: _merged(source, least), "lang string, phrase string, n bigint")


def collocations(docs: DataFrame, *, least: int = 10, share: int = 50, top: int = 2000, most_words: int = 3, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two words or more.

    A phrase is there ``a`` times, ``least`` at least.  Cut after its first words, these are there ``l`` times and the
    others ``r`` times, and the cut scores floor(1000000 a a / (l r)), in exact arithmetic; the lowest cut counts, of equal
    ones the earliest.  A phrase goes when its words are inside a longer one that is there at least ``share`` per cent
    as often, whether that one goes or not.  The order is by score and ``a``, high ones first, then by the bytes of the phrase.

    Null texts are empty, a null language is ``und``; rows of equal texts all count; an empty table gives no rows.  Columns
    of other names are not read.  The options are those of ``phrase_counts``.
    """
    counts = materialise(phrase_counts(docs, least=least, most_words=most_words, **options))
    size = F.size(F.split("phrase", " "))
    several = counts.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("n").alias("a"), size.alias("size"))
    inner = several.where("size > 2").select("lang", "a", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = several.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    cuts = (kept.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")}))
    side = counts.where("phrase != ''")
    cuts = (cuts.join(side.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
            .join(side.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]))
    big = {c: f"cast({c} as decimal(16, 0))" for c in "alr"}
    cuts = cuts.withColumn("score", F.expr(f"(1000000 * ({big['a']} * {big['a']})) div ({big['l']} * {big['r']})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    first = best.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    words = counts.where("phrase = ''").select("lang", "n")
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
