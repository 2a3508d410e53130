"""Scores of texts by a probabilistic suffix tree over words.

The tree starts from smoothed word probabilities.  A context, of up to ``depth`` words and of rare words too, is
tried when it is there at least twice, and kept where the words behind it differ enough from those behind its own
suffix: their divergence, in bits over all its occurrences, must pay for the node.  A kept context has the next words
that follow it at least twice, and whose own occurrences could pay for them, and gives the rest of its probability to
its suffix, so every context's probabilities add up to one.  A word is scored in the longest kept context that ends before it.

The tree is made level by level, one pass over the texts each; ``depth`` is the memory of the tree and bounds the
passes, whatever repeats in the texts.  A next word goes on to longer contexts while the bits that it still costs could
pay for it there: a longer context saves at most these, so none is missed.  Tasks add up sequences of words and send them as sorted, compressed runs to the partition of
their context, where they are merged.  Nothing is cut by shares of the text: what is kept grows with it.

What a sequence adds to a score, as a context and as a word in its context, does not depend on what else is in the
text.  Workers hold the most frequent sequences; of the others those that a bitmap does not rule out meet the scored
texts by a join, as do words outside the ``most_words`` most frequent.  Rare words and sequences are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from warmtrace.llm.common import factorised, freeing, materialise, own, slices
from warmtrace.llm.lookup import Lookup, Words, mixed

ADDED = 0.1          # to every word's count
DISCOUNT = 0.5       # from every listed next word's count
OTHER = 1 << 62      # in the place of a next word: one that is listed nowhere
SIEVE_BITS = 27      # at most, of the bitmap that tells which keys a table surely has not
HELD = 400_000     # sequences that a task adds up before it sends them
BLOCK = 3 << 19      # bytes of text that a worker has as arrays at a time
PARTS = 4            # partitions of contexts for each of Spark's shuffle partitions
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Model:
    """``words`` are the frequent ones in the order of their numbers; the last number is the end of a text.

    ``keys`` has the names of frequent sequences, and ``values`` what they add to a score, in log10;
    ``rest`` has those of all others as a table key, value, and ``sieve`` a bitmap of its keys.
    """

    words: Words
    counts: np.ndarray
    tokens: int
    different: int
    keys: Lookup
    values: np.ndarray
    longest: int = 0                                # words of the longest sequence
    sieve: np.ndarray | None = None
    rest: DataFrame | None = None

    @property
    def size(self) -> int:
        return len(self.counts)

    @property
    def total(self) -> float:
        return self.tokens + ADDED * (self.different + 1)


def _ids_of(words: Words, seen: pa.Array) -> np.ndarray:
    """Numbers of words, hashes under -1 for other words than the frequent ones."""
    number, hashes = words.numbers(seen)
    return np.where(number >= 0, number, -2 - (hashes >> np.uint64(2)).view(np.int64))


def _joined(names: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit names of sequences, each made longer by a word."""
    return mixed(names.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(words.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))).view(np.int64)


def _numbered(texts: pa.Array, words: Words, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Numbers of all tokens with the end after each text, hashes under -1 for other words; where texts begin; and the words."""
    first, codes, seen = factorised(texts)
    number = _ids_of(words, seen)
    begins = first + np.arange(len(first))
    out = np.full(begins[-1], end, np.int64)
    at = np.ones(len(out), bool)
    at[begins[1:] - 1] = False
    out[at] = number[codes]
    return out, begins, first, codes, seen


def _behind(numbers: np.ndarray, begins: np.ndarray, steps: int) -> np.ndarray:
    """The number ``steps`` tokens earlier in the same text, else -1."""
    out = np.full(len(numbers), -1, np.int64)
    if steps < len(numbers):
        out[steps:] = numbers[:-steps]
    for k in range(steps):
        at = begins[:-1] + k
        out[at[at < begins[1:]]] = -1
    return out


def _written(df: DataFrame) -> DataFrame:
    """The table of ``materialise``; what was shuffled for it goes with the write, and does not lie beside the next level's."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return materialise(df)
    finally:
        conf.set(CLEANUP, before)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), n: every word of every text, added up in the tasks first."""
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in source:
            for some in slices(batch, size=BLOCK):
                _, codes, seen = factorised(some["text"])
                n = np.bincount(codes, minlength=len(seen))
                kept = np.nonzero(n)[0]
                held.append(pa.table({"word": pc.take(seen, pa.array(kept)).cast(pa.binary()), "n": pa.array(n[kept])}))
                if sum(map(len, held)) > 500_000:
                    yield from _added(held)
                    held = []
        if held:
            yield from _added(held)

    def _added(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_tables(tables).combine_chunks().group_by("word").aggregate([("n", "sum")])
        yield from whole.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(max_chunksize=50_000)

    return texts.mapInArrow(freeing(count), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> int:
    """The lowest count such that at most ``most`` words have it or more, by classes of counts."""
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("class")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    chosen, seen = 1 << 62, 0
    for row in sorted(steps.collect(), key=lambda r: -r["class"]):
        seen += row["words"]
        if seen > most:
            break
        chosen = row["least"]
    return chosen


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bitmap of at most ``SIEVE_BITS`` with two bits for each ``key``: where one is not set, the key is not there."""
    bits = min(SIEVE_BITS, max(12, keys.count().bit_length() + 4))
    at = F.explode(F.array(F.col("key"), F.shiftright("key", 32))).alias("key")
    low = keys.select(at).select(F.col("key").bitwiseAND((1 << bits) - 1).alias("low"))
    words = low.groupBy(F.shiftright("low", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(low & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


def _passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for low in (keys, keys >> 32):
        low = low & (len(sieve) * 64 - 1)
        out &= (sieve[low >> 6] >> (low & 63) & 1).astype(bool)
    return out


def _ids(texts: DataFrame, shared) -> DataFrame:
    """ids, sizes, tokens: the numbers and hashes of the words and ends of some texts, compressed, and how many each has."""
    def number(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in source:
            for some in slices(batch, size=BLOCK):
                ids, begins, *_ = _numbered(some["text"], model.words, model.size - 1)
                yield pa.RecordBatch.from_arrays([pa.array([pa.compress(ids.tobytes(), "zstd", asbytes=True)], pa.binary()),
                    pa.array([np.diff(begins)], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64())], names=["ids", "sizes", "tokens"])

    return texts.mapInArrow(freeing(number), "ids binary, sizes array<bigint>, tokens bigint")


def _names(ids: np.ndarray, begins: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For lengths 1 to ``most``: the name of the sequence of so many words that ends at each token, and whether its text has it."""
    name, there = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    for k in range(most):
        word = _behind(ids, begins, k) if k else ids
        there = there & (word != -1)
        name = _joined(name, word)
        yield name, there


def _runs(ids: DataFrame, length: int, sieve, parts: int) -> DataFrame:
    """part, run, rows: contexts of ``length`` words with each next word and how often, in compressed runs.

    Without contexts whose suffix the sieve rules out; next words that it rules out behind the suffix are ``OTHER``.
    """
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in source:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                flat = np.frombuffer(pa.decompress(row["ids"], 8 * row["tokens"], "zstd"), np.int64)
                begins = np.cumsum([0, *row["sizes"]])
                words = [_behind(flat, begins, k) for k in range(length, 0, -1)] + [flat]
                there = words[0] != -1
                if length > 1:
                    *_, (suffix, _), (under, _) = _names(flat, begins, length)
                    there[1:] &= _passes(sieve.value, suffix[:-1])
                    words[-1] = np.where(_passes(sieve.value, under), flat, OTHER)
                held.append(np.stack([*[w[there] for w in words], np.ones(there.sum(), np.int64)]))
                if sum(x.shape[1] for x in held) > HELD:
                    held = [_added(np.concatenate(held, axis=1))]
                    if held[0].shape[1] > HELD // 2:
                        yield from _sent(held.pop(), parts)
        if held:
            yield from _sent(_added(np.concatenate(held, axis=1)), parts)

    return ids.mapInArrow(freeing(count), "part int, run binary, rows bigint")


def _chain(words: np.ndarray) -> np.ndarray:
    """Names of sequences given as rows, the first word first."""
    name = np.zeros(words.shape[1], np.int64)
    for word in words[::-1]:
        name = _joined(name, word)
    return name


def _added(rows: np.ndarray) -> np.ndarray:
    """Equal sequences once, by their names, their counts in the last row added up."""
    if not rows.shape[1]:
        return rows
    name = _chain(rows[:-1])
    order = np.argsort(name)
    name = name[order]
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    out = rows[:, order[first]]
    out[-1] = np.add.reduceat(rows[-1, order], first)
    return out


def _sent(rows: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """One compressed block for each partition of contexts, ordered by the first words."""
    part = (_chain(rows[:-2]).view(np.uint64) % np.uint64(parts)).astype(np.uint16)
    order = np.argsort(rows[0])
    order = order[np.argsort(part[order], kind="stable")]
    part, rows = part[order], rows[:, order]
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
    for at in range(0, len(cuts) - 1, 64):
        some = list(zip(cuts[at:at + 64].tolist(), cuts[at + 1:at + 65].tolist()))
        yield pa.RecordBatch.from_arrays([
            pa.array([int(part[a]) for a, _ in some], pa.int32()),
            pa.array([pa.compress(np.ascontiguousarray(rows[:, a:b]).tobytes(), "zstd", asbytes=True) for a, b in some], pa.binary()),
            pa.array([b - a for a, b in some], pa.int64())], names=["part", "run", "rows"])


def _merged(source: Iterator[pa.RecordBatch], length: int, most: np.ndarray) -> Iterator[pa.RecordBatch]:
    """context, pair, under, n, total: next words seen twice or more of every context of the partitions, by names.

    ``pair`` names the context with its next word, ``under`` the same without the first word; ``total`` counts the context.
    ``most`` has the share of the price that one occurrence of each frequent word could pay, if known.
    """
    names = ["context", "pair", "under", "n", "total"]

    def ended(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = _added(np.concatenate(held, axis=1))
        context = _chain(rows[:-2])
        order = np.argsort(context)
        rows, context = rows[:, order], context[order]
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        total = np.repeat(np.add.reduceat(rows[-1], first), np.diff(np.append(first, rows.shape[1])))
        listed = (rows[-1] > 1) & (rows[-2] != OTHER)
        if len(most):
            number = rows[-2]
            listed &= (number < 0) | (rows[-1] * most[np.clip(number, 0, len(most) - 1)] > 1 - 1e-9)
        rows, total, context = rows[:, listed], total[listed], context[listed]
        made = context, _chain(rows[:-1]), _chain(rows[1:-1]), rows[-1], total
        for at in range(0, len(total), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at:at + 50_000]) for x in made], names=names)

    part, held = None, []
    for batch in source:
        for at in range(len(batch)):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["part"] != part and held:
                yield from ended(held)
                held = []
            part = row["part"]
            raw = pa.decompress(row["run"], 8 * (length + 2) * row["rows"], "zstd")
            held.append(np.frombuffer(raw, np.int64).reshape(length + 2, -1))
            if len(held) > 1 and sum(x.shape[1] for x in held[1:]) > HELD:
                held = [_added(np.concatenate(held, axis=1))]
    if held:
        yield from ended(held)


def _base(counts: DataFrame, shared, ends: int) -> DataFrame:
    """pair, p: the smoothed probability of each word, and of the end, by name."""
    def number(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = _ids_of(shared.value.words, batch["word"])
            yield pa.RecordBatch.from_arrays([pa.array(_chain(ids[None])), batch["n"]], names=["pair", "n"])

    model = shared.value
    end = int(_chain(np.array([[model.size - 1]]))[0])
    ended = counts.sparkSession.createDataFrame([(end, ends)], "pair bigint, n bigint")
    return counts.mapInArrow(number, "pair bigint, n bigint").unionByName(ended).select(
        "pair", ((F.col("n") + F.lit(ADDED)) / F.lit(model.total)).alias("p"))


def learn(training: DataFrame, *, most_words: int = 200_000, share: float = 1e-6, depth: int = 3, price: float = 2.0) -> tuple[Model, DataFrame]:
    """The model, and the table word, n of all words of ``training.text``.

    A context of up to ``depth`` words is kept when its divergence from its suffix, times its occurrences, is over
    ``price`` times the bits of the token count for each listed next word.  ``most_words`` and ``share`` (of all tokens)
    bound what the workers hold, not what is counted and kept: the most frequent sequences, as many as could have that share each.
    """
    spark = training.sparkSession
    texts = training.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = _written(word_counts(texts))
    ends = texts.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, different = total[0] + ends, total[1] + (ends > 0)
    least = _most_frequent(counts, most_words)
    frequent = [(bytes(r["word"]), r["n"]) for r in counts.where(F.col("n") >= least).collect()]
    frequent.sort(key=lambda r: (-r[1], r[0]))
    model = Model(Words.of([w for w, _ in frequent]), np.array([n for _, n in frequent] + [ends], np.int64),
                  tokens, different, Lookup.of(np.zeros(0, np.int64)), np.zeros(0))
    shared = spark.sparkContext.broadcast(model)
    ids = _written(_ids(texts, shared))
    parts = min(1 << 16, PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = price * float(np.log2(max(tokens, 2)))
    before, sieve, found, longest = _base(counts, shared, ends), None, [], 0
    for length in range(1, depth + 1):
        runs = _runs(ids, length, sieve, parts).repartition("part").sortWithinPartitions("part")
        # Of a single word's suffix, the empty one, the workers know the frequent words' probabilities.
        most = -np.log2((model.counts + ADDED) / model.total) / bits if length == 1 else np.zeros(0)
        merged = runs.mapInArrow(freeing(lambda source, length=length, most=most: _merged(source, length, most)), "context bigint, pair bigint, under bigint, n bigint, total bigint")
        level = _written(_level(merged, before, bits))
        found.append(level.where("kept"))
        some = level.agg(F.count_if("kept"), F.count_if("longer")).first()
        longest = length + 1 if some[0] else longest
        if not some[1] or length == depth:
            break
        before = level.where("longer").select("pair", "p")
        if sieve is not None:
            sieve.destroy()
        sieve = spark.sparkContext.broadcast(_sieve(before.select(F.col("pair").alias("key")).unionByName(
            level.where("longer").select(F.col("context").alias("key")).distinct())))
    every = None
    for level in found:
        values = level.where("first").select(F.col("context").alias("key"), F.log10("left").alias("value"), F.col("total").alias("times")).unionByName(
            level.select(F.col("pair").alias("key"), (F.log10(F.col("p") / F.col("suffix_p")) - F.log10("left")).alias("value"), F.col("n").alias("times")))
        every = values if every is None else every.unionByName(values)
    # A sequence can be there twice, as a context and as a word in its context: one value.
    every = _written(every.groupBy("key").agg(F.sum("value").alias("value"), F.max("times").alias("times")))
    # Of each length no more than 1 / share sequences can have that share: so many are held, also where few have it.
    often = F.col("times") >= _most_frequent(every.select(F.col("times").alias("n")), int((depth + 1) / share))
    held = every.where(often).select("key", "value").sort("key").toArrow()
    keys, values = held["key"].to_numpy(), held["value"].to_numpy()
    del held
    rest = every.where(~often).select("key", "value")
    if sieve is not None:
        sieve.destroy()
    shared.destroy()
    return replace(model, keys=Lookup.of(keys), values=values, longest=longest, sieve=_sieve(rest), rest=rest), counts


def _level(found: DataFrame, before: DataFrame, bits: float) -> DataFrame:
    """Contexts of one length with their listed next words and probabilities, whether a context is kept, and whether a next
    word could pay in a longer one; ``first`` marks one row of each context.  ``before`` has the probabilities of one word less."""
    of = Window.partitionBy("context")
    total, n = F.col("total"), F.col("n")
    listed = (found.join(before.select(F.col("pair").alias("under"), F.col("p").alias("suffix_p")), "under").drop("under")
              .where(-n * F.log2("suffix_p") > F.lit(bits)))
    listed = listed.withColumns({"times": F.sum("n").over(of), "words": F.count("*").over(of), "first": F.row_number().over(of.orderBy("pair")) == 1})
    listed = listed.withColumn("left", F.greatest(1 - (F.col("times") - F.lit(DISCOUNT) * F.col("words")) / total, F.lit(1e-9)))
    listed = listed.withColumn("own", (n - F.lit(DISCOUNT)) / total + F.col("left") * F.col("suffix_p"))
    listed = listed.withColumn("saved", F.sum(n * F.log2(F.col("own") / F.col("suffix_p"))).over(of))
    gain = F.col("saved") + (total - F.col("times")) * F.log2("left")
    listed = listed.withColumn("kept", gain > F.lit(bits) * F.col("words"))
    listed = listed.withColumn("p", F.when(F.col("kept"), F.col("own")).otherwise(F.col("suffix_p")))
    listed = listed.withColumn("longer", -n * F.log2("p") > F.lit(bits))
    return listed.where("kept or longer").select("context", "pair", "n", "total", "left", "suffix_p", "p", "kept", "longer", "first")


def _values(model: Model, numbers: np.ndarray, begins: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """What held sequences add to each token; and for each length texts, names that ``rest`` may have, and how often."""
    out, asked = np.zeros(len(numbers)), []
    for name, there in _names(numbers, begins, model.longest):
        place = model.keys.find(name)
        held = there & (place >= 0)
        out[held] += model.values[place[held]]
        open_ = there & ~held
        open_[open_] = _passes(model.sieve, name[open_])
        keys, of = name[open_], text[open_]
        order = np.lexsort((keys, of))
        keys, of = keys[order], of[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]))
        asked.append((of[first], keys[first], np.diff(np.append(first, len(keys)))))
    return out, asked


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` adds log10((c + 0.1) / (N + 0.1 * (V + 1))) over the words and the end of a text,
    ``score`` the log10 probabilities in the longest kept contexts.  A null text is an empty one: its end
    alone.  With nothing learned every token has the same share.  Each row, of repeated ones too, is scored on its own;
    an empty table gives no rows.  Columns of these names are replaced.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in [*made, "text"]]
    row_, known_, base_, gain_, word_, times_, key_, more_, added_ = (
        own(docs) + n for n in ("row", "known", "base", "gain", "word", "times", "key", "more", "added"))
    names = [*kept, row_, "n_tokens", "n_known", base_, gain_, word_, times_, key_]
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    plain = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows of rare words, and of keys that the table of contexts may have, have nulls in the other columns.
    schema = (StructType([StructField(f.name, f.dataType) for f in docs.select(*kept).schema]).add(row_, "long").add("n_tokens", "long").add("n_known", "long")
              .add(base_, "double").add(gain_, "double").add(word_, "binary").add(times_, "long").add(key_, "long"))

    def scored(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in source:
            for some in slices(batch, size=BLOCK):
                yield from _scored(some, shared.value, row)
                row += len(some)

    def _scored(some: pa.RecordBatch, model: Model, row: int) -> Iterator[pa.RecordBatch]:
        numbers, begins, first, codes, seen = _numbered(some["text"], model.words, model.size - 1)
        texts = len(some)
        text = np.repeat(np.arange(texts), np.diff(begins))
        known = numbers >= 0
        logs = np.where(known, np.log10(model.counts[np.maximum(numbers, 0)] + ADDED), 0.0) - np.log10(model.total)
        n_known = known & (model.counts[np.maximum(numbers, 0)] > 0)
        rows = pa.array(row + np.arange(texts))
        none = pa.nulls(texts, pa.int64())
        gains, asked = _values(model, numbers, begins, text)
        yield pa.RecordBatch.from_arrays(
            [*some.columns[:-1], rows, pa.array(np.diff(begins)),
             pa.array(np.bincount(text, n_known, texts).astype(np.int64)), pa.array(np.bincount(text, logs, texts)),
             pa.array(np.bincount(text, gains, texts)), pa.nulls(texts, pa.binary()), none, none],
            names=names)
        # Rare words: one row for each text and word.
        at = np.ones(len(numbers), bool)
        at[begins[1:] - 1] = False
        rare = numbers[at] < 0
        pair, times = np.unique(text[at][rare] * len(seen) + codes[rare], return_counts=True)
        for begin in range(0, len(pair), 50_000):
            of, word = pair[begin:begin + 50_000] // len(seen), pair[begin:begin + 50_000] % len(seen)
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(len(of), some.schema.field(c).type) for c in kept], pa.array(row + of),
                 *[pa.nulls(len(of), pa.int64())] * 2, *[pa.nulls(len(of), pa.float64())] * 2,
                 pc.take(seen, pa.array(word)).cast(pa.binary()), pa.array(times[begin:begin + 50_000]), pa.nulls(len(of), pa.int64())],
                names=names)
        # Sequences that the workers do not hold: one row for each text and name.
        for of, key, times in asked:
            for begin in range(0, len(of), 50_000):
                some_of = of[begin:begin + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(len(some_of), some.schema.field(c).type) for c in kept], pa.array(row + some_of),
                     *[pa.nulls(len(some_of), pa.int64())] * 2, *[pa.nulls(len(some_of), pa.float64())] * 2, pa.nulls(len(some_of), pa.binary()),
                     pa.array(times[begin:begin + 50_000]), pa.array(key[begin:begin + 50_000])], names=names)

    rows = _written(plain.mapInArrow(freeing(scored), schema))
    rare = rows.where(F.col(word_).isNotNull()).select(row_, F.col(word_).alias("word"), times_)
    seldom = counts.where(F.col("n") <= (int(model.counts[:-1].min()) if model.size > 1 else 1 << 62))
    met = rare.join(seldom, "word", "left").select(row_, times_, F.coalesce("n", F.lit(0)).alias("n"))
    more = met.groupBy(row_).agg(
        F.sum(F.when(F.col("n") > 0, F.col(times_)).otherwise(0)).alias(known_),
        F.sum(F.col(times_) * F.log10(F.col("n") + F.lit(ADDED))).alias(more_))
    found = rows.where(F.col(key_).isNotNull()).select(row_, F.col(key_).alias("key"), times_)
    added = found.join(model.rest, "key").groupBy(row_).agg(F.sum(F.col(times_) * F.col("value")).alias(added_))
    base = F.col(base_) + F.coalesce(more_, F.lit(0.0))
    whole = rows.where(F.col(word_).isNull() & F.col(key_).isNull()).join(more, row_, "left").join(added, row_, "left")
    return whole.select(
        *kept, "n_tokens", (F.col("n_known") + F.coalesce(known_, F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"),
        (base + F.col(gain_) + F.coalesce(added_, F.lit(0.0))).alias("score"))
