"""Near-duplicates by SimHash: fingerprints, links within a Hamming radius, and classes of linked documents.

Links are found by the general pigeonhole principle.  The 64 bits are grouped into partitions, bits
that go together in one partition; partition ``i`` gets a threshold ``t_i >= -1`` with
``sum(t_i) = radius - partitions + 1``.  Two fingerprints within the radius then agree in some
partition up to ``t_i`` bits.  The thresholds are those with the fewest expected candidates, by
dynamic programming on counts over all fingerprints.  A fingerprint is found under its bits of a
partition and probes all values within the threshold.

A bucket of many fingerprints would give the square of its size in candidates.  Members of such
buckets meet in a second way, exact and linear: two fingerprints are within the radius when balls of
half the radius around them share a point, so each is listed at the points of its ball, and a point
has at most as many members as a ball has points.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmtrace.llm.common import freeing, materialise, own, slices
from warmtrace.llm.components import components

BITS = 64
# Buckets of more different fingerprints than this go the second way.
CROWD = 64


def fingerprints(docs: DataFrame, *, words: int = 3, seed: int = 42, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, fingerprint (bigint): one row for each row of ``docs``.

    A-Z in lower case; words are ``[^\\x20\\x09-\\x0D]+``; shingles of ``words`` words, repeats
    included, joined by one space; XXH64 of their UTF-8.  A bit is 1 if it is set in over half of the
    hashes.  A text with fewer words is one shingle; null text and text without words give 0.
    """
    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for some in slices(batch):
                made = [_signed(_fingerprint(w, words, seed)) for w in _words(some["text"])]
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["text_hash"], pa.array(made, pa.int64())],
                                                 names=["doc_id", "text_hash", "fingerprint"])

    named = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"),
                        F.col(text_column).alias("text"))
    return named.mapInArrow(freeing(hashed), "doc_id bigint, text_hash bigint, fingerprint bigint")


def _words(texts: pa.Array) -> Iterator[list[bytes]]:
    for text in texts.cast(pa.large_binary()).to_pylist():
        yield (text or b"").lower().split()


def _fingerprint(words: list[bytes], n: int, seed: int) -> int:
    import xxhash

    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(text, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1)
    begins = (ends - size - 1)[:len(words) - n + 1].tolist()
    ends = (ends - 1)[n - 1:].tolist()
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), 1 << 16):
        some = zip(begins[at:at + (1 << 16)], ends[at:at + (1 << 16)])
        h = np.array([digest(text[b:e], seed) for b, e in some], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(begins), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bit_counts(prints: DataFrame) -> np.ndarray:
    """How many of all fingerprints have bits i and j set: 64 x 64 numbers, added up in the tasks."""
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BITS, BITS))
        for batch in source:
            x = batch["fingerprint"].to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(x), 1 << 14):
                bits = np.unpackbits(x[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1,
                                     bitorder="little").astype(np.float32)
                sums += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(sums.ravel())], names=["at", "n"])

    rows = prints.mapInArrow(freeing(count), "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for row in rows:
        out[row["at"]] = row["n"]
    return out.reshape(BITS, BITS)


def correlated_groups(counts: np.ndarray, total: int, partitions: int) -> list[list[int]]:
    """The bits in groups of about equal size, each grown around a bit by the strongest correlations."""
    p = np.diag(counts) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(counts / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    left, groups = list(range(BITS)), []
    for k in range(partitions):
        size = BITS * (k + 1) // partitions - BITS * k // partitions
        group = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (strength[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def thresholds(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """The cheapest ``t_i`` with ``sum(t_i) = radius - len(costs) + 1``; ``costs[i][t + 1]`` is the cost of ``t``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (paid, chosen) in best.items():
            for t in range(-1, radius + 1):
                option = paid + cost[t + 1], [*chosen, t]
                if used + t + 1 not in after or option < after[used + t + 1]:
                    after[used + t + 1] = option
        best = after
    return best[radius + 1]


def plan(prints: DataFrame, radius: int, most_partitions: int = 4) -> list[tuple[list[int], int]]:
    """Groups of bits with a threshold of 0 or more, chosen for all fingerprints of ``prints``."""
    total = prints.count()
    counts = bit_counts(prints)
    p = np.diag(counts) / max(total, 1)
    differ = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)   # odds that two differ in a bit
    layouts = {m: correlated_groups(counts, total, m) for m in range(1, most_partitions + 1) if m <= radius + 2}
    parts = [(m, i, bits) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    # Pairs that agree in a group, counted over everything: the squares of its value counts.
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"),
                                          F.col("fingerprint").bitwiseAND(F.lit(_mask(bits))).alias("v"))
                                 for m, i, bits in parts]))
    alike = {(r["m"], r["i"]): r["n"] for r in prints.select(values.alias("x")).select("x.*").groupBy("m", "i", "v")
             .agg(F.count("*").cast("double").alias("n")).groupBy("m", "i")
             .agg(F.sum(F.col("n") * F.col("n") - F.col("n")).alias("n")).collect()}
    best = None
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            cost, pairs, probes, odds = [0.0], 0.0, 0, 1.0
            for t in range(radius + 1):
                # Elementary symmetric sums would be exact for independent bits; powers bound them.
                odds = 1.0 if t == 0 else odds * differ[bits].sum() / t
                pairs += alike.get((m, i), 0.0) * odds
                probes += comb(len(bits), t)
                cost.append(pairs + 4.0 * total * probes)
            costs.append(cost)
        price, chosen = thresholds(costs, radius)
        if best is None or price < best[0]:
            best = price, [(bits, t) for bits, t in zip(groups, chosen) if t >= 0]
    return best[1]


def _flips(bits, most: int) -> list[int]:
    return [_mask(c) for k in range(most + 1) for c in combinations(bits, k)]


def _probes(part: int, bits: list[int], most: int) -> Column:
    """The values of a group of bits within ``most`` flips of a fingerprint's own."""
    own = F.col("fingerprint").bitwiseAND(F.lit(_mask(bits)))
    return F.transform(F.array(*[F.lit(f) for f in _flips(bits, most)]), lambda f: F.struct(
        F.lit(part).alias("part"), own.bitwiseXOR(f).alias("value"), (f == 0).alias("own")))


def links(prints: DataFrame, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """a, b: links between different fingerprints of ``prints`` (column ``fingerprint``, no repeats).

    Every pair within ``radius`` bits is joined by a chain of these links, and every link is such a
    pair.  Outside crowded buckets every pair is listed.
    """
    prints = prints.select("fingerprint")
    groups = plan(prints, radius)
    fp = F.col("fingerprint")
    probes = F.concat(*[_probes(i, bits, t) for i, (bits, t) in enumerate(groups)])
    members = materialise(prints.select("fingerprint", F.explode(probes).alias("x")).select("fingerprint", "x.*"))
    sizes = members.groupBy("part", "value").agg(F.count("*").alias("n"), F.bool_or("own").alias("owned")).where("n > 1 and owned")
    found = members.join(sizes.select("part", "value", "n"), ["part", "value"])
    few = (found.where(F.col("n") <= crowd).groupBy("part", "value")
           .agg(F.collect_list(F.when(F.col("own"), fp)).alias("own"), F.collect_list(fp).alias("all")))
    near = (few.select(F.explode("own").alias("a"), "all")
            .select("a", F.explode(F.filter("all", lambda x: (x != F.col("a")) & (_distance(x, F.col("a")) <= radius))).alias("b")))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    dense = found.where(F.col("n") > crowd).select("fingerprint").distinct()
    balls = dense.select(fp, F.explode(F.transform(
        F.array(*[F.lit(f) for f in _flips(range(BITS), radius // 2)]), lambda f: fp.bitwiseXOR(f))).alias("point"))
    least = balls.groupBy("point").agg(F.min("fingerprint").alias("a"), F.collect_list("fingerprint").alias("all")).where(F.size("all") > 1)
    star = least.select("a", F.explode("all").alias("b")).where("a != b").distinct()
    return near.unionByName(star)


def classes(docs: DataFrame, *, radius: int = 2, words: int = 3, seed: int = 42, crowd: int = CROWD,
            id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, fingerprint, class (a fingerprint), component_id: one row for each row of ``docs``."""
    if radius % 2:
        raise ValueError("radius must be even: the balls of the second way have half of it")
    marked = materialise(fingerprints(docs, words=words, seed=seed, id_column=id_column, text_column=text_column))
    prints = materialise(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(prints, radius, crowd))
    rooted = materialise(prints.join(roots, prints["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("class")))
    least = rooted.groupBy("class").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "class").select("fingerprint", "class", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "text_hash", "fingerprint", "class", "component_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (bigint), component_id: the smallest doc_id reached over links, itself included.

    One row for each row of ``docs``.  Fingerprints link at ``radius`` (even) or fewer differing bits; the
    fingerprint 0 of null and empty texts links like any other.  Rows of one id are nodes of their own and
    share what they reach.  A null id keeps its row and lends no id; a class of null ids only has a null
    component.  An empty table gives no rows.  Other columns, whatever their names, are not read.
    The options are those of ``classes``.
    """
    return classes(docs, **options).select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest id stays.

    Of several texts with that id one stays, the same one at every run, and of several rows of one id
    and text any one.  A class without ids keeps one of its texts.  All columns come back as they are;
    an empty table gives no rows.
    """
    id_, text_, kept_id, kept_text = (own(docs) + n for n in ("id", "text", "kept_id", "kept_text"))
    found = classes(docs, id_column=id_column, text_column=text_column, **options)
    stays = (found.groupBy("class").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "text_hash")).alias("k"))
             .select(F.col("k.doc_id").alias(kept_id), F.col("k.text_hash").alias(kept_text)))
    marked = docs.withColumns({id_: F.col(id_column).cast("bigint"), text_: F.xxhash64(text_column)})
    kept = marked.join(stays, F.col(id_).eqNullSafe(F.col(kept_id)) & (F.col(text_) == F.col(kept_text)), "left_semi")
    return kept.dropDuplicates([id_, text_]).drop(id_, text_)
