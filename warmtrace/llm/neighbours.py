"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is split again and again until its clusters are small and of about equal size; their
centroids form a graph that every worker keeps in memory and walks from a few entries to the nearest.
Each vector is posted to its nearest list, and near a boundary to several.  A query reads the lists
whose centroid is not much farther than its nearest one.  Equal vectors are one entry with their
smallest ids, so copies cost nothing, and long lists are split into parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmtrace.llm.common import hashed_sample, materialise

# The bounds of the index: vectors that the centroids are learned from, and those of one cluster.
SAMPLE, CLUSTER = 32_768, 64
# Lists a vector is posted to at most, and how much farther than the nearest they may be.
COPIES, SPREAD = 8, 1.15
# Lists a query reads at most, how much farther they may be, and how many it reads in any case.
PROBES, REACH, LEAST = 64, 1.35, 8
# A part of a list has about so many vectors, a part of its queries so many.
PART = 4_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _split(x: np.ndarray, ways: int, seed: int) -> np.ndarray:
    """Balanced k-means: every cluster gets an equal share, the surest rows first."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), ways, replace=False)]
    most = -(-len(x) // ways)
    own = np.zeros(len(x), np.int64)
    for _ in range(6):
        near = x @ centres.T
        top = np.sort(near, axis=1)
        order, left = np.argsort(top[:, -2] - top[:, -1], kind="stable"), np.full(ways, most)
        choice = np.argsort(-near, axis=1, kind="stable")
        for row in order.tolist():
            for k in choice[row].tolist():
                if left[k]:
                    left[k] -= 1
                    own[row] = k
                    break
        centres = _unit(np.stack([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(ways)]))
    return own


def _clusters(x: np.ndarray, most: int, seed: int = 0) -> list[np.ndarray]:
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        own = _split(x[rows], min(8, -(-len(rows) // most)), seed + len(rows))
        todo += [rows[own == k] for k in range(own.max() + 1) if (own == k).any()]
    return out


@dataclass
class Centroids:
    """Unit vectors and, for each, its neighbours in the graph; ``entries`` are where a walk begins."""

    vectors: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def of_sample(sample: np.ndarray, cluster: int = CLUSTER, degree: int = 24) -> Centroids:
        x = _unit(sample.astype(np.float32))
        centres = _unit(np.stack([x[rows].mean(0) for rows in _clusters(x, cluster)]))
        links = np.empty((len(centres), min(degree, len(centres))), np.int64)
        for at in range(0, len(centres), 1024):
            near = centres[at:at + 1024] @ centres.T
            links[at:at + 1024] = np.argsort(-near, axis=1, kind="stable")[:, :links.shape[1]]
        # A few long links keep the graph in one piece.
        rng = np.random.default_rng(1)
        far = rng.integers(0, len(centres), (len(centres), min(8, len(centres))))
        return Centroids(centres, np.concatenate([links, far], 1), np.unique(rng.integers(0, len(centres), 16)))

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists nearest to each row (unit vectors) and their cosines, best first, by a walk with a beam."""
        beam = min(beam, len(self.vectors))
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), len(self.vectors)), bool)
        lists = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        seen[:, self.entries] = True
        cosines = x @ self.vectors[self.entries].T
        opened = np.zeros(lists.shape, bool)
        width = 4      # lists opened at a step
        for _ in range(len(self.vectors)):
            value = np.where(opened, -np.inf, cosines)
            pick = np.argsort(-value, axis=1, kind="stable")[:, :width]
            live = np.take_along_axis(value, pick, 1) > -np.inf
            if not live.any():
                break
            np.put_along_axis(opened, pick, True, 1)
            new = self.links[np.take_along_axis(lists, pick, 1)].reshape(len(x), -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.links.shape[1], 1)
            # The same list may be linked twice at a step: it counts once.
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, 1)
            twice = np.zeros(new.shape, bool)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            fresh &= ~twice
            seen[rows, new] = True
            found = np.where(fresh, np.einsum("nd,nkd->nk", x, self.vectors[new]), -np.inf)
            cosines = np.concatenate([cosines, found], 1)
            lists = np.concatenate([lists, new], 1)
            opened = np.concatenate([opened, ~fresh], 1)
            best = np.argsort(-cosines, axis=1, kind="stable")[:, :beam]
            lists, cosines, opened = (np.take_along_axis(a, best, 1) for a in (lists, cosines, opened))
        best = np.argsort(-cosines, axis=1, kind="stable")
        return np.take_along_axis(lists, best, 1), np.take_along_axis(cosines, best, 1)

    def chosen(self, x: np.ndarray, most: int, ratio: float, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest lists whose distance is within ``ratio`` of the nearest one's, ``least`` at least."""
        lists, cosines = self.nearest(_unit(x.astype(np.float32)), 2 * most)
        distance = np.sqrt(np.maximum(2 - 2 * cosines[:, :most].astype(np.float64), 0))
        near = (distance <= np.maximum(distance[:, :1], 1e-3) * ratio) | (np.arange(distance.shape[1]) < least)
        near &= np.isfinite(distance)
        row, at = np.nonzero(near)
        return row, lists[row, at]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), finite, of some length: not null, without null or non-finite components, not zero."""
    e = F.col("embedding")
    sound = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))


def classes(vectors: DataFrame, most_ids: int) -> DataFrame:
    """embedding, entry (its smallest id), ids (its ``most_ids`` smallest, in order): one row for each different vector."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    least = vectors.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_ids)
    return least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.get("ids", F.lit(0)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def _posted(entries: DataFrame, shared, most: int, ratio: float, least: int = 1) -> DataFrame:
    """entry, embedding, list: each entry in the lists chosen for it."""
    def post(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                x = some["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
                row, lists = shared.value.chosen(x, most, ratio, least)
                yield pa.RecordBatch.from_arrays([*some.take(pa.array(row)).columns, pa.array(lists)], names=["entry", "embedding", "list"])

    return entries.select("entry", "embedding").mapInArrow(post, "entry bigint, embedding array<double>, list bigint")


def _parts(df: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """A part of its own for each row by a hash of its entry, and a copy for each part of the other side."""
    mine = F.pmod(F.xxhash64("entry"), F.col(own)).cast("int")
    theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    return df.join(F.broadcast(sizes), "list").select("entry", "embedding", "list", mine.alias(own), theirs.alias(other))


def _compared(queries: DataFrame, postings: DataFrame, keep: int) -> DataFrame:
    """query, entry, score: in every part of a list, the ``keep`` best entries of each query."""
    def search(key: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        x, y = _matrix(q["embedding"]), _matrix(p["embedding"])
        order = np.argsort(p["entry"].to_numpy(), kind="stable")     # of equal scores the smaller id comes first
        y, entry = y[order], p["entry"].to_numpy()[order]
        length = np.sqrt((y * y).sum(1))
        out = []
        for at in range(0, len(x), 256):
            some = x[at:at + 256]
            score = (some @ y.T) / (np.sqrt((some * some).sum(1))[:, None] * length)
            best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
            out.append(pd.DataFrame({"query": np.repeat(q["entry"].to_numpy()[at:at + 256], best.shape[1]), "entry": entry[best].ravel(),
                                     "score": np.take_along_axis(score, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "entry": [], "score": []})

    keys = ["list", "posted_part", "query_part"]
    return queries.groupBy(*keys).cogroup(postings.groupBy(*keys)).applyInPandas(search, "query bigint, entry bigint, score double")


def search(vectors: DataFrame, is_query: Column, *, neighbours: int = 5, sample: int = SAMPLE, cluster: int = CLUSTER,
           probes: int = PROBES, reach: float = REACH, copies: int = COPIES, spread: float = SPREAD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found to each query by cosine, in double precision.

    Queries are the rows of ``vectors`` (vec_id, embedding) that meet ``is_query``; candidates all rows of
    other ids.  Nearest first, of equal scores the smaller id; all candidates if there are fewer.  Rows
    with a null id, and vectors that are null, empty, zero or hold a null or non-finite component, take no
    part; neither do vectors of another length than most (of equally frequent lengths the longest).
    Equal rows are one row.  Empty tables give no rows.  Centroids are learned from at most ``sample``
    different vectors, with the smallest hashes; every vector is indexed.
    """
    spark = vectors.sparkSession
    sound = usable(vectors)
    lengths = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return spark.createDataFrame([], result)
    sound = sound.where(F.size("embedding") == lengths[0]["d"])
    entries = materialise(classes(sound, neighbours + 1))
    learned = hashed_sample(entries.select("entry", "embedding"), sample, F.xxhash64("embedding")).select("embedding").toPandas()
    shared = spark.sparkContext.broadcast(Centroids.of_sample(_matrix(learned["embedding"]), cluster))
    asked = vectors.where(is_query).select("vec_id")
    asked = materialise(sound.join(asked.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct(), "vec_id", "left_semi").distinct()
                        .join(entries.select("embedding", "entry"), "embedding"))
    postings = materialise(_posted(entries, shared, copies, spread))
    queries = materialise(_posted(asked.select("entry", "embedding").dropDuplicates(["entry"]), shared, probes, reach, LEAST))
    # As many rows as there are lists, which the sample bounds.
    sizes = (postings.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("posted_part"))
             .join(queries.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("query_part")), "list"))
    found = _compared(_parts(queries, sizes, "query_part", "posted_part"), _parts(postings, sizes, "posted_part", "query_part"), neighbours + 1)
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    best = found.distinct().withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= neighbours + 1)
    best = best.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    # Each query has at most (neighbours + 1) squared rows from here on.
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), "vec_id"))).alias("found"))
    own = asked.join(lists, asked["entry"] == lists["query"]).select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda c: c["vec_id"] != F.col("vec_id")), 1, neighbours).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "c")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.cost")).alias("score"))
