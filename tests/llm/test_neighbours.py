from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from warmtrace.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, divisor):
    """Cosines in double precision over all rows; equal scores by the smaller id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    length = np.sqrt((x * x).sum(1))
    out = {}
    for at, (i, _) in enumerate(rows):
        if i % divisor == 0:
            score = x @ x[at] / (length * length[at])
            score[ids == i] = -9
            order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), score[j]) for j in order]
    return out


def found_of(df, **options):
    out = {}
    for r in nb.search(df, F.col("vec_id") % 5 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.6 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    got, want = found_of(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), sample=1000, cluster=32, probes=12), brute(rows, 5, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, found in got.items():
        for i, score in found:
            assert abs(score - x[q] @ x[i] / np.sqrt((x[q] @ x[q]) * (x[i] @ x[i]))) < 1e-12
        assert found == sorted(found, key=lambda c: (-c[1], c[0]))


def test_everything_probed_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nb, "PART", 40)        # lists and queries in several parts
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(200)]          # copies of a vector
    got = found_of(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), sample=100, cluster=10, probes=1000, reach=1e9)
    want = brute(rows, 5, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_balanced_clusters():
    x = nb._unit(np.random.default_rng(3).normal(size=(2000, 8)) + np.array([4.0] + [0] * 7))
    sizes = [len(c) for c in nb._clusters(x, 64)]
    assert sum(sizes) == 2000 and max(sizes) <= 64 and min(sizes) >= 16


def test_walk_finds_the_nearest_lists():
    x = np.random.default_rng(4).normal(size=(3000, 12))
    index = nb.Centroids.of_sample(x, 16)
    y = nb._unit(np.random.default_rng(5).normal(size=(200, 12)).astype(np.float32))
    lists, cosines = index.nearest(y, 16)
    near = y @ index.vectors.T
    assert np.mean(lists[:, 0] == near.argmax(1)) > 0.97
    assert np.allclose(cosines, np.take_along_axis(near, lists, 1), atol=1e-5)
    assert all(len(set(r)) == len(r) for r in lists.tolist())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, inf]), (6, [1.0, None]), (None, [1.0, 1.0]),
            (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [0.0, 2.0]), (9, []), (10, [1.0, 2.0, 3.0]), (15, None), (20, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).withColumns({"list": F.lit(1), "entry": F.lit(2), "score": F.lit("s")})
    got = found_of(df)
    assert set(got) == {0, 5, 20}
    assert [i for i, _ in got[0]] == [5, 7, 8, 20] and got[0][0][1] == 1.0 and got[0][-1][1] == -1.0
    assert [i for i, _ in got[20]] == [8, 7, 0, 5]
    assert found_of(df.where("false")) == {} and found_of(df.where("vec_id = 2")) == {}
    assert found_of(df.where("vec_id = 0")) == {}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_recall_on_the_table(spark, sf):
    from warmtrace.llm.queries import op7_neighbours
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = brute(rows, 5, 50)
    got = {}
    for r in op7_neighbours(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
