from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import gauge_model, make_trace, pool_model
from warmtrace.operators import gauges as ga
from warmtrace.operators import starts as st

K = 600_000
EXAMPLES = {
    "single": ([("o1", "f1", 128, 50, 100)], (100, 1, 1, 1, 1, 1, 128, 0, 0, 0)),
    "overlap": ([("o1", "f1", 128, 50, 100), ("o1", "f1", 128, 50, 125)],
                (125, 2, 2, 1, 1, 2, 256, 0, 0, 0)),
    "two functions": ([("o1", "f1", 128, 50, 100), ("o1", "f2", 128, 50, 125)],
                      (125, 2, 2, 1, 2, 2, 256, 0, 0, 0)),
    "two owners": ([("o1", "f1", 128, 50, 100), ("o2", "f2", 128, 50, 125)],
                   (125, 2, 2, 2, 2, 2, 256, 0, 0, 0)),
    "cold then warm": ([("o1", "f1", 128, 50, 100), ("o1", "f1", 128, 50, 200)],
                       (200, 2, 1, 1, 1, 1, 128, 0, 0, 0)),
    "cached": ([("o1", "f1", 128, 50, 100), ("o1", "f2", 128, 50, 200)],
               (200, 2, 2, 1, 1, 1, 128, 0, 1, 128)),
    "cached then warm": ([("o1", "f1", 128, 50, 100), ("o1", "f2", 128, 50, 200),
                          ("o1", "f1", 128, 50, 300)], (300, 3, 2, 1, 1, 1, 128, 0, 1, 128)),
}


@pytest.mark.parametrize("name", EXAMPLES)
def test_examples(spark, name):
    rows, expected = EXAMPLES[name]
    got = ga.gauges(st.classify_starts(make_trace(spark, rows), K), K).collect()
    assert [tuple(r) for r in got] == [expected]


def results(df):
    return {(r.function, r.seq): [r.cold, r.reused_at, r.container_id] for r in df.collect()}


def random_rows(seed, cases, size, span, longest):
    """Many small traces side by side, one function each, with many equal times."""
    rng = random.Random(seed)
    rows = []
    for case in range(cases):
        for _ in range(rng.randint(1, size)):
            rows.append((f"o{rng.randint(0, 2)}", f"f{case}", 128 * rng.randint(1, 4),
                         rng.choice([0, 0, rng.randint(1, longest)]), rng.randint(0, span)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keepalive", [0, 1, 7, 40])
def test_random_traces_match_pool(spark, keepalive):
    rows = random_rows(keepalive, 150, 25, 60, 30)
    model = pool_model([(*r, i) for i, r in enumerate(rows)], keepalive)
    tr = make_trace(spark, rows)
    for chunk in (4, 100_000):
        assert results(st.classify_starts(tr, keepalive, chunk, containers=True)) == model
    cold = {(r.function, r.seq) for r in st.cold_starts(tr, keepalive, 4).where("cold").collect()}
    assert cold == {k for k, v in model.items() if v[0]}


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_hot_function_over_many_batches(spark, partitions):
    """One function holds most rows and never idles; batches and chunks are tiny."""
    rng = random.Random(5)
    rows = [("o1", "hot", 128, rng.randint(0, 400), rng.randint(0, 20_000)) for _ in range(3_000)]
    rows += [("o2", f"f{i % 20}", 256, rng.randint(0, 400), rng.randint(0, 20_000)) for i in range(1_000)]
    model = pool_model([(*r, i) for i, r in enumerate(rows)], 30)
    tr = make_trace(spark, rows).repartition(partitions)
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        assert results(st.classify_starts(tr, 30, 500, containers=True)) == model
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)


def test_hot_function_is_spread_over_chunks(spark):
    """No shuffle of rows is keyed by the function alone."""
    rows = [("o1", "hot", 128, 50, t * 10) for t in range(400)]
    rows += [("o1", "rare", 128, 50, t * 100) for t in range(40)]
    pool = st._pool(make_trace(spark, rows), K, 50)
    sizes = {r.function: (r.n, r.chunks) for r in pool.groupBy("function", "chunk").count().groupBy("function")
             .agg(F.max("count").alias("n"), F.count("*").alias("chunks")).collect()}
    assert sizes["rare"] == (80, 1)
    assert sizes["hot"][0] <= 110 and sizes["hot"][1] >= 8


def test_keepalive_boundary(spark):
    """Cold exactly at the end of the keep-alive, warm one millisecond before."""
    for gap, cold in ((K, True), (K - 1, False)):
        tr = make_trace(spark, [("o", "f", 128, 50, 0), ("o", "f", 128, 50, 50 + gap)])
        assert st.cold_starts(tr, K).where("seq = 1").first().cold is cold


def test_equal_ends_of_different_functions_are_all_tracked(spark):
    tr = make_trace(spark, [("o", "a", 128, 100, 0), ("o", "b", 256, 50, 50), ("o", "c", 512, 90, 60)])
    g = ga.gauges(st.classify_starts(tr, K), K).first()
    assert (g.running_invocations, g.running_mb) == (3, 896)


def test_empty_trace(spark):
    tr = make_trace(spark, [("o", "f", 1, 1, 1)]).where("seq < 0")
    assert st.classify_starts(tr, K, containers=True).count() == 0
    assert ga.gauges(st.classify_starts(tr, K), K).count() == 0
    assert st.classify_optimised(tr, K).count() == 0


def test_segments_start_after_everything_expired(spark):
    rows = random_rows(11, 60, 25, 200, 20)
    keepalive = 6
    got = {(r.function, r.seq): r.segment for r in
           st.active_segments(make_trace(spark, rows), keepalive, 9).collect()}
    by_function = {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1][4], x[0])):
        until, n = by_function.get(r[1], (None, 0))
        if until is None or r[4] >= until:
            n += 1
        end = r[4] + r[3] + keepalive
        by_function[r[1]] = (end if until is None else max(until, end), n)
        assert got[r[1], i] == n


def ring_model(times, n, period, zero_fill):
    """First time at which the ring of the last n cold starts says hot."""
    ring, written, seen = [0 if zero_fill else None] * n, 0, False
    for ts in times:
        oldest = ring[written % n]
        if seen and oldest is not None and oldest >= ts - period:
            return ts
        ring[written % n] = ts
        written += 1
        seen = True
    return None


@pytest.mark.parametrize("zero_fill", [False, True])
def test_hot_functions_match_ring(spark, zero_fill):
    rng = random.Random(3)
    rows, expected = [], {}
    for case in range(120):
        times = sorted(rng.sample(range(400), rng.randint(1, 40)))
        rows += [("o", f"f{case}", 128, 1, t) for t in times]
        first = ring_model(times, 4, 30, zero_fill)
        if first is not None:
            expected[f"f{case}"] = first
    got = st.hot_functions(make_trace(spark, rows), 4, 30, zero_fill, chunk_rows=5)
    assert {r.function: r.hot_since for r in got.collect()} == expected


def test_twelve_cold_starts_within_a_minute(spark):
    """Ten predecessors are needed; the rule with missing ones as time 0 fires on the second start."""
    early = [("o", "f", 128, 10_000_000, t * 1_000) for t in range(12)]
    late = [("o", "f", 128, 10_000_000, 500_000 + t * 1_000) for t in range(12)]
    for rows, plain, filled in ((early, 10_000, 1_000), (late, 510_000, 510_000)):
        tr = make_trace(spark, rows)
        assert st.hot_functions(tr).first().hot_since == plain
        assert st.hot_functions(tr, zero_fill=True).first().hot_since == filled


def test_containers_keep_their_memory_and_flag(spark):
    """A warm start inherits both from the cold start of its container."""
    rows = [("o", "f", 100, 1_000, t) for t in range(3)]          # cold; the third finds two before it
    rows += [("o", "f", 999, 10, 5_000), ("o", "f", 777, 10, 5_020), ("o", "f", 555, 10, 5_040)]
    out = {r.seq: r for r in st.classify_optimised(make_trace(spark, rows), 10_000, n=2,
                                                    period_ms=100).collect()}
    assert [out[i].optimised for i in range(3)] == [False, False, True]
    assert out[2].memory_mb == 37
    assert [out[i].container_id for i in (3, 4, 5)] == [0, 1, 2]
    assert [out[i].memory_mb for i in (3, 4, 5)] == [100, 100, 37]
    assert [out[i].cold for i in (3, 4, 5)] == [False] * 3


def test_gauges_match_model(spark):
    rng = random.Random(8)
    rows = [(f"o{rng.randint(0, 3)}", f"f{rng.randint(0, 8)}", 128 * rng.randint(1, 8),
             rng.choice([0, rng.randint(1, 9_000)]), rng.randint(0, 60_000)) for _ in range(400)]
    full = [(*r, i) for i, r in enumerate(rows)]
    model = pool_model(full, 4_000)
    tr = make_trace(spark, rows)
    got = ga.gauges(st.classify_starts(tr, 4_000, 5_000), 4_000, chunk_rows=50).collect()
    instants = {}
    for r in rows:
        instants[r[4] // 1000] = max(r[4], instants.get(r[4] // 1000, 0))
    assert sorted(r.ts_ms for r in got) == sorted(instants.values())
    for r in got:
        assert tuple(r)[3:] == gauge_model(full, model, 4_000, r.ts_ms)
        same = [x for x in full if x[4] // 1000 == r.ts_ms // 1000]
        assert r.invocations == len(same)
        assert r.cold == sum(model[x[1], x[5]][0] for x in same)


def test_roots_by_pointer_doubling_equal_following():
    import numpy as np

    from warmtrace.operators.starts import _head_step, _roots
    rng = np.random.default_rng(2)
    rows, expected = [], []
    for key in range(6):
        heads = {}
        for seq in rng.permutation(120).tolist():
            link = int(rng.choice(list(heads))) if heads and rng.random() < 0.8 else None
            head = heads.pop(link) if link is not None else seq
            if link is None and rng.random() < 0.2:
                link = 1000 + seq   # a row of an earlier run
            heads[seq] = head
            rows.append((f"f{key // 2}", key % 2, seq, link))
            expected.append(head)
    import pyarrow as pa
    kept = [any(o[:2] == r[:2] and o[3] == r[2] for o in rows) for r in rows]
    table = pa.table({"function": [r[0] for r in rows], "chunk": [r[1] for r in rows], "seq": pa.array([r[2] for r in rows], pa.int64()),
                      "previous": pa.array([r[3] for r in rows], pa.int64()), "_kept": kept})
    for size in (1, 7, 100, 1000):
        step, _ = _head_step(["function", "chunk"], "")
        assert [h for b in step(iter(table.to_batches(max_chunksize=size))) for h in b.column(b.num_columns - 1).to_pylist()] == expected
    parent, taken = _roots(np.zeros(4, int), np.array([5, 6, 7, 8]), np.array([0, 5, 6, 99]), np.array([False, True, True, True]))
    assert parent.tolist() == [0, 0, 0, 3] and sorted(taken.tolist()) == [0, 1]
