from __future__ import annotations

import random

import numpy as np
import pytest

from helpers import SCHEMA, make_trace
from warmtrace.operators import gauges as ga
from warmtrace.operators import language as lang
from warmtrace.operators import samples as sa
from warmtrace.operators import starts as st


def one_by_one(times, gap, final=True):
    out, last = [], 0
    for t in sorted(set(times)):
        if t - last > gap:
            out.append(t)
            last = t
    return sorted({*out, max(times)}) if final and times else out


def instants(df):
    return sorted(r.ts_ms for r in df.collect())


@pytest.mark.parametrize("gap,chunk", [(1000, 1 << 20), (1000, 1500), (7, 64), (50, 3), (0, 10)])
def test_equals_following_one_by_one(spark, gap, chunk):
    random.seed(gap)
    times = sorted(random.choice([random.randrange(2000), random.randrange(90_000), 40_000 + random.randrange(300)]) for _ in range(700))
    tr = make_trace(spark, [("o", "f", 128, 5, t) for t in times])
    for final in (True, False):
        assert instants(sa.sample_times(tr, gap, final, chunk)) == one_by_one(times, gap, final)


def test_exits_of_a_chunk_are_those_of_every_entry():
    rng = np.random.default_rng(4)
    for n in (1, 2, 30, 200):
        times = np.unique(rng.integers(1000, 1900, n))
        bounds, last = sa.chunk_exits(times, 1000, 40)
        assert len(bounds) <= 42 and bounds == sorted(bounds)
        for state in range(900, 1000):
            inside, now = None, state
            for t in times.tolist():
                if t - now > 40:
                    inside = now = t
            assert last[int(np.searchsorted(bounds, state + 40, "right")) - 1] == inside


def test_negative_and_no_times(spark):
    tr = spark.createDataFrame([("o", "f", 1, 1, t, i) for i, t in enumerate([-5000, -10, 3, 999, 1001, 1001, 5000, None])], SCHEMA)
    assert instants(sa.sample_times(tr, 1000, False)) == [1001, 5000]
    assert instants(sa.sample_times(tr.where("false"))) == []


@pytest.mark.parametrize("rows,want", [
    ([("o1", "f1", 128, 50, 100)], (100, 1, 1, 1, 1, 1, 128, 0, 0, 0)),
    ([("o1", "f1", 128, 50, 100), ("o1", "f1", 128, 50, 125)], (125, 2, 2, 1, 1, 2, 256, 0, 0, 0)),
    ([("o1", "f1", 128, 50, 100), ("o1", "f2", 128, 50, 125)], (125, 2, 2, 1, 2, 2, 256, 0, 0, 0)),
    ([("o1", "f1", 128, 50, 100), ("o2", "f2", 128, 50, 125)], (125, 2, 2, 2, 2, 2, 256, 0, 0, 0)),
    ([("o1", "f1", 128, 50, 100), ("o1", "f1", 128, 50, 200)], (200, 2, 1, 1, 1, 1, 128, 0, 0, 0)),
    ([("o1", "f1", 128, 50, 100), ("o1", "f2", 128, 50, 200)], (200, 2, 2, 1, 1, 1, 128, 0, 1, 128)),
    ([("o1", "f1", 128, 50, 100), ("o1", "f2", 128, 50, 200), ("o1", "f1", 128, 50, 300)], (300, 3, 2, 1, 1, 1, 128, 0, 1, 128))])
def test_gauges_of_the_seven_examples(spark, rows, want):
    tr = make_trace(spark, rows)
    assert [tuple(r) for r in ga.gauges(st.classify_starts(tr), samples=sa.sample_times(tr)).collect()] == [want]


def test_other_gauges_read_at_samples(spark):
    tr = make_trace(spark, [("o1", "f1", 128, 5000, 1500), ("o1", "f2", 256, 100, 2000), ("o2", "f1", 64, 2000, 3000), ("o2", "f3", 64, 1, 3100)])
    samples = sa.sample_times(tr)
    assert instants(samples) == [1500, 3000, 3100]
    assert sorted(map(tuple, ga.running_gauges(tr, samples=samples).collect())) == [(1500, 1, 128), (3000, 2, 192), (3100, 3, 256)]
    assert sorted(map(tuple, ga.running_distinct(tr, samples=samples).collect())) == [(1500, 1, 1), (3000, 2, 1), (3100, 2, 2)]
    assert [r.ts_ms for r in ga.vm_footprint(tr, "owner", samples=samples).orderBy("ts_ms").collect()] == [1500, 3000, 3100]


def test_nearest_in_catalogue_equals_the_fixed_table(spark):
    fixed = [(language, name, ms) for language, by in lang.BENCHMARK_DURATIONS.items() for name, ms in by.items()]
    catalogue = spark.createDataFrame(fixed, "language string, benchmark string, duration_ms long")
    rows = [(f"f{i}", random.Random(i).choice(["java", "Python", "javascript"]), i * (1 if i < 80 else 170)) for i in range(200)]
    fn = spark.createDataFrame(rows, "function string, language string, duration_ms long")
    want = sorted((r.function, r.benchmark) for r in lang.nearest_benchmark(fn, seed=5).collect())
    for chunk in (1_000_000, 10):
        got = lang.nearest_in_catalogue(fn, catalogue, seed=5, chunk_rows=chunk)
        assert sorted((r.function, r.benchmark) for r in got.collect()) == want


def test_nearest_in_catalogue_of_odd_rows(spark):
    fn = spark.createDataFrame([("f", "go", 5), ("g", None, 5), ("h", "java", None), ("i", "java", -4), ("i", "java", -4)],
                               "function string, language string, duration_ms long")
    catalogue = spark.createDataFrame([("java", "a", 3), ("java", "a", 3), ("java", None, 1), ("java", "b", None)],
                                      "language string, benchmark string, duration_ms long")
    got = lang.nearest_in_catalogue(fn, catalogue)
    assert sorted((r.function, r.benchmark) for r in got.collect()) == [("f", None), ("g", None), ("h", None), ("i", "a"), ("i", "a")]
    assert {r.benchmark for r in lang.nearest_in_catalogue(fn, catalogue.where("false")).collect()} == {None}
