"""When users and functions are active: by stretches where every row has an end, else by moves."""

import random
from collections import Counter

import pytest
from helpers import SCHEMA, make_trace
from pyspark.sql import functions as F
from warmtrace.model import end_ms
from warmtrace.operators import gauges as ga
from warmtrace.operators import starts as st


def changes(rows, ends, where):
    """The instants at which a key's level becomes positive or stops being so, added up; a null instant is the first."""
    out = Counter()
    for kind, of in (("users", 0), ("functions", 1)):
        for name in ends:
            for key in {r[of] for r in rows}:
                moves = Counter()
                for r in rows:
                    if r[of] == key and where.get(name, lambda r: True)(r):
                        moves[r[4]] += 1
                        moves[ends[name](r)] -= 1
                level = 0
                for time in sorted(moves, key=lambda t: (t is not None, t or 0)):
                    before, level = level, level + moves[time]
                    out[f"{name}_{kind}", time] += (level > 0) - (before > 0)
    return {k: n for k, n in out.items() if n}


@pytest.mark.parametrize("odd", ["none", "few", "every key"])
@pytest.mark.parametrize("chunk_rows", [7, 1000])
def test_steps_are_those_of_the_levels(spark, odd, chunk_rows):
    rng = random.Random(5)
    rows = [(f"o{f % 3}", f"f{f}", 128, rng.choice([0, 0, 1, 5, 20, 90]), rng.randrange(60) * 5)
            for f in (rng.randrange(8) for _ in range(300))]
    if odd == "few":
        rows += [("o0", "f0", 128, None, 40), ("o0", "f0", 128, None, 10), (None, "f9", 128, 5, 10), (None, "f9", 128, None, 3),
                 ("o2", None, 128, 4, 17), ("o9", "f10", 128, -5, 50), ("o9", "f11", 128, 5, None)]
    if odd == "every key":
        rows += [(f"o{f % 3}", f"f{f}", 128, None, 100) for f in range(8)]
    tr = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)
    late = end_ms() + F.col("seq") % 4 * 10
    steps = ga._active_steps(tr, {"running": end_ms(), "held": late, "small": end_ms()}, chunk_rows, {"small": F.col("seq") % 2 == 0})

    def end(r):
        return None if r[3] is None or r[4] is None else r[4] + r[3]

    def held(r):
        return None if end(r) is None else end(r) + r[5] % 4 * 10

    names = [c for c in steps.columns if c != "time"]
    got = Counter()
    for r in steps.collect():
        for n in names:
            got[n, r.time] += r[n]
    want = changes([(*r, i) for i, r in enumerate(rows)], {"running": end, "held": held, "small": end}, {"small": lambda r: r[5] % 2 == 0})
    assert {k: n for k, n in got.items() if n} == want


def test_a_row_is_sorted_once_for_its_user_and_once_for_its_function(spark, monkeypatch):
    dealt, running = [], ga.running

    def counted(df, *, keys, **options):
        if keys:
            dealt.append(df.count())
        return running(df, keys=keys, **options)

    monkeypatch.setattr(ga, "running", counted)
    tr = make_trace(spark, [("o", f"f{i % 2}", 128, 5, 7 * i) for i in range(100)])
    assert ga.gauges(st.classify_starts(tr, 20, 10), 20, chunk_rows=10).count() == 1
    assert dealt == [200]


def test_the_pool_is_sorted_once(spark, monkeypatch):
    monkeypatch.setattr(st, "materialise", lambda df: df)
    pool = st._pool(make_trace(spark, [("o", "f", 128, 5, 10 * i) for i in range(50)]), 20, 10)
    plan = pool._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line and "kind#" in line for line in plan.splitlines()) == 1
