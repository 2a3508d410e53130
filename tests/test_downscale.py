from __future__ import annotations

import random

import pytest

from helpers import cap_model, make_trace
from warmtrace.operators import downscale as down
from warmtrace.operators import gauges as ga


def rows_for(seed, n=600, span=4_000, longest=120):
    rng = random.Random(seed)
    return [(f"o{rng.randint(0, 9)}", f"f{rng.randint(0, 30)}", 128 * rng.randint(1, 4),
             rng.choice([0, rng.randint(1, longest), 5 * longest]), rng.randint(0, span))
            for _ in range(n)]


@pytest.mark.parametrize("limit", [1, 6, 14, 60])
def test_cap_concurrency_exact(spark, limit):
    rows = rows_for(limit)
    got = [r.seq for r in down.cap_concurrency(make_trace(spark, rows), limit, mode="exact", chunk_rows=40).collect()]
    assert sorted(got) == sorted(cap_model([(*r, i) for i, r in enumerate(rows)], limit, lambda r: 1))


@pytest.mark.parametrize("limit", [100, 1_000, 3_000])
def test_cap_memory_exact(spark, limit):
    rows = rows_for(limit)
    got = [r.seq for r in down.cap_memory(make_trace(spark, rows), limit, mode="exact", chunk_rows=40).collect()]
    assert sorted(got) == sorted(cap_model([(*r, i) for i, r in enumerate(rows)], limit, lambda r: r[2]))


def test_cap_by_owner(spark):
    rows = rows_for(77)
    full = [(*r, i) for i, r in enumerate(rows)]
    got = [r.seq for r in down.cap_concurrency(make_trace(spark, rows), 2, mode="exact", by=["owner"], chunk_rows=40).collect()]
    want = [s for o in {r[0] for r in rows} for s in cap_model([r for r in full if r[0] == o], 2, lambda r: 1)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("mode", ["exact", "sharded"])
def test_caps_are_never_exceeded(spark, mode):
    tr = make_trace(spark, rows_for(9))
    peak = lambda out, what: ga.running_gauges(out, grid_ms=1).agg({what: "max"}).first()[0]
    few, small = down.cap_concurrency(tr, 9, mode=mode), down.cap_memory(tr, 4_000, mode=mode)
    assert few.count() > 0 and small.count() > 0
    assert peak(few, "running_invocations") <= 9 and peak(small, "running_mb") <= 4_000


def test_rows_that_do_not_overlap_all_stay(spark):
    tr = make_trace(spark, [("o", "f", 512, 10, 10 * t) for t in range(40)])
    for cap in (512, 1000, 1024, 100_000):
        assert down.cap_memory(tr, cap).count() == 40
    for cap in (1, 4, 50):
        assert down.cap_concurrency(tr, cap).count() == 40
    assert down.cap_memory(tr, 511).count() == 0


def test_more_shards_than_hold_a_row_are_refused(spark):
    tr = make_trace(spark, [("o", "f", 512, 10, t) for t in range(40)])
    with pytest.raises(ValueError, match="at most 2 do"):
        down.cap_memory(tr, 1024, shards=8)
    with pytest.raises(ValueError, match="at most 4 do"):
        down.cap_concurrency(tr, 4, shards=8)


def test_middle_functions_clamps(spark):
    rows = [("o", f"f{i}", 128, 1, i) for i in range(4) for _ in range(i + 1)]
    tr = make_trace(spark, rows)
    assert down.middle_functions(tr, 9).count() == len(rows)
    assert {r.function for r in down.middle_functions(tr, 2).collect()} == {"f1", "f2"}


def test_top_owners_ties_by_name(spark):
    rows = [("b", "f1", 1, 1, 0), ("b", "f2", 1, 1, 0), ("a", "f3", 1, 1, 0), ("c", "f4", 1, 1, 0)]
    assert {r.owner for r in down.top_owners(make_trace(spark, rows), 2).collect()} == {"a", "b"}


def test_thin_random_does_not_depend_on_partitions(spark):
    tr = make_trace(spark, rows_for(1))
    kept = [{r.seq for r in down.thin_random(tr.repartition(n), 3, seed=5).collect()} for n in (1, 7)]
    assert kept[0] == kept[1]
    assert 100 < len(kept[0]) < 300


def test_downscale_without_limits_keeps_everything(spark):
    tr = make_trace(spark, rows_for(2))
    assert down.downscale(tr).count() == 600


def test_one_piece_that_spans_blocks(spark):
    # Two of three rows overlap the next ones at all times: no row begins free, so this is one piece.
    rows = [("o" if i % 5 else None, "f", 128 * (1 + i % 3), 25 + i % 7, 10 * i) for i in range(3 * down.BLOCK_ROWS)]
    tr = make_trace(spark, rows)
    got = [r.seq for r in down.cap_memory(tr, 400, mode="exact", chunk_rows=700).collect()]
    full = [(o or "", *r, i) for i, (o, *r) in enumerate(rows)]
    assert sorted(got) == cap_model(full, 400, lambda r: r[2])
    got = [r.seq for r in down.cap_concurrency(tr, 2, mode="exact", by=["owner"], chunk_rows=700).collect()]
    want = [s for o in ("", "o") for s in cap_model([r for r in full if r[0] == o], 2, lambda r: 1)]
    assert sorted(got) == sorted(want)


def test_the_rows_of_a_piece_are_packed(spark):
    n = 4 * down.BLOCK_ROWS
    rows = spark.range(n).selectExpr("id AS _place", "0L AS _piece", "10 * id AS ts_ms", "10 * id + 30 AS _end",
                                     "128L AS _weight", "0L AS _sure_load", "256L AS _limit")
    got = down._admitted(rows, [])
    assert [r._place for r in got.orderBy("_place").collect()] == [i for i in range(n) if i % 3 < 2]
    keys, schema = ["_home", "_block"], "`_home` bigint, `_block` bigint, `_place` bigint"
    blocks = rows.selectExpr("0L AS _home", f"_place DIV {down.BLOCK_ROWS} AS _block", "*").coalesce(1)
    step, schema = down._packed(keys, schema)
    size = blocks.mapInArrow(step, schema).selectExpr("count(*) AS n", "sum(length(_rows)) AS bytes").first()
    assert size.n < 16 and size.bytes < 16 * n
