"""Reports that come with a generation."""

from __future__ import annotations

from warmtrace.plans.pipelines import generate_reported

SCHEMA = "owner string, function string, memory_mb int, duration_ms bigint, ts_ms bigint, seq bigint"
STEPS = ["read", "outside_range", "no_memory", "no_duration", "loaded", "generated"]


def reported(spark, rows, **limits):
    out, report = generate_reported(spark.createDataFrame(rows, SCHEMA), 1, 2, limits)
    found = {r.step: r.rows for r in report.orderBy("pos").collect()}
    assert list(found) == STEPS
    return out, list(found.values())


def test_every_row_counts_once(spark):
    rows = [("a", "f", 128, 10, 60_000, 1), ("a", "g", 128, 10, 179_999, 2), ("b", "h", 128, 10, 60_000, 3), ("b", "h", 128, 10, 60_000, 4),
            ("a", "f", 128, 10, 59_999, 5), ("a", "f", 0, 0, 180_000, 6), ("a", "f", 128, 10, None, 7),
            ("a", "f", 0, 0, 60_000, 8), ("a", "f", None, 10, 60_000, 9), ("a", "f", 128, -1, 60_000, 10), (None, None, 128, None, 60_000, 11)]
    out, counts = reported(spark, rows, users=1)
    assert counts == [11, 3, 2, 2, 4, 2]
    assert {r.seq for r in out.collect()} == {1, 2}
    assert reported(spark, rows)[1] == [11, 3, 2, 2, 4, 4]


def test_an_empty_table_has_a_report(spark):
    out, counts = reported(spark, [])
    assert counts == [0] * 6 and out.count() == 0
