from __future__ import annotations

import random

import pytest

from helpers import make_trace
from warmtrace.operators import gauges as ga
from warmtrace.operators import starts as st
from warmtrace.sources import writers as wr
from warmtrace.streaming import operators as strm

K = 3_000


def batches(spark, tmp_path, parts):
    """A stream that gets one part per trigger; a last row far ahead moves the watermark on."""
    folder = tmp_path / "in"
    schema = parts[0].schema
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def mixed(spark, seed=1):
    """Rows out of order within 2 s, in four parts, and a sentinel."""
    rng = random.Random(seed)
    rows = [(f"o{i % 2}", f"f{rng.randint(0, 4)}", 128, rng.choice([0, rng.randint(1, 2_000)]), rng.randint(0, 40_000))
            for i in range(300)]
    rows.sort(key=lambda r: r[4] + rng.randint(0, 2_000))
    tr = make_trace(spark, rows)
    parts = [tr.where(f"seq >= {a} and seq < {a + 75}") for a in (0, 75, 150, 225)]
    last = make_trace(spark, [("zz", "zz", 1, 1, 10_000_000)]).selectExpr(
        *[c for c in tr.columns if c != "seq"], "cast(999999 as bigint) as seq")
    return tr, [*parts, last]


def test_equal_lines_stay_rows_of_their_own(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv"):
        (tmp_path / "in" / name).write_text("o,f,128,50,100\n" * 3 + "o,f,128,50,200\n")
    out = run(strm.stream_load(spark, str(tmp_path / "in")), "loaded")
    rows = out.collect()
    assert len(rows) == 8 and len({r.seq for r in rows}) == 8
    assert st.classify_starts(out, K).count() == 8


def test_stream_starts_equal_batch(spark, tmp_path):
    tr, parts = mixed(spark)
    out = run(strm.stream_classify_starts(batches(spark, tmp_path, parts), K, "5 seconds"), "starts")
    got = {(r.function, r.seq): (r.cold, r.container_id) for r in out.collect()}
    want = {(r.function, r.seq): (r.cold, r.container_id)
            for r in st.classify_starts(tr, K, containers=True).collect()}
    assert got == want


def test_stream_counts_equal_batch(spark, tmp_path):
    tr, parts = mixed(spark, 2)
    out = run(strm.stream_sample_counts(batches(spark, tmp_path, parts), delay="5 seconds"), "counts")
    want = ga.sample_counts(st.cold_starts(tr, K)).select("ts_ms", "invocations")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_stream_hot_equal_batch(spark, tmp_path):
    tr, parts = mixed(spark, 3)
    out = run(strm.stream_hot_functions(batches(spark, tmp_path, parts), 5, 2_500, "5 seconds"), "hot")
    want = st.hot_functions(tr, 5, 2_500).select("function", "hot_since")
    assert want.count() > 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_stream_sessions_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    tr, parts = mixed(spark, 4)
    out = run(strm.stream_active_sessions(batches(spark, tmp_path, parts), 50, "5 seconds"), "sessions")
    want = strm.active_sessions(tr.withColumn("event_time", F.timestamp_millis("ts_ms")), 50)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    # A row is late once the watermark has passed it in an earlier run of the query.
    rows = [("o", "f", 1, 1, ts) for ts in (100, 60_000, 61_000, 200, 900_000)]
    tr = make_trace(spark, rows)
    parts = [tr.where(f"seq = {i}") for i in range(5)]
    out = run(strm.stream_classify_starts(batches(spark, tmp_path, parts), K, "5 seconds"), "late")
    assert sorted(r.ts_ms for r in out.collect()) == [100, 60_000, 61_000]


def test_stream_load_reads_trace_files(spark, tmp_path):
    tr = make_trace(spark, [("o", "f", 128, 5, 10), ("o", "g", 128, 5, 20)])
    wr.write_trace(tr, str(tmp_path / "in"))
    out = run(strm.stream_load(spark, str(tmp_path / "in")), "loaded")
    assert sorted((r.function, r.ts_ms) for r in out.collect()) == [("f", 0), ("g", 10)]


STEPS = {
    "starts": lambda tr: strm.stream_classify_starts(tr, K, "5 seconds"),
    "counts": lambda tr: strm.stream_sample_counts(tr, delay="5 seconds"),
    "hot": lambda tr: strm.stream_hot_functions(tr, 5, 2_500, "5 seconds"),
    "sessions": lambda tr: strm.stream_active_sessions(tr, 50, "5 seconds")}


@pytest.mark.parametrize("name", STEPS)
def test_the_end_gives_what_was_held(spark, tmp_path, name):
    tr, parts = mixed(spark, 5)
    with_sentinel = run(STEPS[name](batches(spark, tmp_path / "a", parts)), f"sentinel_{name}")
    got = strm.run_to_end(batches(spark, tmp_path / "b", parts[:-1]), STEPS[name], str(tmp_path / "out"))
    assert got.columns == with_sentinel.columns and got.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, with_sentinel.collect()))
    # Called again there is nothing more.
    rows = spark.readStream.schema(tr.schema).parquet(str(tmp_path / "b" / "in"))
    assert strm.run_to_end(rows, STEPS[name], str(tmp_path / "out")).count() == got.count()


@pytest.mark.parametrize("name", ["starts", "sessions"])
def test_a_stream_without_rows_ends(spark, tmp_path, name):
    tr = make_trace(spark, [("o", "f", 1, 1, 1)]).where("false")
    assert strm.run_to_end(batches(spark, tmp_path, [tr]), STEPS[name], str(tmp_path / "out")).count() == 0
    on_time, late = strm.split_late(batches(spark, tmp_path, [tr]), str(tmp_path / "split"))
    assert late.count() == 0
    assert strm.run_to_end(on_time, STEPS[name], str(tmp_path / "rest")).count() == 0


def test_late_rows_are_kept_apart(spark, tmp_path):
    rows = [("o", "f", 1, 1, ts) for ts in (100, 60_000, 55_000, 54_999, None, 200, 200, 900_000)]
    tr = make_trace(spark, rows)
    rounds = [[0], [1], [2, 3, 4], [5, 6, 7]]
    folder, seen = tmp_path / "in", []
    for part in rounds:
        tr.where(tr.seq.isin(part)).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(tr.schema).parquet(str(folder))
        on_time, late = strm.split_late(stream, str(tmp_path / "split"), "5 seconds")
        strm.advance(on_time, STEPS["starts"], str(tmp_path / "starts"))
        seen.append(sorted(r.seq for r in late.collect()))
    # At the watermark is late; equal rows stay two; a row without a time is never late.
    assert seen == [[], [], [2, 3], [2, 3, 5, 6]]
    out = strm.run_to_end(on_time, STEPS["starts"], str(tmp_path / "starts"))
    assert sorted(r.seq for r in out.collect()) == [0, 1, 7]


def test_a_row_on_time_is_never_lost(spark, tmp_path):
    tr, parts = mixed(spark, 6)
    delay = "200 milliseconds"
    step = lambda t: strm.stream_classify_starts(t, K, delay)
    for part in parts[:-1]:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(tr.schema).parquet(str(tmp_path / "in"))
        on_time, late = strm.split_late(stream, str(tmp_path / "split"), delay)
        strm.advance(on_time, step, str(tmp_path / "starts"))
    out = strm.run_to_end(on_time, step, str(tmp_path / "starts"))
    assert late.count() > 0 and out.count() + late.count() == 300
    want = st.classify_starts(tr.join(late.select("seq"), "seq", "left_anti"), K).select("function", "seq", "cold")
    assert sorted(map(tuple, out.select("function", "seq", "cold").collect())) == sorted(map(tuple, want.collect()))
