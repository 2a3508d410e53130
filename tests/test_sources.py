from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from helpers import make_trace
from warmtrace.model import TRACE_HEADER
from warmtrace.operators import aggregate as agg
from warmtrace.operators import gauges as ga
from warmtrace.operators import language as lang
from warmtrace.operators import starts as st
from warmtrace.plans import pipelines as pipe
from warmtrace.sources import readers as rd
from warmtrace.sources import writers as wr


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def wide(owner, app, function, counts):
    cells = ["0"] * 1440
    for minute, n in counts.items():
        cells[minute - 1] = str(n)
    return ",".join([owner, app, function, "http", *cells])


@pytest.fixture()
def day(tmp_path):
    header = ",".join(["HashOwner", "HashApp", "HashFunction", "Trigger", *map(str, range(1, 1441))])
    counts = write(tmp_path / "counts.csv", header, wide("o1", "a1", "f1", {700: 4, 701: 2, 710: 3}),
                   wide("o1", "a1", "f2", {705: 1, 711: 9}), wide("o2", "a2", "f3", {702: 5}),
                   wide("o3", "a9", "f4", {703: 5}))
    durations = write(tmp_path / "durations.csv", "HashOwner,HashApp,HashFunction,Average,Count,Minimum",
                      "o1,a1,f1,10,1,1", "o1,a1,f2,20,1,1", "o1,a1,f1,30,1,1", "o3,a9,f4,5,1,1")
    memory = write(tmp_path / "memory.csv", "HashOwner,HashApp,SampleCount,AverageAllocatedMb",
                   "o1,a1,3,100", "o1,a1,3,150", "o2,a2,1,64")
    return pipe.MinuteCounts(counts, durations, memory)


def test_minute_counts_to_trace(spark, day):
    tr = day.load(spark)
    rows = tr.collect()
    assert sorted({(r.owner, r.function, r.memory_mb, r.duration_ms) for r in rows}) == [
        ("o1", "f1", 150, 30), ("o1", "f2", 150, 20)]
    assert len(rows) == 6
    for r in rows:
        minute = r.ts_ms // 60_000 + 1
        assert (r.function, minute) in {("f1", 701), ("f1", 710), ("f2", 705)}
    again = {(r.function, r.seq, r.ts_ms) for r in day.load(spark).repartition(3).collect()}
    assert again == {(r.function, r.seq, r.ts_ms) for r in rows}
    with pytest.raises(ValueError, match="invalid minute range"):
        day.load(spark, first=0)


def test_repeated_function_rows_add_up(spark, tmp_path):
    counts = write(tmp_path / "c.csv", "HashOwner,x", wide("o", "a", "f", {1: 2}), wide("o", "a", "f", {1: 3}))
    long = rd.read_minute_counts(spark, counts, 1, 3)
    durations = spark.createDataFrame([("f", 5)], "function string, duration_ms int")
    memory = spark.createDataFrame([("a", 6)], "app string, memory_mb int")
    tr = pipe.counts_to_trace(long, durations, memory)
    assert tr.count() == 5 and tr.select("function", "seq").distinct().count() == 5


def test_large_counts_unfold(spark):
    from warmtrace.operators.expand import unfold
    df = spark.createDataFrame([("a", 10_000), ("b", 1), ("c", 4_096)], "k string, n bigint")
    got = unfold(df, "n").groupBy("k").agg(F.count("*").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    assert sorted(map(tuple, got.collect())) == [("a", 10_000, 1, 10_000), ("b", 1, 1, 1), ("c", 4_096, 1, 4_096)]


def test_minute_matrices(spark, tmp_path):
    for kind, lines in {"requests": ["m,time,0,1", "x,172800,2.9,", "x,172860,1,3", "x,9,7,7"],
                        "delay": ["m,time,0,1", "x,172800,10.5,4", "x,172860,,2.4", "x,9,7,7"],
                        "memory": ["m,time,0,1", "x,172800,128,4", "x,172860,9,99.5", "x,9,7,7"]}.items():
        write(tmp_path / kind / "day_002.csv", *lines)
    source = pipe.MinuteMatrices(*[str(tmp_path / k) for k in ("requests", "delay", "memory")])
    rows = source.load(spark, 2).collect()
    assert sorted((r.owner, r.function, r.memory_mb, r.duration_ms) for r in rows) == [
        ("owner_0", "f_0", 128, 11)] * 2 + [("owner_1", "f_1", 100, 2)] * 3
    assert all(172_800_000 <= r.ts_ms < 172_920_000 for r in rows)
    assert source.load(spark, 2, first=1).count() == 3
    write(tmp_path / "delay" / "day_002.csv", "m,time,0", "x,172800,1")
    with pytest.raises(ValueError, match="different function columns"):
        source.load(spark, 2)


HEADER = "NamespaceHash,AppHash,AppContainerRequestMemory,AppExecTimes,InvocationTimes"


def test_weekly_events(spark, tmp_path):
    write(tmp_path / "week_1.csv", HEADER, "n,a,0.25,10.5,1000", "n,a,0.25,0,1001", "bad,row", "n,b,1,7,599999",
          "n,b,1,7,600000")
    write(tmp_path / "week_2.csv", HEADER, "n,a,0.5,3,5")
    tr = pipe.WeeklyEvents(str(tmp_path)).load(spark, 1, 2)
    got = sorted((r.function, r.memory_mb, r.duration_ms, r.ts_ms) for r in tr.collect())
    assert got == [("a", 256, 11, 1000), ("a", 512, 3, 604_800_005), ("b", 1024, 7, 599_999)]
    assert tr.select("function", "seq").distinct().count() == 3
    write(tmp_path / "week_3.csv", "a,b,c,d,e", "n,a,0.5,3,5")
    with pytest.raises(ValueError, match="unexpected header"):
        pipe.WeeklyEvents(str(tmp_path)).load(spark, 3)


def test_nested_events(spark, tmp_path):
    config = [{"NamespaceHash": "n", "AppHash": "a", "AppContainerRequestMemory": [0.25, 0.5]},
              {"NamespaceHash": "n", "AppHash": "b", "AppContainerRequestMemory": []},
              {"NamespaceHash": None, "AppHash": "c", "AppContainerRequestMemory": [1]}]
    events = [{"NamespaceHash": "n", "AppHash": "a", "InvocationTimes": [1.0005, 2.5, 3],
               "AppExecTimes": [10.5, None, 11.5]},
              {"NamespaceHash": "n", "AppHash": "b", "InvocationTimes": [1], "AppExecTimes": [1]},
              {"NamespaceHash": "n", "AppHash": "a", "InvocationTimes": [], "AppExecTimes": [1]}]
    c = write(tmp_path / "config.json", *map(json.dumps, config))
    e = write(tmp_path / "events.json", *map(json.dumps, events))
    rows = pipe.event_arrays_to_rows(rd.read_app_events(spark, e, "json"), rd.read_app_config(spark, c, "json"))
    got = sorted((r.app, r.memory_mb, r.duration_ms, r.ts_ms) for r in rows.collect())
    assert got == [("a", 384, 10, 1000), ("a", 384, 12, 2500)]
    wr.write_event_rows(rows, str(tmp_path / "week_1.csv"))
    back = rd.read_event_rows(spark, str(tmp_path / "week_1.csv"))
    assert sorted((r.memory_mb, r.duration_ms, r.ts_ms) for r in back.collect()) == [(384, 10, 1000), (384, 12, 2500)]


def test_trace_round_trip(spark, tmp_path):
    tr = make_trace(spark, [("o1", "f1", 128, 50, 500), ("o2", "f2", 64, 5, 300), ("o1", "f1", 128, 50, 400)])
    wr.write_trace(tr, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert [x for x in text.split("\n") if x and x != TRACE_HEADER] == [
        "o2,f2,64,5,0", "o1,f1,128,50,100", "o1,f1,128,50,200"]
    back = rd.read_trace(spark, str(tmp_path / "t"))
    assert sorted((r.owner, r.ts_ms) for r in back.collect()) == [("o1", 100), ("o1", 200), ("o2", 0)]


def test_empty_trace_writes_its_header(spark, tmp_path):
    wr.write_trace(make_trace(spark, [("o", "f", 1, 1, 1)]).where("seq < 0"), str(tmp_path / "t"))
    assert [p.read_text().strip() for p in (tmp_path / "t").glob("part-*")] == [TRACE_HEADER]


def test_enriched_trace_and_mappings(spark, tmp_path):
    tr = make_trace(spark, [("o", f"f{i % 5}", 128, 10 * i, i) for i in range(40)])
    fn = pipe.languages(tr, seed=1)
    wr.write_enriched_trace(tr, fn, str(tmp_path / "e"))
    back = rd.read_enriched_trace(spark, str(tmp_path / "e"))
    assert back.count() == 40
    names = {(r.function, r.benchmark) for r in fn.collect()}
    assert {(r.function, r.benchmark) for r in back.collect()} == names
    wr.write_benchmark_mapping(fn, str(tmp_path / "m"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()} == names
    ids = agg.dense_ids(tr, "function")
    wr.write_id_mapping(ids, "function", str(tmp_path / "i"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "i"), header=True).collect()} == {
        (f"f{i}", str(i)) for i in range(5)}


def test_catalogue(spark, tmp_path):
    entry = {"language": "java", "benchmarkName": "x", "code": "http://{{HOST_NAME}}/{{NOT_SET}}x", "memory": 256,
             "duration": 5}
    path = write(tmp_path / "c.json", json.dumps({"one": entry, "two": {**entry, "memory": 512}}, indent=1))
    got = {r.name: (r.code, r.memory, r.svmId) for r in rd.read_catalogue(spark, path, {"HOST_NAME": "$h1"}).collect()}
    assert got == {"one": ("http://$h1/x", 256, None), "two": ("http://$h1/x", 512, None)}


def test_gauge_log_round_trip(spark, tmp_path):
    tr = make_trace(spark, [("o1", "f1", 128, 50, 100), ("o1", "f2", 128, 50, 200), ("o2", "f1", 128, 50, 5_300)])
    for i, starts in enumerate((st.classify_starts(tr), st.classify_optimised(tr, n=1))):
        g = ga.gauges(starts)
        wr.write_gauge_log(g, str(tmp_path / f"g{i}"))
        lines = [x for p in sorted((tmp_path / f"g{i}").glob("part-*")) for x in p.read_text().split("\n") if x]
        write(tmp_path / f"log{i}", "noise", lines[0], "more noise here", *lines[1:])
        back = rd.read_gauge_log(spark, str(tmp_path / f"log{i}"), optimised=bool(i))
        assert sorted(map(tuple, back.collect())) == sorted(tuple(map(float, r)) for r in g.collect())
    assert lines[0].startswith("time 200 | invocations 2 cold 2 | running users 1 functions 1")
    assert "| optimized_cold 0 running_optimized_functions 0" in lines[0]


def test_utilisation_is_valid_json(spark, tmp_path):
    tr = make_trace(spark, [("o1", "f1", 1_500, 50, 100), ("o2", "f2", 100, 50, 110)])
    wr.write_utilisation(ga.vm_footprint(tr, "owner"), str(tmp_path / "u"))
    rows = [json.loads(x) for p in (tmp_path / "u").glob("part-*") for x in p.read_text().split("\n") if x]
    assert rows == [{"time": 110, "VMs": 3, "memory": 3072}]


def test_metric_series_keeps_line_order(spark, tmp_path):
    write(tmp_path / "gv.txt", "3.5", "1", "", "2e2")
    write(tmp_path / "cr.txt", "7")
    got = rd.read_metric_series(spark, [str(tmp_path / "gv.txt"), str(tmp_path / "cr.txt")])
    assert sorted(map(tuple, got.collect())) == [("cr", 0, 7.0), ("gv", 0, 3.5), ("gv", 1, 1.0), ("gv", 2, 200.0)]


def test_generate_with_limits_and_dense_ids(spark, day):
    out, owners, functions = pipe.generate(spark, day, {"functions": 1, "users": 1, "rank_on_range": True},
                                           compress=True)
    assert {r.owner for r in out.collect()} == {"0"}
    assert owners.count() == 1 and functions.count() == 2


def test_ids_follow_the_counts_file(spark, tmp_path):
    counts = write(tmp_path / "counts.csv", wide("zed", "a1", "f9", {1: 1}), wide("abe", "a2", "f1", {1: 1}), wide("mid", "a3", "f5", {900: 1}),
                   wide("none", "a4", "f0", {1: 1}))
    durations = write(tmp_path / "durations.csv", "zed,a1,f9,1,1", "abe,a2,f1,1,1", "mid,a3,f5,1,1")
    memory = write(tmp_path / "memory.csv", "zed,a1,1,64", "abe,a2,1,64", "mid,a3,1,64")
    out, owners, functions = pipe.generate(spark, pipe.MinuteCounts(counts, durations, memory), compress=True, first=1, last=10)
    assert {(r.owner, r.id) for r in owners.collect()} == {("zed", 0), ("abe", 1), ("mid", 2)}
    assert {(r.function, r.id) for r in functions.collect()} == {("f9", 0), ("f1", 1), ("f5", 2)}
    assert sorted(r.owner for r in out.collect()) == ["0", "1"]


def test_analyse_accepts_another_start_policy(spark):
    tr = make_trace(spark, [("o", "f", 128, 50, 0), ("o", "f", 128, 50, 100)])

    def always_cold(rows, keepalive_ms):
        return rows.withColumn("cold", F.lit(True)).withColumn("reused_at", F.lit(None).cast("bigint"))

    assert pipe.analyse(tr, 1_000).first().cold == 1
    assert pipe.analyse(tr, 1_000, classify=always_cold).first().cold == 2


def test_nearest_benchmark_rules(spark):
    fn = spark.createDataFrame([("a", "java", 6), ("b", "java", 1), ("c", "JAVA", 99_999), ("d", "java", 2219), ("e", "java", 2220)],
                               "function string, language string, duration_ms bigint")
    got = {r.function: r.benchmark for r in lang.nearest_benchmark(fn).collect()}
    assert got == {"a": "jvhw", "b": "jvhw", "c": "jvvp", "d": "jvfh", "e": "jvcl"}
    tie = {r.function: r.benchmark for r in lang.nearest_benchmark(
        fn, {"java": {"x": 4, "y": 8, "z": 4_430}}).collect()}
    assert tie["a"] == "x" and tie["d"] == "y"


def test_load_report(spark):
    df, seen = agg.load_report(make_trace(spark, [("o", "f", 1, 1, 1), ("o", "f", 0, 1, 1)]), "trace",
                               no_memory=F.col("memory_mb") <= 0)
    df.collect()
    assert seen.get == {"rows": 2, "no_memory": 1}
