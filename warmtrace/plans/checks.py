"""Every operator as a query over the driver tables, with the same answer in SQL.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` maps it
to SQL over the same tables, written without this package's operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import (clean_numbers, convert_units, median_memory,
                         optimised_footprint, round_java, round_py)
from ..model import TRACE, end_ms, with_end
from ..operators import aggregate as agg
from ..operators import downscale as down
from ..operators import expand as ex
from ..operators import gauges as ga
from ..functions import ceil_div
from ..operators import language as lang
from ..operators import samples as sa
from ..operators import series as ser
from ..operators import starts as st
from ..operators.running import running, time_chunk
from ..operators.stages import shared_folder
from ..sources import readers as rd
from ..sources import writers as wr
from ..streaming import operators as strm
from . import pipelines as pipe
from .event_trace import as_event_trace, based_trace, event_trace

QUERIES, ORACLES = {}, {}

KEEPALIVE = 21_600_000
HOT_PERIOD = 691_200_000
HOT_N = 10
MINUTE = 60_000

BASE = """WITH RECURSIVE raw AS (
  SELECT event_id AS seq, 'o' || (user_id % 20) AS owner,
         'f' || (user_id % 20) || '_' || event_type AS function, event_type AS app,
         CAST(128 * (1 + CAST(json_extract_string(props, '$.k') AS INT) % 8) AS INT) AS memory_mb,
         CAST(floor(value * 10000 + 0.5) AS BIGINT) AS duration_ms,
         epoch_us(ts) // 1000 AS raw_ms
  FROM events),
trace AS (
  SELECT seq, owner, function, app, memory_mb, duration_ms,
         raw_ms - (SELECT min(raw_ms) FROM raw) AS ts_ms FROM raw)"""

COUNTS = """, counts AS (
  SELECT owner, app, function, 1 + (ts_ms // 60000) % 1440 AS minute, count(*) AS count
  FROM trace GROUP BY ALL)"""


def check(name, sql=None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return register


def trace(spark, sf_dir):
    return based_trace(spark, sf_dir).select(*TRACE)


def minute_counts(spark, sf_dir):
    minute = 1 + time_chunk("ts_ms", MINUTE) % 1440
    return (based_trace(spark, sf_dir).groupBy("owner", "app", "function", minute.alias("minute"))
            .agg(F.count("*").alias("count")))


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _sparse_line(items, width, blank):
    """Comma-separated cells from sorted ``pos, v`` items, ``blank`` elsewhere."""
    def fill(cells):
        return F.repeat(F.lit(blank + ","), cells.cast("int"))

    line = F.aggregate(
        items, F.struct(F.lit(0).cast("bigint").alias("next"), F.lit("").alias("text")),
        lambda a, x: F.struct((x["pos"] + 1).alias("next"), F.concat(
            a["text"], fill(x["pos"] - a["next"]), x["v"], F.lit(",")).alias("text")),
        lambda a: F.concat(a["text"], fill(width - a["next"])))
    return F.left(line, F.length(line) - 1)


def hash_sql(*parts):
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


# --- sources -------------------------------------------------------------------

@check("read_minute_counts", BASE + COUNTS + """
SELECT owner, app, function, CAST(minute AS BIGINT) AS minute, count FROM counts""")
def _(spark, sf_dir):
    per = minute_counts(spark, sf_dir).groupBy("owner", "app", "function").agg(
        F.array_sort(F.collect_list(F.struct((F.col("minute") - 1).alias("pos"),
                                             F.col("count").cast("string").alias("v")))).alias("items"))
    lines = per.select(F.concat_ws(",", "owner", "app", "function", F.lit("http"),
                                   _sparse_line("items", F.lit(1440), "0")).alias("value"))
    counts = ex.drop_empty_minutes(rd.parse_minute_counts(lines))
    return counts.select("owner", "app", "function", *big("minute", "count"))


@check("read_function_durations", BASE + """
SELECT function, CAST(arg_max(duration_ms, seq) AS BIGINT) AS duration_ms
FROM trace GROUP BY function""")
def _(spark, sf_dir):
    lines = based_trace(spark, sf_dir).select(
        F.concat_ws(",", "owner", "app", "function", "duration_ms", "seq").alias("value"),
        F.col("seq").alias("row_pos"))
    return rd.parse_function_durations(lines).select("function", *big("duration_ms"))


@check("read_app_memory", BASE + """
SELECT app, CAST(arg_max(memory_mb, seq) AS BIGINT) AS memory_mb FROM trace GROUP BY app""")
def _(spark, sf_dir):
    lines = based_trace(spark, sf_dir).select(
        F.concat_ws(",", "owner", "app", "seq", "memory_mb").alias("value"),
        F.col("seq").alias("row_pos"))
    return rd.parse_app_memory(lines).select("app", *big("memory_mb"))


POSITIONS = """, positions AS (
  SELECT function, row_number() OVER (ORDER BY function) - 1 AS pos
  FROM (SELECT DISTINCT function FROM trace)),
cells AS (
  SELECT (ts_ms // 60000) * 60 AS time_s, pos, count(*) AS n, avg(duration_ms) AS delay,
         CASE WHEN count(*) % 5 <> 4 THEN avg(memory_mb) END AS memory
  FROM trace JOIN positions USING (function) GROUP BY ALL)"""


def _cells(spark, sf_dir):
    """Minute and function cells: count, delay, and memory with some blanks."""
    tr = trace(spark, sf_dir)
    ids = agg.dense_ids(tr.select("function").distinct().withColumn("seq", F.lit(0)), "function")
    time_s = time_chunk("ts_ms", MINUTE) * 60
    return (tr.join(ids.withColumnRenamed("id", "pos"), "function")
            .groupBy(time_s.alias("time_s"), "pos")
            .agg(F.count("*").alias("n"), F.avg("duration_ms").alias("delay"), F.avg("memory_mb").alias("m"))
            .withColumn("memory", F.when(F.col("n") % 5 != 4, F.col("m"))).drop("m"))


def _matrix_lines(cells, column, width):
    """Wide lines of one matrix, one per minute, blanks where nothing is known."""
    item = F.struct("pos", F.col(column).cast("string").alias("v"))
    per = (cells.where(F.col(column).isNotNull()).groupBy("time_s")
           .agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("width", width))
    return per.select(F.concat_ws(",", F.lit("x"), "time_s", _sparse_line("items", F.col("width"), "")).alias("value"),
                      F.floor(F.col("time_s") / 86400).cast("int").alias("day"))


def _matrix(spark, sf_dir, column):
    cells = _cells(spark, sf_dir)
    width = trace(spark, sf_dir).agg(F.count_distinct("function")).scalar()
    return rd.parse_minute_matrix(_matrix_lines(cells, column, width), F.col("day"))


@check("read_minute_matrix", BASE + POSITIONS + """
SELECT time_s, pos, CAST(n AS DOUBLE) AS value FROM cells""")
def _(spark, sf_dir):
    return _matrix(spark, sf_dir, "n").select(*big("time_s", "pos"), "value")


def _hourly_records(spark, sf_dir):
    """Nested records per function and hour; records of one app kind lack their namespace."""
    tr = based_trace(spark, sf_dir)
    hour = F.floor(F.col("ts_ms") / 3_600_000)
    item = F.struct("ts_ms", "seq", (F.col("ts_ms") / 1000).alias("t"),
                    F.col("duration_ms").cast("double").alias("d"))
    return (tr.groupBy("owner", "app", "function", hour.alias("hour"))
            .agg(F.array_sort(F.collect_list(item)).alias("items"))
            .select(F.when(F.col("app") != "error", F.col("owner")).alias("NamespaceHash"),
                    F.col("function").alias("AppHash"), F.col("items.t").alias("InvocationTimes"),
                    F.col("items.d").alias("AppExecTimes")))


@check("read_app_events", BASE + """
SELECT owner AS namespace, function AS app, count(DISTINCT ts_ms // 3600000) AS records,
       count(*) AS times, round(sum(ts_ms / 1000), 3) AS total_s
FROM trace WHERE app <> 'error' GROUP BY ALL""")
def _(spark, sf_dir):
    events = rd.parse_app_events(_hourly_records(spark, sf_dir))
    added = F.aggregate("times_s", F.lit(0.0), lambda a, x: a + x)
    return events.groupBy("namespace", "app").agg(
        F.count("*").alias("records"), F.sum(F.size("times_s")).alias("times"),
        F.round(F.sum(added), 3).alias("total_s"))


def _config(spark, sf_dir, without=("purchase",)):
    gb = F.col("memory_mb") / 1024
    records = based_trace(spark, sf_dir).where(~F.col("app").isin(*without)).select(
        F.when(F.col("app") != "error", F.col("owner")).alias("NamespaceHash"),
        F.col("function").alias("AppHash"),
        F.array(gb, gb + (F.col("seq") % 7) / 1024, F.lit(None), gb * 3).alias("AppContainerRequestMemory"),
        F.col("seq").alias("row_pos"))
    return rd.parse_app_config(records)


CONFIG = """, config AS (
  SELECT owner AS namespace, function AS app,
         CAST(arg_max(round_even((memory_mb + seq % 7) / 1024 * 1024, 0), seq) AS BIGINT) AS memory_mb
  FROM trace WHERE app NOT IN ('error', 'purchase') GROUP BY ALL)"""


@check("read_app_config", BASE + CONFIG.replace("NOT IN ('error', 'purchase')", "<> 'error'") + " SELECT * FROM config")
def _(spark, sf_dir):
    return _config(spark, sf_dir, without=()).select("namespace", "app", *big("memory_mb"))


def _event_lines(spark, sf_dir):
    gb = (F.col("memory_mb") / 1024).cast("string")
    five = F.concat_ws(",", "owner", "function", gb, (F.col("duration_ms") / 4).cast("string"),
                       (F.col("ts_ms") + 0.25).cast("string"))
    return based_trace(spark, sf_dir).select(
        F.when(F.col("app") == "error", F.concat(five, F.lit(",extra"))).otherwise(five).alias("value"),
        F.col("seq").alias("row_pos"))


@check("read_event_rows", BASE + """
SELECT owner, function, CAST(memory_mb AS BIGINT) AS memory_mb,
       CAST(floor(duration_ms / 4 + 0.5) AS BIGINT) AS duration_ms, ts_ms, seq
FROM trace WHERE app <> 'error'""")
def _(spark, sf_dir):
    rows = rd.parse_event_rows(_event_lines(spark, sf_dir)).withColumnRenamed("row_pos", "seq")
    return rows.select("owner", "function", *big("memory_mb", "duration_ms", "ts_ms", "seq"))


TRACE_SQL = """
SELECT owner, function, CAST(memory_mb AS BIGINT) AS memory_mb, duration_ms, ts_ms, seq FROM """


@check("read_trace", BASE + TRACE_SQL + "trace")
def _(spark, sf_dir):
    lines = trace(spark, sf_dir).select(
        F.concat_ws(",", "owner", "function", "memory_mb", "duration_ms", "ts_ms").alias("value"),
        F.col("seq").alias("row_pos"))
    tr = rd.parse_trace(lines).drop("language", "benchmark")
    return tr.select("owner", "function", *big("memory_mb", "duration_ms", "ts_ms", "seq"))


@check("read_catalogue", """
SELECT CAST(p_partkey AS VARCHAR) AS name, p_brand AS language, p_name AS benchmarkName,
       'http://store/apps/' || p_partkey || '/' AS code, CAST(128 * p_size AS BIGINT) AS memory,
       CAST(p_size AS BIGINT) AS duration
FROM part""")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    entry = F.struct(F.col("p_brand").alias("language"), F.col("p_name").alias("benchmarkName"),
                     F.concat(F.lit("http://{{HOST}}/apps/"), F.col("p_partkey"), F.lit("/{{UNSET_NAME}}"))
                     .alias("code"), (F.col("p_size") * 128).alias("memory"), F.col("p_size").alias("duration"))
    documents = part.select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), entry)).alias("value"))
    return rd.parse_catalogue(documents, {"HOST": "store"}).select(
        "name", "language", "benchmarkName", "code", *big("memory", "duration"))


SIMPLE_GAUGES = """, g AS (
  SELECT max(ts_ms) AS ts_ms, count(*) AS invocations, count(DISTINCT app) AS cold,
         count(DISTINCT owner) AS running_users, count(DISTINCT function) AS running_functions,
         count(*) AS running_invocations, sum(memory_mb) AS running_mb, min(seq) AS cached_users,
         max(seq) AS cached_functions, max(duration_ms) AS cached_mb
  FROM trace GROUP BY ts_ms // 600000)"""


def _simple_gauges(spark, sf_dir):
    return based_trace(spark, sf_dir).groupBy(F.floor(F.col("ts_ms") / 600000).alias("b")).agg(
        F.max("ts_ms").alias("ts_ms"), F.count("*").alias("invocations"),
        F.count_distinct("app").alias("cold"), F.count_distinct("owner").alias("running_users"),
        F.count_distinct("function").alias("running_functions"),
        F.count("*").alias("running_invocations"), F.sum("memory_mb").alias("running_mb"),
        F.min("seq").alias("cached_users"), F.max("seq").alias("cached_functions"),
        F.max("duration_ms").alias("cached_mb")).drop("b")


@check("read_gauge_log", BASE + SIMPLE_GAUGES + """
SELECT ts_ms, invocations, cold, running_users, running_functions, running_invocations,
       CAST(running_mb AS BIGINT) AS running_mb, cached_users, cached_functions, cached_mb FROM g""")
def _(spark, sf_dir):
    lines = wr.format_gauge_log(_simple_gauges(spark, sf_dir)).select("value")
    noise = based_trace(spark, sf_dir).select(F.concat_ws(" ", "owner", "app").alias("value"))
    return rd.parse_gauge_log(lines.unionByName(noise)).select(*big(*ga.GAUGES))


@check("read_metric_series", """
SELECT event_type AS series, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS pos,
       value FROM events""")
def _(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("series"), F.col("value").cast("string").alias("value"),
        F.floor(F.col("event_id") / 4096).alias("block"), F.col("event_id").alias("row_pos"))
    return rd.parse_metric_series(lines)


# --- sinks -----------------------------------------------------------------------

@check("write_trace", BASE + """
SELECT owner AS "HashOwner", function AS "HashFunction", CAST(memory_mb AS BIGINT) AS "AverageAllocatedMb",
       duration_ms AS "AverageDuration", ts_ms AS "Timestamp" FROM trace""")
def _(spark, sf_dir):
    frame = wr.trace_frame(event_trace(spark, sf_dir))
    return frame.withColumn("AverageAllocatedMb", F.col("AverageAllocatedMb").cast("bigint"))


@check("write_id_mapping", BASE + """
SELECT function AS "HashFunction", row_number() OVER (ORDER BY first_seq) - 1 AS "CompressedHash"
FROM (SELECT function, min(seq) AS first_seq FROM trace GROUP BY function)""")
def _(spark, sf_dir):
    return wr.id_mapping_frame(agg.dense_ids(trace(spark, sf_dir), "function"), "function")


@check("write_event_rows", BASE + """
SELECT owner AS "NamespaceHash", function AS "AppHash", memory_mb / 1024 AS "AppContainerRequestMemory",
       duration_ms AS "AppExecTimes", ts_ms AS "InvocationTimes" FROM trace""")
def _(spark, sf_dir):
    ev = trace(spark, sf_dir).select(F.col("owner").alias("namespace"), F.col("function").alias("app"),
                                     "memory_mb", "duration_ms", "ts_ms")
    return wr.event_rows_frame(ev)


@check("format_gauge_log", BASE + SIMPLE_GAUGES + """
SELECT ts_ms, 'time ' || ts_ms || ' | invocations ' || invocations || ' cold ' || cold
  || ' | running users ' || running_users || ' functions ' || running_functions
  || ' invocations ' || running_invocations || ' footprint ' || running_mb
  || ' | cached users ' || cached_users || ' functions ' || cached_functions
  || ' footprint ' || cached_mb AS value FROM g""")
def _(spark, sf_dir):
    return wr.format_gauge_log(_simple_gauges(spark, sf_dir))


SAMPLES = """, samples AS (SELECT max(ts_ms) AS s FROM trace GROUP BY ts_ms // 1000)"""
PLAIN_LOAD = SAMPLES + """, load AS (
  SELECT s, count(*) AS n, coalesce(sum(memory_mb), 0) AS mb, count(seq) AS running,
         count(DISTINCT owner) AS users, count(DISTINCT function) AS functions
  FROM samples LEFT JOIN trace ON ts_ms <= s AND s < ts_ms + duration_ms GROUP BY s)"""


@check("write_utilisation", BASE + PLAIN_LOAD + """
SELECT s AS ts_ms, '{"time":' || s || ',"VMs":' || (mb // 1024) || ',"memory":' || mb || '}' AS value FROM load""")
def _(spark, sf_dir):
    return wr.utilisation_frame(ga.vm_footprint(trace(spark, sf_dir), "invocation"))


# --- projections, filters, predicates ------------------------------------------------

@check("filter_minutes", BASE + COUNTS + """
SELECT owner, app, function, CAST(minute AS BIGINT) AS minute, count FROM counts
WHERE minute BETWEEN 701 AND 760""")
def _(spark, sf_dir):
    return ex.filter_minutes(minute_counts(spark, sf_dir), 701, 760)


@check("filter_minute_window", BASE + TRACE_SQL + "trace WHERE ts_ms >= 1440 * 60000 AND ts_ms < 2880 * 60000")
def _(spark, sf_dir):
    tr = ex.filter_minute_window(trace(spark, sf_dir), 1440, 2879)
    return tr.select("owner", "function", *big("memory_mb", "duration_ms", "ts_ms", "seq"))


@check("drop_empty_minutes", BASE + """
SELECT seq, CAST(trunc(duration_ms / 200000 - 1) AS BIGINT) AS count FROM trace
WHERE trunc(duration_ms / 200000 - 1) > 0""")
def _(spark, sf_dir):
    counts = trace(spark, sf_dir).select("seq", (F.col("duration_ms") / 200000 - 1).alias("count"))
    return ex.drop_empty_minutes(counts)


@check("drop_incomplete", BASE + """
SELECT seq, duration_ms - 100000 AS duration_ms, memory_mb + 0 AS memory_mb FROM trace
WHERE duration_ms > 100000 AND memory_mb <> 256""")
def _(spark, sf_dir):
    rows = trace(spark, sf_dir).select(
        "seq", (F.col("duration_ms") - 100000).alias("duration_ms"),
        F.nullif(F.col("memory_mb").cast("bigint"), F.lit(256)).alias("memory_mb"))
    return ex.drop_incomplete(ex.drop_incomplete(rows, ["memory_mb"]), ["duration_ms"], positive=True)


def _reasons():
    cells = F.split("value", ",", -1)
    return {"wrong_width": F.size(cells) != 5, "blank_owner": F.get(cells, F.lit(0)) == "o7",
            "slow": F.get(cells, F.lit(3)).try_cast("double") > 200000}


@check("drop_malformed", BASE + """
SELECT owner || ',' || function AS id, seq FROM trace
WHERE app <> 'error' AND owner <> 'o7' AND duration_ms / 4 <= 200000""")
def _(spark, sf_dir):
    good = ex.drop_malformed(_event_lines(spark, sf_dir), _reasons())
    return good.select(F.substring_index("value", ",", 2).alias("id"), F.col("row_pos").alias("seq"))


@check("count_malformed", BASE + """
SELECT count(*) FILTER (app = 'error') AS wrong_width,
       count(*) FILTER (app <> 'error' AND owner = 'o7') AS blank_owner,
       count(*) FILTER (app <> 'error' AND owner <> 'o7' AND duration_ms / 4 > 200000) AS slow,
       count(*) FILTER (app <> 'error' AND owner <> 'o7' AND duration_ms / 4 <= 200000) AS kept
FROM trace""")
def _(spark, sf_dir):
    return ex.count_malformed(_event_lines(spark, sf_dir), _reasons())


@check("with_end", BASE + """
SELECT function, seq, ts_ms, ts_ms + duration_ms AS end_ms FROM trace""")
def _(spark, sf_dir):
    return with_end(trace(spark, sf_dir)).select("function", "seq", "ts_ms", "end_ms")


@check("convert_units", BASE + """
SELECT seq, round(memory_mb / 1024, 6) AS gb, round(memory_mb / 1024 * 1024, 6) AS mb,
       round(duration_ms / 1000, 6) AS s, round(duration_ms / 1000 * 1000, 6) AS ms FROM trace""")
def _(spark, sf_dir):
    gb, s = convert_units(F.col("memory_mb"), "mb_to_gb"), convert_units(F.col("duration_ms"), "ms_to_s")
    return trace(spark, sf_dir).select(
        "seq", F.round(gb, 6).alias("gb"), F.round(convert_units(gb, "gb_to_mb"), 6).alias("mb"),
        F.round(s, 6).alias("s"), F.round(convert_units(s, "s_to_ms"), 6).alias("ms"))


@check("round_java", """
SELECT event_id AS seq, CAST(floor(floor(value) / 2 - 10 + 0.5) AS BIGINT) AS rounded FROM events""")
def _(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(F.col("event_id").alias("seq"),
                     round_java(F.floor("value") / 2 - 10).alias("rounded"))


@check("round_py", """
SELECT event_id AS seq, CAST(round_even(floor(value) / 2 - 10, 0) AS BIGINT) AS rounded FROM events""")
def _(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(F.col("event_id").alias("seq"),
                     round_py(F.floor("value") / 2 - 10).alias("rounded"))


@check("offset_days", BASE + """
SELECT seq, (ts_ms // 86400000) * 86400 AS day_start_s, (ts_ms // 60000) * 60000 AS minute_start_ms,
       ts_ms % 604800000 + (ts_ms // 604800000) * 604800000 AS week_ms FROM trace""")
def _(spark, sf_dir):
    ts = F.col("ts_ms")
    return trace(spark, sf_dir).select(
        "seq", ex.offset_days(F.floor(ts / 86_400_000)).alias("day_start_s"),
        ex.minute_start_ms(F.floor(ts / MINUTE) + 1).alias("minute_start_ms"),
        ex.offset_weeks(ts % 604_800_000, F.floor(ts / 604_800_000) + 3, 3).alias("week_ms"))


@check("rebase_time", BASE + " SELECT function, seq, ts_ms FROM trace")
def _(spark, sf_dir):
    return ex.rebase_time(event_trace(spark, sf_dir)).select("function", "seq", "ts_ms")


EXPANDED = COUNTS + f""", expanded AS (
  SELECT owner, app, function, minute, i, (minute - 1) * 60000
         + {hash_sql('function', 'minute', 'i', '11')} % 60000 AS ts_ms, minute * 4294967296 + i AS seq
  FROM (SELECT *, unnest(range(1, count + 1)) AS i FROM counts))"""


@check("expand_counts", BASE + EXPANDED + """
SELECT owner, app, function, CAST(minute AS BIGINT) AS minute, CAST(i AS BIGINT) AS i,
       CAST(ts_ms AS BIGINT) AS ts_ms, CAST(seq AS BIGINT) AS seq FROM expanded""")
def _(spark, sf_dir):
    rows = ex.expand_counts(minute_counts(spark, sf_dir), seed=11)
    return rows.select("owner", "app", "function", *big("minute", "i", "ts_ms", "seq"))


@check("jitter_in_minute", BASE + f"""
SELECT seq, {hash_sql('function', 'ts_ms // 60000', 'seq', '5')} % 60000 AS offset_ms FROM trace""")
def _(spark, sf_dir):
    minute = F.floor(F.col("ts_ms") / MINUTE)
    return trace(spark, sf_dir).select(
        "seq", ex.jitter_in_minute(F.col("function"), minute, F.col("seq"), 5).alias("offset_ms"))


@check("synth_ids", BASE + """
SELECT seq, 'owner_' || (seq % 100) AS owner, 'f_' || (seq % 100) AS function FROM trace""")
def _(spark, sf_dir):
    rows = trace(spark, sf_dir).select("seq", (F.col("seq") % 100).alias("pos"))
    return ex.synth_ids(rows).select("seq", "owner", "function")


@check("clean_numbers", BASE + """
SELECT seq, CAST(CASE WHEN app = 'error' THEN 1 ELSE 2 END AS BIGINT) AS n,
       CAST(duration_ms + CASE WHEN app = 'error' THEN 0 ELSE memory_mb END AS DOUBLE) AS total FROM trace""")
def _(spark, sf_dir):
    raw = F.array(F.col("duration_ms").cast("string"), F.lit("x"), F.lit(None), F.lit("NaN"),
                  F.when(F.col("app") != "error", F.col("memory_mb").cast("string")))
    rows = based_trace(spark, sf_dir).select("seq", clean_numbers(raw).alias("a"))
    return rows.select("seq", F.size("a").cast("bigint").alias("n"),
                       F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("total"))


@check("median_memory", BASE + """
SELECT seq, CAST(round_even((memory_mb + (seq % 5) / 2) / 1024 * 1024, 0) AS BIGINT) AS memory_mb FROM trace""")
def _(spark, sf_dir):
    gb = F.col("memory_mb") / 1024
    rows = trace(spark, sf_dir).select(
        "seq", F.array(gb + (F.col("seq") % 5) / 1024, F.lit(None), gb).alias("memory_gb"))
    return median_memory(rows).select("seq", "memory_mb")


@check("optimised_footprint", BASE + """
SELECT seq, CAST(trunc((memory_mb + seq % 9) * 0.375) AS BIGINT) AS memory_mb FROM trace""")
def _(spark, sf_dir):
    mb = optimised_footprint(F.col("memory_mb") + F.col("seq") % 9)
    return trace(spark, sf_dir).select("seq", mb.cast("bigint").alias("memory_mb"))


# --- languages --------------------------------------------------------------------

def _nearest_sql():
    rows = ", ".join(f"('{language}', '{name}', {ms})"
                     for language, by in lang.BENCHMARK_DURATIONS.items() for name, ms in by.items())
    return f"""(VALUES {rows}) AS b(language, benchmark, ms)"""


LANGUAGES = f""", shuffled AS (
  SELECT function, count(*) AS invocations, arg_min(duration_ms, (ts_ms, seq)) AS duration_ms,
         md5(concat_ws('|', function, '7')) AS key FROM trace GROUP BY function),
totals AS (SELECT *, sum(invocations) OVER (ORDER BY key, function) AS upto,
                  sum(invocations) OVER () AS total FROM shuffled),
assigned AS (
  SELECT function, invocations, duration_ms, CAST(upto AS BIGINT) AS upto,
         CASE WHEN upto <= trunc(total * 0.48) THEN 'javascript'
              WHEN upto <= trunc(total * 0.48) + trunc(total * 0.24) THEN 'python'
              ELSE 'java' END AS language FROM totals),
distances AS (
  SELECT a.*, b.benchmark, b.ms, rank() OVER (PARTITION BY function ORDER BY abs(b.ms - duration_ms), b.ms) AS r
  FROM assigned a JOIN {_nearest_sql()} ON a.language = b.language),
picked AS (
  SELECT function, invocations, duration_ms, upto, language,
         list(benchmark ORDER BY benchmark) AS names FROM distances WHERE r = 1 GROUP BY ALL),
fn AS (
  SELECT function, invocations, duration_ms, upto, language,
         names[1 + {hash_sql('function', '7', "'pick'")} % len(names)] AS benchmark FROM picked)"""


def _languages(spark, sf_dir):
    return pipe.languages(trace(spark, sf_dir), seed=7)


def enriched(spark, sf_dir):
    return lang.attach_language(trace(spark, sf_dir), _languages(spark, sf_dir))


@check("assign_language", BASE + LANGUAGES + """
SELECT function, invocations, duration_ms, upto, language FROM assigned""")
def _(spark, sf_dir):
    return lang.assign_language(trace(spark, sf_dir), seed=7)


@check("nearest_benchmark", BASE + LANGUAGES + " SELECT function, language, duration_ms, benchmark FROM fn")
def _(spark, sf_dir):
    return _languages(spark, sf_dir).select("function", "language", "duration_ms", "benchmark")


@check("nearest_benchmark_rows", BASE + f""", short AS (
  SELECT function || '_' || seq AS function, seq, ts_ms % 40 AS duration_ms,
         CASE app WHEN 'click' THEN 'java' WHEN 'view' THEN 'python' ELSE 'javascript' END AS language FROM trace),
distances AS (
  SELECT a.*, b.benchmark, b.ms, rank() OVER (PARTITION BY seq ORDER BY abs(b.ms - duration_ms), b.ms) AS r
  FROM short a JOIN {_nearest_sql()} ON a.language = b.language),
picked AS (SELECT function, seq, list(benchmark ORDER BY benchmark) AS names FROM distances WHERE r = 1 GROUP BY ALL)
SELECT seq, names[1 + {hash_sql('function', '3', "'pick'")} % len(names)] AS benchmark FROM picked""")
def _(spark, sf_dir):
    language = (F.when(F.col("app") == "click", "java").when(F.col("app") == "view", "python")
                .otherwise("javascript"))
    rows = based_trace(spark, sf_dir).select(
        F.concat_ws("_", "function", "seq").alias("function"), "seq",
        (F.col("ts_ms") % 40).alias("duration_ms"), language.alias("language"))
    return lang.nearest_benchmark(rows, seed=3).select("seq", "benchmark")


# A catalogue from the table of parts: many durations, some of several entries.
@check("nearest_in_catalogue", BASE + f""", known AS (
  SELECT DISTINCT 'p' || p_partkey AS benchmark, CASE p_size % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'python' ELSE 'javascript' END AS language,
         CAST(floor(p_retailprice) AS BIGINT) * 4 AS ms FROM part),
short AS (
  SELECT function || '_' || seq AS function, seq, duration_ms % 9000 AS duration_ms,
         CASE app WHEN 'click' THEN 'java' WHEN 'view' THEN 'python' ELSE 'javascript' END AS language FROM trace),
distances AS (
  SELECT a.*, b.benchmark, b.ms, rank() OVER (PARTITION BY seq ORDER BY abs(b.ms - duration_ms), b.ms) AS r
  FROM short a JOIN known b ON a.language = b.language),
picked AS (SELECT function, seq, list(benchmark ORDER BY benchmark) AS names FROM distances WHERE r = 1 GROUP BY ALL)
SELECT seq, names[1 + {hash_sql('function', '3', "'pick'")} % len(names)] AS benchmark FROM picked""")
def _(spark, sf_dir):
    return lang.nearest_in_catalogue(*_catalogue_rows(spark, sf_dir), seed=3).select("seq", "benchmark")


def _catalogue_rows(spark, sf_dir):
    language = (F.when(F.col("app") == "click", "java").when(F.col("app") == "view", "python")
                .otherwise("javascript"))
    rows = based_trace(spark, sf_dir).select(F.concat_ws("_", "function", "seq").alias("function"), "seq",
                                             (F.col("duration_ms") % 9000).alias("duration_ms"), language.alias("language"))
    third = F.col("p_size") % 3
    known = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("p"), "p_partkey").alias("benchmark"),
        F.when(third == 0, "java").when(third == 1, "python").otherwise("javascript").alias("language"),
        (F.floor("p_retailprice").cast("bigint") * 4).alias("duration_ms"))
    return rows, known


@check("nearest_in_catalogue_cut", ORACLES["nearest_in_catalogue"])
def _(spark, sf_dir):
    return lang.nearest_in_catalogue(*_catalogue_rows(spark, sf_dir), seed=3, chunk_rows=40).select("seq", "benchmark")


@check("attach_language", BASE + LANGUAGES + """
SELECT t.function, t.seq, fn.language, fn.benchmark FROM trace t JOIN fn USING (function)""")
def _(spark, sf_dir):
    return enriched(spark, sf_dir).select("function", "seq", "language", "benchmark")


CATALOGUE = """, catalogue AS (
  SELECT benchmark, CAST(max(t.memory_mb) AS BIGINT) AS memory, min(t.duration_ms) AS duration
  FROM trace t JOIN fn USING (function) GROUP BY benchmark)"""


def _catalogue(rows):
    return rows.groupBy(F.col("benchmark").alias("name")).agg(
        F.max("memory_mb").alias("memory"), F.min("duration_ms").alias("duration"))


@check("attach_catalogue", BASE + LANGUAGES + CATALOGUE + """
SELECT t.function, t.seq, c.memory AS memory_mb, c.duration AS duration_ms
FROM trace t JOIN fn USING (function) JOIN catalogue c USING (benchmark)""")
def _(spark, sf_dir):
    rows = enriched(spark, sf_dir)
    out = lang.attach_catalogue(rows, _catalogue(rows))
    return out.select("function", "seq", *big("memory_mb", "duration_ms"))


@check("read_enriched_trace", BASE + LANGUAGES + """
SELECT t.owner, t.function, CAST(t.memory_mb AS BIGINT) AS memory_mb, t.duration_ms, t.ts_ms, t.seq,
       fn.language, fn.benchmark FROM trace t JOIN fn USING (function)""")
def _(spark, sf_dir):
    lines = enriched(spark, sf_dir).select(
        F.concat_ws(",", *wr.TRACE_FIELDS, "language", "benchmark").alias("value"),
        F.col("seq").alias("row_pos"))
    rows = rd.parse_trace(lines)
    return rows.select("owner", "function", *big("memory_mb", "duration_ms", "ts_ms", "seq"),
                       "language", "benchmark")


@check("load_report", BASE + """
SELECT count(*) AS rows, count(*) FILTER (app = 'error') AS errors, count(*) FILTER (duration_ms > 2000000) AS long FROM trace""")
def _(spark, sf_dir):
    """Counts that come with an action on the trace, without another pass over it."""
    seen, report = agg.load_report(based_trace(spark, sf_dir), f"load-{uuid.uuid4().hex}",
                                   errors=F.col("app") == "error", long=F.col("duration_ms") > 2000000)
    seen.write.format("noop").mode("overwrite").save()
    got = report.get
    return spark.createDataFrame([(got["rows"], got["errors"], got["long"])], "rows bigint, errors bigint, long bigint")


@check("count_empty_pairs", BASE + """
SELECT count(*) FILTER (times = 1) AS skipped_records, count(*) AS records
FROM (SELECT count(*) AS times FROM trace WHERE app <> 'error' GROUP BY function, ts_ms // 3600000)""")
def _(spark, sf_dir):
    short = _records(spark, sf_dir).withColumn("exec_ms", F.slice("exec_ms", F.lit(1), F.size("exec_ms") - 1))
    return ex.count_empty_pairs(short)


@check("rewrite_ids_own_owners", BASE + LANGUAGES + """
SELECT t.seq, t.owner, fn.benchmark AS function FROM trace t JOIN fn USING (function)""")
def _(spark, sf_dir):
    return lang.rewrite_ids_by_mode(enriched(spark, sf_dir), "hy").select("seq", "owner", "function")


@check("rewrite_ids_by_mode", BASE + LANGUAGES + """
SELECT t.seq, 'user' AS owner, fn.benchmark AS function FROM trace t JOIN fn USING (function)""")
def _(spark, sf_dir):
    return lang.rewrite_ids_by_mode(enriched(spark, sf_dir), "hy-fc").select("seq", "owner", "function")


@check("write_benchmark_mapping", BASE + LANGUAGES + """
SELECT function AS "HashFunction", benchmark AS "Benchmark" FROM fn""")
def _(spark, sf_dir):
    return wr.benchmark_mapping_frame(_languages(spark, sf_dir))


@check("write_enriched_trace", BASE + LANGUAGES + """
SELECT owner AS "HashOwner", t.function AS "HashFunction", CAST(memory_mb AS BIGINT) AS "AverageAllocatedMb",
       t.duration_ms AS "AverageDuration", ts_ms AS "Timestamp", language AS "Language", benchmark AS "Benchmark"
FROM trace t JOIN fn USING (function)""")
def _(spark, sf_dir):
    frame = wr.enriched_trace_frame(trace(spark, sf_dir), _languages(spark, sf_dir))
    return frame.withColumn("AverageAllocatedMb", F.col("AverageAllocatedMb").cast("bigint"))


@check("language_stats", BASE + LANGUAGES + """
SELECT language, count(*) AS functions, CAST(sum(invocations) AS BIGINT) AS invocations,
       CAST(trunc((SELECT count(*) FROM trace)
            * CASE language WHEN 'javascript' THEN 0.48 WHEN 'python' THEN 0.24 ELSE 0.28 END) AS BIGINT) AS expected
FROM fn GROUP BY language""")
def _(spark, sf_dir):
    return lang.language_stats(_languages(spark, sf_dir))


MIX = """, mix AS (
  SELECT language, benchmark, count(*) AS invocations FROM trace t JOIN fn USING (function)
  GROUP BY ROLLUP (language, benchmark) HAVING language IS NOT NULL)"""


@check("trace_mix", BASE + LANGUAGES + MIX + " SELECT language, benchmark, invocations FROM mix")
def _(spark, sf_dir):
    return agg.trace_mix(enriched(spark, sf_dir))


@check("apportion", BASE + LANGUAGES + MIX + """
SELECT language, invocations, round(invocations * 416 / (SELECT count(*) FROM trace), 6) AS instances
FROM mix WHERE benchmark IS NULL""")
def _(spark, sf_dir):
    out = agg.apportion(agg.trace_mix(enriched(spark, sf_dir)))
    return out.withColumn("instances", F.round("instances", 6))


# --- joins -------------------------------------------------------------------------

PROFILES = """, durations AS (
  SELECT function, CAST(floor(avg(duration_ms)) AS BIGINT) AS duration_ms FROM trace
  GROUP BY function HAVING max(duration_ms) > 2500000),
memories AS (
  SELECT app, CAST(floor(avg(memory_mb)) AS BIGINT) AS memory_mb FROM trace GROUP BY app)"""


def _profiles(spark, sf_dir):
    """Durations of the functions that were ever slow, and memory of every app."""
    tr = based_trace(spark, sf_dir)
    durations = (tr.groupBy("function").agg(F.floor(F.avg("duration_ms")).alias("duration_ms"),
                                            F.max("duration_ms").alias("_peak"))
                 .where("_peak > 2500000").drop("_peak"))
    return durations, tr.groupBy("app").agg(F.floor(F.avg("memory_mb")).alias("memory_mb"))


@check("attach_profile", BASE + COUNTS + PROFILES + """
SELECT owner, app, function, CAST(minute AS BIGINT) AS minute, count, duration_ms, memory_mb
FROM counts JOIN durations USING (function) JOIN memories USING (app)""")
def _(spark, sf_dir):
    out = ex.attach_profile(minute_counts(spark, sf_dir), *_profiles(spark, sf_dir))
    return out.select("owner", "app", "function", *big("minute", "count", "duration_ms", "memory_mb"))


@check("count_unprofiled", BASE + COUNTS + PROFILES + """
SELECT count(DISTINCT function) AS functions, count(DISTINCT function)
       FILTER (function NOT IN (SELECT function FROM durations)) AS skipped FROM counts""")
def _(spark, sf_dir):
    return ex.count_unprofiled(minute_counts(spark, sf_dir), *_profiles(spark, sf_dir))


@check("counts_to_trace", BASE + EXPANDED.replace("'11'", "'11'") + PROFILES + """
SELECT owner, function, memory_mb, duration_ms, CAST(ts_ms AS BIGINT) AS ts_ms, CAST(seq AS BIGINT) AS seq
FROM expanded JOIN durations USING (function) JOIN memories USING (app)""")
def _(spark, sf_dir):
    tr = pipe.counts_to_trace(minute_counts(spark, sf_dir), *_profiles(spark, sf_dir), seed=11)
    return tr.withColumn("memory_mb", F.col("memory_mb").cast("bigint"))


def _records(spark, sf_dir):
    return rd.parse_app_events(_hourly_records(spark, sf_dir))


@check("attach_app_memory", BASE + CONFIG + """
SELECT owner AS namespace, function AS app, c.memory_mb, count(DISTINCT ts_ms // 3600000) AS records
FROM trace t JOIN config c ON c.namespace = t.owner AND c.app = t.function GROUP BY ALL""")
def _(spark, sf_dir):
    out = ex.attach_app_memory(_records(spark, sf_dir), _config(spark, sf_dir))
    return out.groupBy("namespace", "app", "memory_mb").agg(F.count("*").alias("records"))


@check("count_missing_memory", BASE + """
SELECT count(DISTINCT (function, ts_ms // 3600000)) AS skipped_missing_memory
FROM trace WHERE app = 'purchase'""")
def _(spark, sf_dir):
    return ex.count_missing_memory(_records(spark, sf_dir), _config(spark, sf_dir))


@check("zip_event_arrays", BASE + """
SELECT owner AS namespace, function AS app, ts_ms / 1000 AS time_s, CAST(duration_ms AS DOUBLE) AS duration
FROM (SELECT *, row_number() OVER (PARTITION BY function, ts_ms // 3600000 ORDER BY ts_ms DESC, seq DESC) AS back
      FROM trace WHERE app <> 'error') WHERE back > 1""")
def _(spark, sf_dir):
    # One duration fewer than times: the last time of each record pairs with nothing.
    short = _records(spark, sf_dir).withColumn(
        "exec_ms", F.slice("exec_ms", F.lit(1), F.size("exec_ms") - 1))
    return ex.zip_event_arrays(short).select("namespace", "app", "time_s", "duration")


@check("event_arrays_to_rows", BASE + CONFIG + """
SELECT t.owner AS namespace, t.function AS app, c.memory_mb, t.duration_ms, t.ts_ms
FROM trace t JOIN config c ON c.namespace = t.owner AND c.app = t.function""")
def _(spark, sf_dir):
    rows = pipe.event_arrays_to_rows(_records(spark, sf_dir), _config(spark, sf_dir))
    return rows.select("namespace", "app", *big("memory_mb", "duration_ms", "ts_ms"))


@check("event_rows_to_trace", BASE + """
SELECT owner, function, CAST(memory_mb AS BIGINT) AS memory_mb,
       CAST(floor(duration_ms / 4 + 0.5) AS BIGINT) AS duration_ms, ts_ms, seq
FROM trace WHERE app <> 'error' AND floor(duration_ms / 4 + 0.5) > 0 AND ts_ms < 10080 * 60000""")
def _(spark, sf_dir):
    rows = rd.parse_event_rows(_event_lines(spark, sf_dir)).withColumnRenamed("row_pos", "seq")
    tr = pipe.event_rows_to_trace(rows, 0, 10079)
    return tr.withColumn("memory_mb", F.col("memory_mb").cast("bigint"))


REPORTED = """, rows AS (
  SELECT owner, function, seq, ts_ms < 5040 * 60000 AS inside, memory_mb > 0 AS sized, floor(duration_ms / 4 + 0.5) > 0 AS timed
  FROM trace WHERE app <> 'error'),
loaded AS (SELECT * FROM rows WHERE inside AND sized AND timed),
best AS (SELECT owner, count(DISTINCT function) AS f FROM loaded GROUP BY owner ORDER BY f DESC, owner LIMIT 7),
generated AS (SELECT * FROM loaded WHERE owner IN (SELECT owner FROM best))"""


def _reported(spark, sf_dir):
    rows = rd.parse_event_rows(_event_lines(spark, sf_dir)).withColumnRenamed("row_pos", "seq")
    return pipe.generate_reported(rows, 0, 5039, {"users": 7})


@check("generate_report", BASE + REPORTED + """
SELECT 0 AS pos, 'read' AS step, count(*) AS rows FROM rows
UNION ALL SELECT 1, 'outside_range', count(*) FILTER (NOT inside) FROM rows
UNION ALL SELECT 2, 'no_memory', count(*) FILTER (inside AND NOT sized) FROM rows
UNION ALL SELECT 3, 'no_duration', count(*) FILTER (inside AND sized AND NOT timed) FROM rows
UNION ALL SELECT 4, 'loaded', count(*) FROM loaded
UNION ALL SELECT 5, 'generated', count(*) FROM generated""")
def _(spark, sf_dir):
    return _reported(spark, sf_dir)[1]


@check("generate_reported", BASE + REPORTED + " SELECT owner, function, seq FROM generated")
def _(spark, sf_dir):
    return _reported(spark, sf_dir)[0].select("owner", "function", "seq")


@check("align_matrices", BASE + POSITIONS + """
SELECT time_s, pos, CAST(n AS DOUBLE) AS count, round(delay, 6) AS delay_ms, round(memory, 6) AS memory
FROM cells WHERE memory IS NOT NULL""")
def _(spark, sf_dir):
    out = ex.align_matrices(*[_matrix(spark, sf_dir, c) for c in ("n", "delay", "memory")])
    return out.select(*big("time_s", "pos"), "count", F.round("delay_ms", 6).alias("delay_ms"),
                      F.round("memory", 6).alias("memory"))


@check("matrices_to_trace", BASE + POSITIONS + f""", rows AS (
  SELECT 'owner_' || pos AS owner, 'f_' || pos AS function, CAST(floor(memory + 0.5) AS BIGINT) AS memory_mb,
         CAST(floor(delay + 0.5) AS BIGINT) AS duration_ms, time_s, time_s // 60 AS minute,
         unnest(range(1, n + 1)) AS i FROM cells WHERE memory IS NOT NULL)
SELECT owner, function, memory_mb, duration_ms,
       CAST(time_s * 1000 + {hash_sql('function', 'minute', 'i', '2')} % 60000 AS BIGINT) AS ts_ms,
       CAST(minute * 4294967296 + i AS BIGINT) AS seq FROM rows""")
def _(spark, sf_dir):
    tr = pipe.matrices_to_trace(*[_matrix(spark, sf_dir, c) for c in ("n", "delay", "memory")], seed=2)
    return tr.withColumn("memory_mb", F.col("memory_mb").cast("bigint"))


@check("keep_selected", BASE + """
SELECT function, seq FROM trace
WHERE function IN (SELECT function FROM trace GROUP BY function HAVING avg(duration_ms) > 500000)""")
def _(spark, sf_dir):
    tr = trace(spark, sf_dir)
    slow = tr.groupBy("function").agg(F.avg("duration_ms").alias("m")).where("m > 500000")
    return ex.keep_selected(tr, slow, "function").select("function", "seq")


# --- aggregations ---------------------------------------------------------------------

@check("rate_by_function", BASE + COUNTS + """
SELECT function, round(sum(count) / 1440, 6) AS per_minute FROM counts GROUP BY function""")
def _(spark, sf_dir):
    return agg.rate_by_function(minute_counts(spark, sf_dir)).withColumn("per_minute", F.round("per_minute", 6))


@check("rate_by_function_last_row", BASE + """
SELECT function, round(arg_max(n, day) / 1440, 6) AS per_minute
FROM (SELECT function, ts_ms // 86400000 AS day, count(*) AS n FROM trace GROUP BY ALL) GROUP BY function""")
def _(spark, sf_dir):
    counts = trace(spark, sf_dir).groupBy(
        "function", F.floor(F.col("ts_ms") / 86_400_000).alias("row_pos"),
        (1 + time_chunk("ts_ms", MINUTE) % 1440).alias("minute")).agg(F.count("*").alias("count"))
    return agg.rate_by_function(counts, last_row=True).withColumn("per_minute", F.round("per_minute", 6))


@check("minute_vector_by_owner", BASE + COUNTS + """
SELECT owner, CAST(minute AS BIGINT) AS minute, CAST(sum(count) AS BIGINT) AS count FROM counts GROUP BY ALL""")
def _(spark, sf_dir):
    return agg.minute_vector_by_owner(minute_counts(spark, sf_dir))


@check("rate_by_owner", BASE + COUNTS + """
SELECT owner, round(sum(count) / 1440, 6) AS per_minute FROM counts GROUP BY owner""")
def _(spark, sf_dir):
    return agg.rate_by_owner(minute_counts(spark, sf_dir)).withColumn("per_minute", F.round("per_minute", 6))


@check("ranked_rates", BASE + COUNTS + """
SELECT owner, round(sum(count) / 1440, 6) AS per_minute FROM counts GROUP BY owner ORDER BY 2, 1""")
def _(spark, sf_dir):
    rates = agg.rate_by_owner(minute_counts(spark, sf_dir)).withColumn("per_minute", F.round("per_minute", 6))
    return agg.ranked_rates(rates, "owner")


@check("count_by_function", BASE + " SELECT function, count(*) AS invocations FROM trace GROUP BY function")
def _(spark, sf_dir):
    return agg.count_by_function(trace(spark, sf_dir))


@check("functions_by_owner", BASE + " SELECT owner, count(DISTINCT function) AS functions FROM trace GROUP BY owner")
def _(spark, sf_dir):
    return agg.functions_by_owner(trace(spark, sf_dir))


@check("owner_summary", BASE + """
SELECT owner, count(DISTINCT function) AS functions, count(*) AS invocations FROM trace GROUP BY owner""")
def _(spark, sf_dir):
    return agg.owner_summary(trace(spark, sf_dir))


@check("dense_ids", BASE + """
SELECT owner, row_number() OVER (ORDER BY first_seq) - 1 AS id
FROM (SELECT owner, min(seq) AS first_seq FROM trace GROUP BY owner)""")
def _(spark, sf_dir):
    return agg.dense_ids(trace(spark, sf_dir), "owner")


@check("replace_ids", BASE + """, ids AS (
  SELECT function, row_number() OVER (ORDER BY first_seq) - 1 AS id
  FROM (SELECT function, min(seq) AS first_seq FROM trace GROUP BY function))
SELECT seq, CAST(id AS VARCHAR) AS function FROM trace JOIN ids USING (function)""")
def _(spark, sf_dir):
    tr = trace(spark, sf_dir)
    return agg.replace_ids(tr, agg.dense_ids(tr, "function"), "function").select("seq", "function")


@check("first_duration", BASE + """
SELECT function, arg_min(duration_ms, (ts_ms, seq)) AS duration_ms FROM trace GROUP BY function""")
def _(spark, sf_dir):
    return agg.first_duration(trace(spark, sf_dir))


def response_log(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), k.alias("k"))
    tr = trace(spark, sf_dir).join(ev, "seq")
    received = F.col("ts_ms") + F.col("k") % 5
    responded = received + F.col("duration_ms") + F.col("k") % 3
    return tr.select(F.col("seq").alias("request_id"), F.col("ts_ms").alias("start_ms"),
                     received.alias("received_ms"), responded.alias("responded_ms"),
                     (responded + F.col("k") % 4).alias("end_ms"), "duration_ms",
                     F.concat(F.lit("w"), F.col("k") % 4).alias("worker"))


@check("response_overhead", BASE + """, log AS (
  SELECT t.*, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM trace t JOIN events ON event_id = seq)
SELECT round(avg(k % 5 + k % 3 + k % 4), 6) AS avg_longer,
       round(avg((duration_ms + k % 5 + k % 3 + k % 4)
                 / CASE WHEN duration_ms = 0 THEN 0.1 ELSE CAST(duration_ms AS DOUBLE) END), 6) AS avg_increase,
       round(avg(k % 5), 6) AS avg_send, round(avg(duration_ms + k % 3), 6) AS avg_worker,
       round(avg(duration_ms), 6) AS avg_planned, round(avg(k % 4), 6) AS avg_receive,
       count(*) AS responses FROM log""")
def _(spark, sf_dir):
    out = agg.response_overhead(response_log(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns if c != "responses"], "responses")


@check("worker_summary", BASE + """, log AS (
  SELECT *, 'w' || (seq % 4) AS worker FROM trace),
moves AS (SELECT worker, ts_ms AS time, memory_mb AS mb FROM log
          UNION ALL SELECT worker, ts_ms + duration_ms, -memory_mb FROM log),
levels AS (SELECT worker, sum(sum(mb)) OVER (PARTITION BY worker ORDER BY time) AS level
           FROM moves GROUP BY worker, time)
SELECT worker, count(DISTINCT function) AS functions, count(*) AS requests, count(DISTINCT owner) AS owners,
       (SELECT CAST(max(level) AS BIGINT) FROM levels l WHERE l.worker = log.worker) AS peak_mb
FROM log GROUP BY worker""")
def _(spark, sf_dir):
    log = trace(spark, sf_dir).withColumn("worker", F.concat(F.lit("w"), F.col("seq") % 4))
    return ga.worker_summary(log)


def _series(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series"), "value")


@check("series_max", "SELECT event_type AS series, max(value) AS peak FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return ser.series_max(_series(spark, sf_dir))


@check("series_percentiles", """
SELECT event_type AS series, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95
FROM events GROUP BY event_type""")
def _(spark, sf_dir):
    return ser.series_percentiles(_series(spark, sf_dir))


@check("series_cdf", """
SELECT series, value, i, round(i / n, 6) AS fraction FROM (
  SELECT event_type AS series, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
         count(*) OVER (PARTITION BY event_type) AS n FROM events)""")
def _(spark, sf_dir):
    return ser.series_cdf(_series(spark, sf_dir)).withColumn("fraction", F.round("fraction", 6))


@check("series_cdf_nan", """
SELECT series, value, i, round(i / n, 6) AS fraction FROM (
  SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY series) AS n
  FROM (SELECT event_type AS series, CASE WHEN event_id % 9 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM events))
WHERE NOT isnan(value)
UNION ALL SELECT event_type, -1.0, count(*) FILTER (event_id % 9 <> 0), round(count(*) FILTER (event_id % 9 = 0) / count(*), 6)
FROM events GROUP BY event_type""")
def _(spark, sf_dir):
    """NaN compares with nothing, so its rows are told by their first rank and their share."""
    named = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("series"), F.when(F.col("event_id") % 9 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    cdf = ser.series_cdf(named)
    odd = F.isnan("value")
    last = cdf.groupBy("series").agg(F.min(F.when(odd, F.col("i"))).alias("i"), F.round(F.count_if(odd) / F.count("*"), 6).alias("fraction"))
    return (cdf.where(~odd).withColumn("fraction", F.round("fraction", 6))
            .unionByName(last.select("series", F.lit(-1.0).alias("value"), "i", "fraction")))


@check("step_report", BASE + COUNTS + PROFILES + """
SELECT CAST(0 AS BIGINT) AS pos, 'counts' AS step, count(*) AS rows FROM counts
UNION ALL SELECT 1, 'profiled', count(*) FROM counts WHERE function IN (SELECT function FROM durations)
UNION ALL SELECT 2, 'expanded', CAST(sum(count) AS BIGINT) FROM counts
          WHERE function IN (SELECT function FROM durations)""")
def _(spark, sf_dir):
    counts = minute_counts(spark, sf_dir)
    profiled = ex.attach_profile(counts, *_profiles(spark, sf_dir))
    return agg.step_report({"counts": counts, "profiled": profiled,
                            "expanded": ex.expand_counts(profiled)})


# --- sort, top-k, sampling, union ----------------------------------------------------

@check("sort_trace", BASE + TRACE_SQL + "trace ORDER BY ts_ms, owner, function, seq")
def _(spark, sf_dir):
    tr = ex.sort_trace(trace(spark, sf_dir))
    return tr.select("owner", "function", *big("memory_mb", "duration_ms", "ts_ms", "seq"))


@check("top_owners", BASE + """, best AS (
  SELECT owner, count(DISTINCT function) AS f FROM trace WHERE duration_ms > 2000000
  GROUP BY owner ORDER BY f DESC, owner LIMIT 7)
SELECT owner, function, seq FROM trace WHERE owner IN (SELECT owner FROM best)""")
def _(spark, sf_dir):
    tr = trace(spark, sf_dir)
    return down.top_owners(tr, 7, basis=tr.where("duration_ms > 2000000")).select("owner", "function", "seq")


MIDDLE = """, ranked AS (
  SELECT function, count(*) AS invocations, row_number() OVER (ORDER BY count(*), md5(function)) AS rank,
         count(*) OVER () AS total FROM trace GROUP BY function),
band AS (SELECT function, invocations, rank FROM ranked
         WHERE rank > greatest(total - 30, 0) // 2 AND rank <= greatest(total - 30, 0) // 2 + 30)"""


@check("popularity_band", BASE + MIDDLE + " SELECT * FROM band")
def _(spark, sf_dir):
    return down.popularity_band(trace(spark, sf_dir), 30)


@check("middle_functions", BASE + MIDDLE + """
SELECT function, seq FROM trace WHERE function IN (SELECT function FROM band)""")
def _(spark, sf_dir):
    return down.middle_functions(trace(spark, sf_dir), 30).select("function", "seq")


@check("thin_random", BASE + f"""
SELECT function, seq FROM trace WHERE {hash_sql('function', 'seq', '4')} % 3 = 0""")
def _(spark, sf_dir):
    return down.thin_random(trace(spark, sf_dir), 3, seed=4).select("function", "seq")


@check("concat_periods", BASE + """
SELECT function, seq, ts_ms, CAST(0 AS BIGINT) AS period FROM trace
UNION ALL SELECT function, seq, ts_ms + 604800000, 1 FROM trace""")
def _(spark, sf_dir):
    tr = trace(spark, sf_dir).select("function", "seq", "ts_ms")
    weeks = [tr.withColumn("ts_ms", ex.offset_weeks(F.col("ts_ms"), F.lit(w), 1))
             .withColumn("period", F.lit(w - 1).cast("bigint")) for w in (1, 2)]
    return ex.concat_periods(*weeks)


def _greedy_sql(source, limit, weight, order="ts_ms, owner, function, seq", by=None):
    """Greedy admission of ``source`` one row at a time, per ``by``."""
    part = f"PARTITION BY {by} " if by else ""
    key = f"{by} AS k" if by else "0 AS k"
    return f""", line AS (
  SELECT seq, {key}, {limit} AS cap, {weight} AS w, ts_ms, ts_ms + duration_ms AS e,
         row_number() OVER ({part}ORDER BY {order}) AS rn FROM {source}),
greedy AS (
  SELECT k, rn, seq, w <= cap AS admitted,
         CASE WHEN w <= cap THEN [{{'e': e, 'w': w}}] ELSE [] END AS live FROM line WHERE rn = 1
  UNION ALL
  SELECT k, rn, seq, held + w <= cap,
         CASE WHEN held + w <= cap THEN list_append(kept, {{'e': e, 'w': w}}) ELSE kept END
  FROM (SELECT *, coalesce(list_sum(list_transform(kept, lambda r: r.w)), 0) AS held
        FROM (SELECT l.*, list_filter(g.live, lambda r: r.e > l.ts_ms) AS kept
              FROM greedy g JOIN line l ON l.k = g.k AND l.rn = g.rn + 1))),
admitted AS (SELECT seq FROM greedy WHERE admitted)"""


LONGER = """, longer AS (SELECT * REPLACE (duration_ms * 6 AS duration_ms) FROM trace)"""


def _longer(spark, sf_dir):
    return trace(spark, sf_dir).withColumn("duration_ms", F.col("duration_ms") * 6)


@check("cap_concurrency", BASE + LONGER + _greedy_sql("longer", "15", "1") + " SELECT seq FROM admitted")
def _(spark, sf_dir):
    return down.cap_concurrency(_longer(spark, sf_dir), 15, mode="exact").select("seq")


@check("cap_concurrency_by", BASE + LONGER + _greedy_sql("longer", "1", "1", by="owner")
       + " SELECT seq FROM admitted")
def _(spark, sf_dir):
    return down.cap_concurrency(_longer(spark, sf_dir), 1, mode="exact", by=["owner"]).select("seq")


SHARDED = LONGER + f""", sharded AS (
  SELECT *, {hash_sql('function', 'seq', '0')} % 4 AS shard FROM longer)"""


@check("cap_concurrency_sharded", BASE + SHARDED
       + _greedy_sql("sharded", "2 + CASE WHEN shard < 2 THEN 1 ELSE 0 END", "1", by="shard")
       + " SELECT seq FROM admitted")
def _(spark, sf_dir):
    return down.cap_concurrency(_longer(spark, sf_dir), 10, mode="sharded", shards=4).select("seq")


@check("cap_memory", BASE + LONGER + _greedy_sql("longer", "8192", "memory_mb") + " SELECT seq FROM admitted")
def _(spark, sf_dir):
    return down.cap_memory(_longer(spark, sf_dir), 8192, mode="exact").select("seq")


@check("cap_memory_by", BASE + LONGER + _greedy_sql("longer", "1024", "memory_mb", by="owner")
       + " SELECT seq FROM admitted")
def _(spark, sf_dir):
    return down.cap_memory(_longer(spark, sf_dir), 1024, mode="exact", by=["owner"]).select("seq")


def _shard_sql(limit, weight):
    """Rows with their shard and its part of the cap: as many shards as parts that hold the heaviest row."""
    return LONGER + f""", parts AS (
  SELECT least(256, {limit} // max({weight})) AS shards FROM longer WHERE {weight} <= {limit}),
sharded AS (
  SELECT l.*, {hash_sql('function', 'seq', '0')} % shards AS shard, {limit} // shards AS part, {limit} % shards AS rest, shards
  FROM longer l, parts)"""


PART = "part + CASE WHEN shard < rest THEN 1 ELSE 0 END"


@check("cap_concurrency_saturated", BASE + _shard_sql(4, "1") + _greedy_sql("sharded", PART, "1", by="shard")
       + " SELECT seq FROM admitted")
def _(spark, sf_dir):
    return down.cap_concurrency(_longer(spark, sf_dir), 4).select("seq")


@check("cap_memory_sharded", BASE + _shard_sql(8500, "memory_mb") + _greedy_sql("sharded", PART, "memory_mb", by="shard")
       + " SELECT seq FROM admitted")
def _(spark, sf_dir):
    return down.cap_memory(_longer(spark, sf_dir), 8500).select("seq")


@check("cap_memory_saturated", BASE + _shard_sql(2048, "memory_mb") + _greedy_sql("sharded", PART, "memory_mb", by="shard")
       + " SELECT seq FROM admitted")
def _(spark, sf_dir):
    return down.cap_memory(_longer(spark, sf_dir), 2048).select("seq")


@check("downscale", BASE + LONGER + """, ranked AS (
  SELECT function, row_number() OVER (ORDER BY count(*), md5(function)) AS rank,
         count(*) OVER () AS total FROM longer GROUP BY function),
one AS (SELECT * FROM longer WHERE function IN (SELECT function FROM ranked
        WHERE rank > greatest(total - 60, 0) // 2 AND rank <= greatest(total - 60, 0) // 2 + 60))"""
       + _greedy_sql("one", "8", "1").replace("line", "line1").replace("greedy", "greedy1")
       .replace("admitted AS (SELECT", "admitted1 AS (SELECT")
       + """, two AS (SELECT * FROM one WHERE seq IN (SELECT seq FROM admitted1)),
best AS (SELECT owner, count(DISTINCT function) AS f FROM two GROUP BY owner ORDER BY f DESC, owner LIMIT 12),
three AS (SELECT * FROM two WHERE owner IN (SELECT owner FROM best))"""
       + _greedy_sql("three", "2048", "memory_mb").replace("line", "line2").replace("greedy", "greedy2")
       .replace("admitted AS (SELECT", "admitted2 AS (SELECT")
       + " SELECT seq FROM admitted2")
def _(spark, sf_dir):
    return down.downscale(_longer(spark, sf_dir), functions=60, concurrency=8, users=12,
                          memory=2048, mode="exact").select("seq")


# --- starts ---------------------------------------------------------------------------

def _starts_sql(source="trace", keepalive=KEEPALIVE):
    """The pool of each function, one row at a time."""
    return f""", ordered AS (
  SELECT *, row_number() OVER (PARTITION BY function ORDER BY ts_ms, seq) AS rn FROM {source}),
sim AS (
  SELECT function, rn, seq, CAST(NULL AS BIGINT) AS previous, seq AS root,
         [{{'e': ts_ms + duration_ms, 't': ts_ms, 's': seq, 'root': seq}}] AS pool FROM ordered WHERE rn = 1
  UNION ALL
  SELECT function, rn, seq, best.s, coalesce(best.root, seq),
         list_append(list_filter(alive, lambda r: best IS NULL OR r.s <> best.s),
                     {{'e': ts_ms + duration_ms, 't': ts_ms, 's': seq, 'root': coalesce(best.root, seq)}})
  FROM (SELECT *, list_min(list_filter(alive, lambda r: r.e <= ts_ms)) AS best
        FROM (SELECT o.*, list_filter(p.pool, lambda r: o.ts_ms < r.e + {keepalive}) AS alive
              FROM sim p JOIN ordered o ON o.function = p.function AND o.rn = p.rn + 1))),
starts AS (
  SELECT t.*, s.previous IS NULL AS cold, n.ts_ms AS reused_at, s.root AS container_id
  FROM ordered t JOIN sim s ON s.function = t.function AND s.seq = t.seq
  LEFT JOIN (SELECT x.function, x.previous, o.ts_ms FROM sim x JOIN ordered o ON o.function = x.function
             AND o.seq = x.seq WHERE x.previous IS NOT NULL) n
    ON n.function = t.function AND n.previous = t.seq)"""


@check("cold_starts", BASE + _starts_sql() + " SELECT function, seq, cold FROM starts")
def _(spark, sf_dir):
    return st.cold_starts(trace(spark, sf_dir), KEEPALIVE).select("function", "seq", "cold")


@check("classify_starts", BASE + _starts_sql() + """
SELECT function, seq, cold, reused_at, container_id FROM starts""")
def _(spark, sf_dir):
    return (st.classify_starts(trace(spark, sf_dir), KEEPALIVE, containers=True)
            .select("function", "seq", "cold", "reused_at", "container_id"))


@check("active_segments", BASE + f""", gaps AS (
  SELECT *, max(ts_ms + duration_ms + {KEEPALIVE}) OVER (PARTITION BY function ORDER BY ts_ms, seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM trace)
SELECT function, seq, CAST(sum(CASE WHEN until IS NULL OR ts_ms >= until THEN 1 ELSE 0 END)
       OVER (PARTITION BY function ORDER BY ts_ms, seq) AS BIGINT) AS segment FROM gaps""")
def _(spark, sf_dir):
    return st.active_segments(trace(spark, sf_dir), KEEPALIVE).select("function", "seq", "segment")


HOT = f""", cold AS (SELECT * FROM starts WHERE cold),
hits AS (SELECT *, lag(ts_ms, {HOT_N}) OVER w >= ts_ms - {HOT_PERIOD} AS hit
         FROM cold WINDOW w AS (PARTITION BY function ORDER BY ts_ms, seq)),
flags AS (SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY function ORDER BY ts_ms, seq), FALSE) AS hot
          FROM hits)"""


@check("hot_functions", BASE + _starts_sql() + HOT + """
SELECT function, min(ts_ms) AS hot_since, count(*) AS hot_cold_starts FROM flags WHERE hot GROUP BY function""")
def _(spark, sf_dir):
    cold = st.cold_starts(trace(spark, sf_dir), KEEPALIVE).where("cold")
    return st.hot_functions(cold, HOT_N, HOT_PERIOD)


@check("hot_functions_zero_fill", BASE + f""", hits AS (
  SELECT *, row_number() OVER w > 1 AND coalesce(lag(ts_ms, 3) OVER w, 0) >= ts_ms - 86400000 AS hit
  FROM trace WINDOW w AS (PARTITION BY function ORDER BY ts_ms, seq)),
flags AS (SELECT *, bool_or(hit) OVER (PARTITION BY function ORDER BY ts_ms, seq) AS hot FROM hits)
SELECT function, min(ts_ms) AS hot_since, count(*) AS hot_cold_starts FROM flags WHERE hot GROUP BY function""")
def _(spark, sf_dir):
    return st.hot_functions(trace(spark, sf_dir), 3, 86_400_000, zero_fill=True)


OPTIMISED = HOT + """, optimised AS (
  SELECT s.owner, s.function, s.seq, s.ts_ms, s.duration_ms, s.cold, s.reused_at, s.container_id,
         f.hot AS optimised, CAST(CASE WHEN f.hot THEN trunc(f.memory_mb * 0.375) ELSE f.memory_mb END AS BIGINT) AS memory_mb
  FROM starts s JOIN flags f ON f.function = s.function AND f.seq = s.container_id)"""


def _optimised(spark, sf_dir):
    return st.classify_optimised(trace(spark, sf_dir), KEEPALIVE, HOT_N, HOT_PERIOD)


@check("classify_optimised", BASE + _starts_sql() + OPTIMISED + """
SELECT function, seq, memory_mb, cold, container_id, optimised FROM optimised""")
def _(spark, sf_dir):
    return _optimised(spark, sf_dir).select("function", "seq", *big("memory_mb"), "cold",
                                            "container_id", "optimised")


# --- gauges ------------------------------------------------------------------------------

@check("sample_counts", BASE + _starts_sql() + """
SELECT max(ts_ms) AS ts_ms, count(*) AS invocations, count(*) FILTER (cold) AS cold
FROM starts GROUP BY ts_ms // 1000""")
def _(spark, sf_dir):
    return ga.sample_counts(st.cold_starts(trace(spark, sf_dir), KEEPALIVE))


@check("per_sample_delta", BASE + SAMPLES + """, done AS (
  SELECT s AS ts_ms, count(*) AS processed FROM samples JOIN trace ON ts_ms <= s GROUP BY s)
SELECT ts_ms, processed, processed - lag(processed, 1, 0) OVER (ORDER BY ts_ms) AS invocations FROM done""")
def _(spark, sf_dir):
    tr = trace(spark, sf_dir)
    per = tr.groupBy(F.floor(F.col("ts_ms") / 1000).alias("b")).agg(
        F.max("ts_ms").alias("ts_ms"), F.count("*").alias("n"))
    done = running(per, keys=[], chunk=time_chunk("ts_ms", 3_600_000), order=["ts_ms"],
                   sums={"processed": F.col("n")}).select("ts_ms", "processed")
    return ga.per_sample_delta(done, "processed", "invocations")


@check("running_gauges", BASE + PLAIN_LOAD + """
SELECT s AS ts_ms, running AS running_invocations, CAST(mb AS BIGINT) AS running_mb FROM load""")
def _(spark, sf_dir):
    return ga.running_gauges(trace(spark, sf_dir))


@check("running_distinct", BASE + PLAIN_LOAD + """
SELECT s AS ts_ms, users AS running_users, functions AS running_functions FROM load""")
def _(spark, sf_dir):
    return ga.running_distinct(trace(spark, sf_dir))


def _gauge_sql(records, optimised=""):
    return SAMPLES + f""", rec AS (
  SELECT *, least(coalesce(reused_at, ts_ms + duration_ms + {KEEPALIVE}), ts_ms + duration_ms + {KEEPALIVE}) AS freed
  FROM {records}),
gauge AS (
  SELECT s, count(*) FILTER (s < ts_ms + duration_ms) AS running_invocations,
         count(DISTINCT owner) FILTER (s < ts_ms + duration_ms) AS running_users,
         count(DISTINCT function) FILTER (s < ts_ms + duration_ms) AS running_functions,
         coalesce(sum(memory_mb) FILTER (s < ts_ms + duration_ms), 0) AS running_mb,
         count(DISTINCT owner) AS users, count(DISTINCT function) AS functions,
         coalesce(sum(memory_mb) FILTER (s >= ts_ms + duration_ms), 0) AS cached_mb
         {", count(DISTINCT function) FILTER (s < ts_ms + duration_ms AND optimised) AS running_optimised_functions" if optimised else ""}
  FROM samples LEFT JOIN rec ON ts_ms <= s AND s < freed GROUP BY s),
bucket AS (
  SELECT max(ts_ms) AS s, count(*) AS invocations, count(*) FILTER (cold) AS cold
         {", count(*) FILTER (cold AND optimised) AS optimised_cold" if optimised else ""}
  FROM rec GROUP BY ts_ms // 1000)
SELECT s AS ts_ms, invocations, cold, running_users, running_functions, running_invocations,
       CAST(running_mb AS BIGINT) AS running_mb, users - running_users AS cached_users,
       functions - running_functions AS cached_functions, CAST(cached_mb AS BIGINT) AS cached_mb
       {", optimised_cold, running_optimised_functions" if optimised else ""}
FROM bucket JOIN gauge USING (s)"""


@check("gauges", BASE + _starts_sql() + _gauge_sql("starts"))
def _(spark, sf_dir):
    return ga.gauges(st.classify_starts(trace(spark, sf_dir), KEEPALIVE), KEEPALIVE).select(*big(*ga.GAUGES))


@check("optimised_gauges", BASE + _starts_sql() + OPTIMISED + _gauge_sql("optimised", "yes"))
def _(spark, sf_dir):
    return ga.gauges(_optimised(spark, sf_dir), KEEPALIVE).select(*big(*ga.GAUGES, *ga.OPTIMISED_GAUGES))


# The rule itself: every sample is the first arrival more than the gap after the last one, the first after 0.
GAP = 600_000
JUMPS = f""", instants AS (SELECT DISTINCT ts_ms FROM trace UNION SELECT 0),
jumps AS (SELECT a.ts_ms AS s, min(b.ts_ms) AS next FROM instants a ASOF JOIN instants b ON a.ts_ms + {GAP} < b.ts_ms GROUP BY ALL),
orbit AS (SELECT next AS s FROM jumps WHERE s = 0 UNION ALL SELECT jumps.next FROM orbit JOIN jumps USING (s)),
samples AS (SELECT s FROM orbit UNION SELECT max(ts_ms) FROM trace)"""


@check("sample_times", BASE + JUMPS + " SELECT s AS ts_ms FROM samples")
def _(spark, sf_dir):
    return sa.sample_times(trace(spark, sf_dir), GAP)


@check("sample_times_cut", ORACLES["sample_times"])
def _(spark, sf_dir):
    return sa.sample_times(trace(spark, sf_dir), GAP, chunk_ms=400_000)


@check("gauges_at_samples", BASE + _starts_sql() + _gauge_sql("starts").replace(SAMPLES, JUMPS).replace(
    "SELECT max(ts_ms) AS s, count(*) AS invocations", "SELECT s, count(*) AS invocations").replace(
    "FROM rec GROUP BY ts_ms // 1000)", "FROM rec ASOF JOIN samples ON rec.ts_ms <= samples.s GROUP BY s)"))
def _(spark, sf_dir):
    tr = trace(spark, sf_dir)
    return ga.gauges(st.classify_starts(tr, KEEPALIVE), KEEPALIVE, samples=sa.sample_times(tr, GAP)).select(*big(*ga.GAUGES))


def _vm_sql(inner):
    return SAMPLES + f""", sized AS (
  SELECT *, first_value(memory_mb) OVER (PARTITION BY owner, function ORDER BY ts_ms, seq) AS mb FROM trace),
live AS (SELECT s, owner, function, mb, seq FROM samples JOIN sized ON ts_ms <= s AND s < ts_ms + duration_ms),
grouped AS ({inner}),
vm AS (SELECT s AS ts_ms, CAST(coalesce(sum(ceil(load / 1024)), 0) AS BIGINT) AS vms
       FROM samples LEFT JOIN grouped USING (s) GROUP BY s)"""


@check("vm_footprint_function", BASE + _vm_sql("SELECT s, function, sum(mb) AS load FROM live GROUP BY ALL") + """
SELECT ts_ms, vms, vms * 1024 AS footprint_mb FROM vm""")
def _(spark, sf_dir):
    return ga.vm_footprint(trace(spark, sf_dir), "function")


# A rule that is not built in: an application's functions share VMs, which come in pairs.
@check("vm_footprint_rule", BASE + _vm_sql("SELECT s, split_part(function, '_', 2) AS app, sum(mb) AS load FROM live GROUP BY ALL").replace(
    "sum(ceil(load / 1024))", "sum(2 * ceil(load / 2048))") + " SELECT ts_ms, vms, vms * 1024 AS footprint_mb FROM vm")
def _(spark, sf_dir):
    pairs = ga.IsolationRule(("app",), lambda mb: 2 * ceil_div(mb, 2048))
    return ga.vm_footprint(based_trace(spark, sf_dir), pairs)


OWNER_VMS = _vm_sql("SELECT s, owner, sum(mb) AS load FROM live GROUP BY ALL")


@check("vm_footprint_owner", BASE + OWNER_VMS + " SELECT ts_ms, vms, vms * 1024 AS footprint_mb FROM vm")
def _(spark, sf_dir):
    return ga.vm_footprint(trace(spark, sf_dir), "owner")


@check("vm_footprint_invocation", BASE + PLAIN_LOAD + """
SELECT s AS ts_ms, CAST(mb // 1024 AS BIGINT) AS vms, CAST(mb AS BIGINT) AS footprint_mb FROM load""")
def _(spark, sf_dir):
    return ga.vm_footprint(trace(spark, sf_dir), "invocation")


@check("capacity_check", BASE + OWNER_VMS + """
SELECT ts_ms, vms, vms * 1024 AS footprint_mb, 3 * 1024 - vms * 1024 AS headroom_mb
FROM vm WHERE vms * 1024 > 3 * 1024""")
def _(spark, sf_dir):
    return ga.capacity_check(ga.vm_footprint(trace(spark, sf_dir), "owner"), workers=3, mb=1024)


# --- the same operators with histories cut into many chunks ------------------------------

CUT = 40


@check("cold_starts_cut", ORACLES["cold_starts"])
def _(spark, sf_dir):
    return st.cold_starts(trace(spark, sf_dir), KEEPALIVE, chunk_rows=CUT).select("function", "seq", "cold")


@check("active_segments_cut", ORACLES["active_segments"])
def _(spark, sf_dir):
    return st.active_segments(trace(spark, sf_dir), KEEPALIVE, chunk_rows=CUT).select("function", "seq", "segment")


@check("hot_functions_cut", ORACLES["hot_functions_zero_fill"])
def _(spark, sf_dir):
    return st.hot_functions(trace(spark, sf_dir), 3, 86_400_000, zero_fill=True, chunk_rows=CUT)


@check("gauges_cut", ORACLES["gauges"])
def _(spark, sf_dir):
    starts = st.classify_starts(trace(spark, sf_dir), KEEPALIVE, chunk_rows=CUT)
    return ga.gauges(starts, KEEPALIVE, chunk_rows=CUT).select(*big(*ga.GAUGES))


@check("vm_footprint_cut", ORACLES["vm_footprint_owner"])
def _(spark, sf_dir):
    return ga.vm_footprint(trace(spark, sf_dir), "owner", chunk_rows=CUT)


@check("cap_memory_cut", ORACLES["cap_memory"])
def _(spark, sf_dir):
    return down.cap_memory(_longer(spark, sf_dir), 8192, mode="exact", chunk_rows=CUT).select("seq")


# --- streams: all rows in one run, then a closing row ---------------------------------------

def _stream_trace(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return as_event_trace(rows).select(*TRACE)


def _finished(df):
    """Run a stream over what is there, into a table."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (df.writeStream.format("parquet").option("path", f"{folder}/rows")
             .option("checkpointLocation", f"{folder}/state").outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def _whole(spark, sf_dir, step):
    return strm.run_to_end(_stream_trace(spark, sf_dir), step, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


TIMED = """, timed AS (SELECT seq, owner, function, memory_mb, duration_ms, raw_ms AS ts_ms FROM raw)"""


@check("stream_load", BASE + """
SELECT owner, function, CAST(memory_mb AS BIGINT) AS memory_mb, duration_ms, ts_ms,
       CAST(sum(CASE WHEN seq % 3 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS rows,
       CAST(sum(CASE WHEN seq % 3 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS positions FROM trace GROUP BY ALL""")
def _(spark, sf_dir):
    """Trace files with equal lines: each line is a row with a position of its own."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    line = F.concat_ws(",", *[F.col(c) for c in wr.TRACE_FIELDS]).alias("value")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("seq") % 3 == 0, 3).otherwise(1)))
    trace(spark, sf_dir).select(line, copies).select("value").write.text(folder)
    out = _finished(strm.stream_load(spark, folder))
    return out.groupBy("owner", "function", F.col("memory_mb").cast("bigint").alias("memory_mb"), "duration_ms", "ts_ms").agg(
        F.count("*").alias("rows"), F.count_distinct("seq").alias("positions"))


@check("trace_files", BASE + """
SELECT owner, function, CAST(memory_mb AS BIGINT) AS memory_mb, duration_ms, ts_ms, count(*) AS rows FROM trace GROUP BY ALL""")
def _(spark, sf_dir):
    """Written as files with a header and read again."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    wr.write_trace(trace(spark, sf_dir), folder)
    back = rd.read_trace(spark, folder)
    return back.groupBy("owner", "function", F.col("memory_mb").cast("bigint").alias("memory_mb"), "duration_ms", "ts_ms").agg(
        F.count("*").alias("rows"))


@check("generate_compressed", BASE + """
SELECT function, row_number() OVER (ORDER BY md5(function)) - 1 AS id FROM (SELECT DISTINCT function FROM trace)""")
def _(spark, sf_dir):
    """Ids of all profiled functions in the order of a counts file that is not sorted by name."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    tr = trace(spark, sf_dir)
    cells = (tr.groupBy("owner", "function", (F.floor(F.col("ts_ms") / MINUTE) % 1440 + 1).cast("int").alias("minute")).agg(F.count("*").alias("n"))
             .groupBy("owner", "function").agg(F.map_from_entries(F.collect_list(F.struct("minute", "n"))).alias("n")))
    wide = F.transform(F.sequence(F.lit(1), F.lit(1440)), lambda m: F.coalesce(F.try_element_at("n", m), F.lit(0)).cast("string"))
    line = F.concat_ws(",", "owner", F.concat(F.lit("app"), "function"), "function", F.lit("http"), F.array_join(wide, ","))
    (cells.select(line.alias("value"), F.md5("function").alias("k")).coalesce(1).sortWithinPartitions("k").select("value")
     .write.text(f"{folder}/counts"))
    (cells.select(F.concat_ws(",", "owner", F.concat(F.lit("app"), "function"), "function", F.lit("10")).alias("value"))
     .write.text(f"{folder}/durations"))
    (cells.select(F.concat_ws(",", "owner", F.concat(F.lit("app"), "function"), F.lit("1"), F.lit("128")).alias("value"))
     .write.text(f"{folder}/memory"))
    day = pipe.MinuteCounts(*[f"{folder}/{n}" for n in ("counts", "durations", "memory")])
    return pipe.generate(spark, day, compress=True, first=1, last=60)[2]


@check("stream_sample_counts", BASE + TIMED + """
SELECT max(ts_ms) AS ts_ms, count(*) AS invocations FROM timed GROUP BY ts_ms // 1000""")
def _(spark, sf_dir):
    return _whole(spark, sf_dir, strm.stream_sample_counts)


@check("stream_classify_starts", BASE + TIMED + _starts_sql("timed") + """
SELECT starts.function, starts.seq, cold, sim.previous, container_id
FROM starts JOIN sim ON sim.function = starts.function AND sim.seq = starts.seq""")
def _(spark, sf_dir):
    out = _whole(spark, sf_dir, lambda tr: strm.stream_classify_starts(tr, KEEPALIVE))
    return out.select("function", "seq", "cold", "previous", "container_id")


@check("stream_hot_functions", BASE + TIMED + f""", hits AS (
  SELECT function, ts_ms, lag(ts_ms, {HOT_N}) OVER (PARTITION BY function ORDER BY ts_ms) >= ts_ms - 86400000 * 2 AS hit
  FROM timed)
SELECT function, min(ts_ms) AS hot_since FROM hits WHERE hit GROUP BY function""")
def _(spark, sf_dir):
    return _whole(spark, sf_dir, lambda tr: strm.stream_hot_functions(tr, HOT_N, 86_400_000 * 2))


SESSIONS = f""", gaps AS (
  SELECT *, max(ts_ms + duration_ms + {KEEPALIVE}) OVER (PARTITION BY function ORDER BY ts_ms, seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM timed),
numbered AS (SELECT *, sum(CASE WHEN until IS NULL OR ts_ms > until THEN 1 ELSE 0 END)
             OVER (PARTITION BY function ORDER BY ts_ms, seq) AS n FROM gaps),
sessions AS (SELECT function, min(ts_ms) AS first_ms, max(ts_ms + duration_ms + {KEEPALIVE}) AS until_ms,
             count(*) AS invocations FROM numbered GROUP BY function, n)"""


@check("active_sessions", BASE + TIMED + SESSIONS + " SELECT * FROM sessions")
def _(spark, sf_dir):
    timed = event_trace(spark, sf_dir).withColumn("event_time", F.timestamp_millis("ts_ms"))
    return strm.active_sessions(timed, KEEPALIVE)


@check("stream_active_sessions", BASE + TIMED + SESSIONS + " SELECT * FROM sessions")
def _(spark, sf_dir):
    return _whole(spark, sf_dir, lambda tr: strm.stream_active_sessions(tr, KEEPALIVE))


# Four deliveries of a quarter of the time each; every seventh row comes with the next one.
DELIVERIES = TIMED + """, span AS (SELECT min(ts_ms) AS a, max(ts_ms) - min(ts_ms) + 1 AS n FROM timed),
delivered AS (SELECT timed.*, least(3, 4 * (ts_ms - a) // n + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END) AS round FROM timed, span),
tops AS (SELECT round, max(max(ts_ms)) OVER (ORDER BY round) - 10000 AS mark FROM delivered GROUP BY round),
marked AS (SELECT delivered.*, coalesce(ts_ms <= mark, false) AS late FROM delivered LEFT JOIN tops ON tops.round = delivered.round - 1)"""


def _delivered(spark, sf_dir, after):
    """Deliver a trace in four rounds into a folder that is a stream, and call ``after`` with the stream each time."""
    tr = event_trace(spark, sf_dir).select(*TRACE)
    first, last = tr.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    quarter = F.floor((F.col("ts_ms") - first) * 4 / F.lit(last - first + 1))
    rounds = tr.withColumn("round", F.least(F.lit(3), quarter + (F.col("seq") % 7 == 0).cast("int")))
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    for n in range(4):
        rounds.where(F.col("round") == n).drop("round").write.mode("append").parquet(folder)
        out = after(spark.readStream.schema(tr.schema).parquet(folder))
    return out


@check("stream_late_rows", BASE + DELIVERIES + " SELECT function, seq, ts_ms FROM marked WHERE late")
def _(spark, sf_dir):
    """Rows that come behind the watermark are kept apart, none is lost."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _, late = _delivered(spark, sf_dir, lambda tr: strm.split_late(tr, folder))
    return late.select("function", "seq", "ts_ms")


@check("stream_starts_on_time", BASE + DELIVERIES + ", on_time AS (SELECT * FROM marked WHERE NOT late)" + _starts_sql("on_time") + """
SELECT starts.function, starts.seq, cold, sim.previous, container_id
FROM starts JOIN sim ON sim.function = starts.function AND sim.seq = starts.seq""")
def _(spark, sf_dir):
    """The starts of all rows that came in time, of a trace delivered out of order."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    starts = lambda tr: strm.stream_classify_starts(tr, KEEPALIVE)

    def follow(tr):
        on_time, _ = strm.split_late(tr, folder)
        strm.advance(on_time, starts, f"{folder}-starts")
        return on_time

    out = strm.run_to_end(_delivered(spark, sf_dir, follow), starts, f"{folder}-starts")
    return out.select("function", "seq", "cold", "previous", "container_id")
