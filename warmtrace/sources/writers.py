"""Writers.  Each has a ``*_frame`` that shows what will be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import (BENCHMARK_MAPPING_HEADER, ENRICHED_HEADER, EVENT_ROWS_HEADER,
                     FUNCTION_MAPPING_HEADER, OWNER_MAPPING_HEADER, TRACE_HEADER, VM_MB)
from ..operators.expand import rebase_time, sort_trace
from ..operators.gauges import GAUGES, OPTIMISED_GAUGES
from ..operators.language import attach_language

# The printed gauge line.
GAUGE_LINE = ("time %d | invocations %d cold %d | running users %d functions %d invocations %d "
              "footprint %d | cached users %d functions %d footprint %d")
OPTIMISED_GAUGE_LINE = GAUGE_LINE + " | optimized_cold %d running_optimized_functions %d"


def _headed(df: DataFrame, columns: list[str], header: str) -> DataFrame:
    names = header.split(",")
    return df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])


def _csv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).csv(path, header=True)


TRACE_FIELDS = ["owner", "function", "memory_mb", "duration_ms", "ts_ms"]


def trace_frame(tr: DataFrame) -> DataFrame:
    """Rows in time order, times from 0, under the file's column names."""
    return _headed(sort_trace(rebase_time(tr)), TRACE_FIELDS, TRACE_HEADER)


def write_trace(tr: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    frame = trace_frame(tr)
    if fmt == "csv":
        _csv(frame, path, mode)
    else:
        frame.write.mode(mode).format(fmt).save(path)


def id_mapping_frame(ids: DataFrame, key: str) -> DataFrame:
    header = OWNER_MAPPING_HEADER if key == "owner" else FUNCTION_MAPPING_HEADER
    return _headed(ids, [key, "id"], header)


def write_id_mapping(ids: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    _csv(id_mapping_frame(ids, key), path, mode)


def benchmark_mapping_frame(fn: DataFrame) -> DataFrame:
    return _headed(fn, ["function", "benchmark"], BENCHMARK_MAPPING_HEADER)


def write_benchmark_mapping(fn: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _csv(benchmark_mapping_frame(fn), path, mode)


def enriched_trace_frame(tr: DataFrame, fn: DataFrame) -> DataFrame:
    return _headed(sort_trace(attach_language(tr, fn)), [*TRACE_FIELDS, "language", "benchmark"],
                   ENRICHED_HEADER)


def write_enriched_trace(tr: DataFrame, fn: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _csv(enriched_trace_frame(tr, fn), path, mode)


def event_rows_frame(ev: DataFrame, sort: bool = True) -> DataFrame:
    """Flat events with memory in GB; in time order unless switched off."""
    rows = ev.withColumn("memory_gb", F.col("memory_mb") / 1024)
    if sort:
        rows = rows.orderBy("ts_ms", "namespace", "app", "duration_ms")
    return _headed(rows, ["namespace", "app", "memory_gb", "duration_ms", "ts_ms"], EVENT_ROWS_HEADER)


def write_event_rows(ev: DataFrame, path: str, sort: bool = True, mode: str = "errorifexists") -> None:
    _csv(event_rows_frame(ev, sort), path, mode)


def format_gauge_log(g: DataFrame) -> DataFrame:
    """One printed line per sample, with its time for ordering."""
    optimised = "optimised_cold" in g.columns
    line = OPTIMISED_GAUGE_LINE if optimised else GAUGE_LINE
    columns = [*GAUGES, *(OPTIMISED_GAUGES if optimised else [])]
    return g.select("ts_ms", F.format_string(line, *[F.col(c) for c in columns]).alias("value"))


def write_gauge_log(g: DataFrame, path: str, mode: str = "errorifexists") -> None:
    format_gauge_log(g).orderBy("ts_ms").select("value").write.mode(mode).text(path)


def utilisation_frame(footprint: DataFrame, vm_mb: int = VM_MB) -> DataFrame:
    """One JSON object per sample: its time, VMs and memory."""
    mb = F.col("footprint_mb")
    row = F.struct(F.col("ts_ms").alias("time"),
                   F.floor(mb / vm_mb).cast("bigint").alias("VMs"), mb.alias("memory"))
    return footprint.select("ts_ms", F.to_json(row).alias("value"))


def write_utilisation(footprint: DataFrame, path: str, mode: str = "errorifexists") -> None:
    utilisation_frame(footprint).orderBy("ts_ms").select("value").write.mode(mode).text(path)
