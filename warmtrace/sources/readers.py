"""Dataset and log readers.

Each text layout has a parser from a DataFrame of lines (``value string``, and
where order matters ``row_pos bigint``) to typed columns, and a reader that
feeds it from files.  Cells are taken by position; a cell that does not parse
drops its row, and ``count_malformed`` tells how many.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert_units, median_memory, round_java
from ..model import EVENT_ROWS_HEADER, TRACE_HEADER
from ..operators.expand import offset_days, offset_weeks
from ..operators.running import running

MINUTE_COLUMNS = 1_440
FIRST_MINUTE_CELL = 4
EVENT_ARRAYS_SCHEMA = ("NamespaceHash string, AppHash string, InvocationTimes array<double>, "
                       "AppExecTimes array<double>")
APP_CONFIG_SCHEMA = ("NamespaceHash string, AppHash string, "
                     "AppContainerRequestMemory array<double>")
# Fixed value: the fields of a catalogue entry.
CATALOGUE_ENTRY = ("struct<language:string,benchmarkName:string,code:string,entryPoint:string,"
                   "payload:string,memory:int,duration:int,hydraSandbox:string,svmId:string>")

# Token positions in a printed gauge line.
GAUGE_TOKENS = {"ts_ms": 1, "invocations": 4, "cold": 6, "running_users": 10,
                "running_functions": 12, "running_invocations": 14, "running_mb": 16,
                "cached_users": 20, "cached_functions": 22, "cached_mb": 24}
OPTIMISED_GAUGE_TOKENS = {"optimised_cold": 27, "running_optimised_functions": 29}
# Fixed value: a variable to fill in from the environment.
VARIABLE_PATTERN = r"\{\{[A-Za-z_]+\}\}"


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files with file name, block start and a position that orders them."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_pos"))


def _cells(line: str = "value") -> Column:
    return F.split(F.col(line), ",", -1)


def _int(cell: Column) -> Column:
    return F.trim(cell).try_cast("int")


# --- per-minute counts and their dimensions ----------------------------------

def parse_minute_counts(lines: DataFrame, first: int = 1, last: int = MINUTE_COLUMNS) -> DataFrame:
    """Long counts of minutes ``first`` to ``last``; other cells are never unfolded."""
    head = lines.where(~F.col("value").startswith("HashOwner,")).withColumn("_c", _cells())
    minutes = F.slice("_c", FIRST_MINUTE_CELL + first, last - first + 1)
    keep = [c for c in ("row_pos",) if c in lines.columns]
    long = head.select(F.get("_c", F.lit(0)).alias("owner"), F.get("_c", F.lit(1)).alias("app"),
                       F.get("_c", F.lit(2)).alias("function"), *keep,
                       F.posexplode(minutes).alias("_p", "_n"))
    return long.select("owner", "app", "function", *keep, (F.col("_p") + first).alias("minute"),
                       _int(F.col("_n")).cast("bigint").alias("count")).where("count is not null")


def read_minute_counts(spark: SparkSession, path, first: int = 1, last: int = MINUTE_COLUMNS) -> DataFrame:
    return parse_minute_counts(text_lines(spark, path), first, last)


def read_minute_names(spark: SparkSession, path) -> DataFrame:
    """owner, app, function of every line of a counts file, with its position as ``seq``."""
    lines = text_lines(spark, path).where(~F.col("value").startswith("HashOwner,"))
    cells = F.split("value", ",", 4)
    return lines.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(("owner", "app", "function"))],
                        F.col("row_pos").alias("seq"))


def _last_by_key(lines: DataFrame, key_cell: int, value_cell: int, key: str, value: str) -> DataFrame:
    c = lines.where(~F.col("value").startswith("HashOwner,")).select("row_pos", _cells().alias("_c"))
    typed = c.select("row_pos", F.get("_c", F.lit(key_cell)).alias(key),
                     _int(F.get("_c", F.lit(value_cell))).alias(value)).where(F.col(value).isNotNull())
    return typed.groupBy(key).agg(F.max_by(value, "row_pos").alias(value))


def parse_function_durations(lines: DataFrame) -> DataFrame:
    """Average duration per function; the last line of a function counts."""
    return _last_by_key(lines, 2, 3, "function", "duration_ms")


def parse_app_memory(lines: DataFrame) -> DataFrame:
    """Average memory per app; the last line of an app counts."""
    return _last_by_key(lines, 1, 3, "app", "memory_mb")


def read_function_durations(spark: SparkSession, path) -> DataFrame:
    return parse_function_durations(text_lines(spark, path))


def read_app_memory(spark: SparkSession, path) -> DataFrame:
    return parse_app_memory(text_lines(spark, path))


# --- minute matrices -----------------------------------------------------------

def parse_minute_matrix(lines: DataFrame, day: Column, first: int = 0, last: int = 1439) -> DataFrame:
    """Long matrix cells (time_s, pos, value) of the given day and minutes; blanks are missing."""
    # A minute within the range lies within the day; only rows inside it are cut into cells.
    time_s = _int(F.split_part("value", F.lit(","), F.lit(2)))
    minute = F.floor((time_s - offset_days(day)) / 60)
    inside = (lines.where(minute.between(first, last))
              .select(time_s.alias("time_s"), _cells().alias("_c")))
    cells = F.slice("_c", F.lit(3), F.size("_c") - 2)
    return (inside.select("time_s", F.posexplode(cells).alias("pos", "_v"))
            .select(F.col("time_s").cast("bigint").alias("time_s"), "pos",
                    F.col("_v").try_cast("double").alias("value")).where("value is not null"))


def header_widths(lines: DataFrame) -> DataFrame:
    """Function columns per file, from its header (the line without a time)."""
    c = lines.select("file", _cells().alias("_c"))
    heads = c.where(_int(F.get("_c", F.lit(1))).isNull())
    return heads.groupBy("file").agg(F.max(F.size("_c") - 2).alias("functions"))


def check_header_widths(*matrices: DataFrame) -> None:
    """Fail when the matrices of one day do not have equally many function columns."""
    widths = None
    for lines in matrices:
        w = header_widths(lines)
        widths = w if widths is None else widths.unionByName(w)
    bad = (widths.groupBy("file").agg(F.min("functions").alias("a"), F.max("functions").alias("b"),
                                      F.count("*").alias("n"))
           .where((F.col("a") != F.col("b")) | (F.col("n") != len(matrices))).limit(5).collect())
    if bad:
        raise ValueError(f"different function columns in {[r['file'] for r in bad]}")


def read_minute_matrix(spark: SparkSession, path, first: int = 0, last: int = 1439) -> DataFrame:
    """Matrix files ``day_NNN.csv``; the day is part of the file name."""
    day = F.regexp_extract("file", r"day_(\d+)", 1).try_cast("int")
    return parse_minute_matrix(text_lines(spark, path), day, first, last)


# --- nested events and their configuration -----------------------------------------

def parse_app_events(records: DataFrame) -> DataFrame:
    """Arrays of start times (s) and durations (ms) per app; records without keys are skipped."""
    return (records.select(F.col("NamespaceHash").alias("namespace"), F.col("AppHash").alias("app"),
                           F.col("InvocationTimes").alias("times_s"),
                           F.col("AppExecTimes").alias("exec_ms"))
            .where("namespace is not null and app is not null"))


def parse_app_config(records: DataFrame, position: str = "row_pos") -> DataFrame:
    """Memory per (namespace, app): the median in MB; the last usable record counts."""
    keyed = records.select(F.col("NamespaceHash").alias("namespace"), F.col("AppHash").alias("app"),
                           F.col("AppContainerRequestMemory").alias("memory_gb"), position)
    usable = median_memory(keyed).where(
        "namespace is not null and app is not null and memory_mb is not null")
    return usable.groupBy("namespace", "app").agg(F.max_by("memory_mb", position).alias("memory_mb"))


def read_app_events(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    return parse_app_events(spark.read.schema(EVENT_ARRAYS_SCHEMA).format(fmt).load(path))


def read_app_config(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    records = spark.read.schema(APP_CONFIG_SCHEMA).format(fmt).load(path)
    return parse_app_config(records.withColumn("row_pos", F.monotonically_increasing_id()))


def parse_event_rows(lines: DataFrame) -> DataFrame:
    """Flat events: GB to MB and times to whole ms; rows of another width are skipped."""
    c = lines.select("*", _cells().alias("_c")).where(F.size("_c") == 5)
    keep = [x for x in ("row_pos", "file") if x in lines.columns]

    def number(i):
        return F.get("_c", F.lit(i)).try_cast("double")

    typed = c.select(F.get("_c", F.lit(0)).alias("owner"), F.get("_c", F.lit(1)).alias("function"),
                     round_java(convert_units(number(2), "gb_to_mb")).cast("int").alias("memory_mb"),
                     round_java(number(3)).alias("duration_ms"),
                     round_java(number(4)).alias("ts_ms"), *keep)
    return typed.dropna(subset=["memory_mb", "duration_ms", "ts_ms"])


def read_event_rows(spark: SparkSession, path, start_week: int | None = None) -> DataFrame:
    """Flat event files, header checked; with ``start_week`` files ``week_N.csv`` on one time line."""
    named = spark.read.option("header", True).option("enforceSchema", False)
    names = EVENT_ROWS_HEADER.split(",")
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        found = [c.strip() for c in named.csv(p).columns]
        if found != names:
            raise ValueError(f"unexpected header in {p}: {','.join(found)}")
    lines = text_lines(spark, paths).where(F.trim("value") != EVENT_ROWS_HEADER)
    rows = parse_event_rows(lines)
    if start_week is not None:
        week = F.regexp_extract("file", r"week_(\d+)", 1).cast("int")
        rows = rows.withColumn("ts_ms", offset_weeks(F.col("ts_ms"), week, start_week))
    return rows.withColumnRenamed("row_pos", "seq").drop("file")


# --- traces and catalogues --------------------------------------------------------

def parse_trace(lines: DataFrame) -> DataFrame:
    c = lines.where(~F.col("value").startswith(TRACE_HEADER)).select("*", _cells().alias("_c"))
    extra = [x for x in ("row_pos",) if x in lines.columns]
    typed = c.select(F.get("_c", F.lit(0)).alias("owner"), F.get("_c", F.lit(1)).alias("function"),
                     _int(F.get("_c", F.lit(2))).alias("memory_mb"),
                     F.get("_c", F.lit(3)).try_cast("bigint").alias("duration_ms"),
                     F.get("_c", F.lit(4)).try_cast("bigint").alias("ts_ms"),
                     *[F.col(x).alias("seq") for x in extra],
                     F.get("_c", F.lit(5)).alias("language"), F.get("_c", F.lit(6)).alias("benchmark"))
    return typed.dropna(subset=["memory_mb", "duration_ms", "ts_ms"])


def read_trace(spark: SparkSession, path) -> DataFrame:
    return parse_trace(text_lines(spark, path)).drop("language", "benchmark")


def read_enriched_trace(spark: SparkSession, path) -> DataFrame:
    """Seven-column trace; memory and duration of its benchmarks come from ``attach_catalogue``."""
    return parse_trace(text_lines(spark, path)).where("benchmark is not null")


def parse_catalogue(documents: DataFrame, env: Mapping[str, str] | None = None) -> DataFrame:
    """Benchmark entries of a JSON map; ``{{NAME}}`` is filled in from ``env``, else left empty."""
    text = F.col("value")
    for name, value in (env or {}).items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.lit(value))
    text = F.regexp_replace(text, VARIABLE_PATTERN, "")
    entries = documents.select(F.explode(F.from_json(text, f"map<string,{CATALOGUE_ENTRY}>"))
                               .alias("name", "_e"))
    return entries.select("name", "_e.*")


def read_catalogue(spark: SparkSession, path, env: Mapping[str, str] | None = None) -> DataFrame:
    return parse_catalogue(spark.read.text(path, wholetext=True), env)


# --- logs and series ------------------------------------------------------------------

def parse_gauge_log(lines: DataFrame, optimised: bool = False) -> DataFrame:
    """Printed gauge lines back to columns; lines that do not parse are ignored."""
    tokens = {**GAUGE_TOKENS, **(OPTIMISED_GAUGE_TOKENS if optimised else {})}
    words = lines.select(F.split("value", " ").alias("_w"))
    return words.select(*[F.get("_w", F.lit(i)).try_cast("double").alias(n)
                          for n, i in tokens.items()]).dropna()


def read_gauge_log(spark: SparkSession, path, optimised: bool = False) -> DataFrame:
    return parse_gauge_log(spark.read.text(path), optimised)


def parse_metric_series(lines: DataFrame) -> DataFrame:
    """One number per line; ``pos`` counts the numbers of a series in line order.

    ``lines`` has ``series``, ``block`` (not decreasing along a file), ``row_pos``
    and ``value``.
    """
    numbers = (lines.withColumn("value", F.trim("value").try_cast("double"))
               .where("value is not null"))
    counted = running(numbers, keys=["series"], chunk=F.col("block"), order=["row_pos"],
                      sums={"upto": F.lit(1)})
    return counted.select("series", (F.col("upto") - 1).cast("bigint").alias("pos"), "value")


def read_metric_series(spark: SparkSession, path) -> DataFrame:
    """Number files; the file name without its extension is the series."""
    series = F.regexp_replace("file", r"\.[^.]*$", "")
    return parse_metric_series(text_lines(spark, path).withColumn("series", series))
