"""Language and benchmark assignment, and what follows from it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash32, shuffle_key
from ..model import arrival_order
from .running import CHUNK_ROWS, WIDTH, chunk_of, running, with_widths
from .stages import materialise

# Share of invocations per language, in assignment order.
LANGUAGE_SHARES = {"javascript": 48, "python": 24, "java": 28}

# Measured duration in ms of each benchmark, per language.
BENCHMARK_DURATIONS = {
    "java": {"jvhw": 5, "jvfh": 8, "jvcl": 4430, "jvhr": 7, "jvvp": 25175},
    "python": {"pyhw": 5, "pyms": 12, "pybf": 10, "pypr": 12, "pydn": 32, "pydh": 14,
               "pyco": 61, "pyth": 21, "pyvp": 3052, "pyup": 17},
    "javascript": {"jshw": 5, "jsdh": 5, "jsth": 25, "jsup": 10},
}

# Execution modes that rename functions and owners.
MODES_NAMING_FUNCTIONS_BY_BENCHMARK = ("hy", "hy-fc")
MODES_WITH_ONE_OWNER = ("hy-fc",)
SINGLE_OWNER = "user"


def language_thresholds(total: Column, shares: Mapping[str, int]) -> list[tuple[str, Column]]:
    """Cumulative invocation limits, each share cut to an integer."""
    limits, upto = [], F.lit(0)
    for language, percent in shares.items():
        upto = upto + (total * F.lit(percent / 100)).cast("bigint")
        limits.append((language, upto))
    return limits


def assign_language(tr: DataFrame, shares: Mapping[str, int] = LANGUAGE_SHARES,
                    seed: int = 0) -> DataFrame:
    """Give every function a language so that invocations match the shares.

    Functions are taken in a random order fixed by ``seed``; a function gets the
    first language whose cumulative limit its running total does not exceed, the
    last language if none.  The running total is cut by the leading hex digits of
    the random key, so no task holds all functions.
    """
    per = (tr.groupBy("function")
           .agg(F.count("*").alias("invocations"),
                F.min_by("duration_ms", arrival_order()).alias("duration_ms"))
           .withColumn("_key", shuffle_key(F.col("function"), seed)))
    ranked = running(per, keys=[], chunk=F.substring("_key", 1, 2),
                     order=["_key", "function"], sums={"upto": F.col("invocations")})
    total = per.select(F.sum("invocations")).scalar()
    limits = language_thresholds(total, shares)
    language = F.lit(limits[-1][0])
    for name, limit in reversed(limits[:-1]):
        language = F.when(F.col("upto") <= limit, F.lit(name)).otherwise(language)
    return ranked.select("function", "invocations", "duration_ms", "upto",
                         language.alias("language"))


def nearest_benchmark(fn: DataFrame, durations: Mapping[str, Mapping[str, int]] = BENCHMARK_DURATIONS,
                      seed: int = 0) -> DataFrame:
    """Benchmark of the function's language with the closest duration.

    Equal distance takes the shorter; benchmarks of equal duration are drawn by
    hash.  The table is part of the plan, so there is no join and no ranking.
    """
    def options(by_name: Mapping[str, int]) -> Column:
        by_ms: dict[int, list[str]] = {}
        for name, ms in by_name.items():
            by_ms.setdefault(ms, []).append(name)
        return F.array(*[F.struct(F.lit(ms).cast("bigint").alias("ms"),
                                  F.array(*[F.lit(n) for n in sorted(names)]).alias("names"))
                         for ms, names in sorted(by_ms.items())])

    d = F.col("duration_ms")
    nearest = None
    for language, by_name in durations.items():
        ranked = F.transform(options(by_name), lambda o: F.struct(
            F.abs(o["ms"] - d).alias("gap"), o["ms"].alias("ms"), o["names"].alias("names")))
        best = F.array_min(ranked)["names"]
        this = F.lower("language") == language
        nearest = F.when(this, best) if nearest is None else nearest.when(this, best)
    pick = F.pmod(hash32(F.col("function"), seed, F.lit("pick")), F.size("_names")).cast("int")
    return (fn.withColumn("_names", nearest)
            .withColumn("benchmark", F.get("_names", pick)).drop("_names"))


def nearest_in_catalogue(fn: DataFrame, catalogue: DataFrame, seed: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``nearest_benchmark`` against a table ``language, benchmark, duration_ms`` of any size.

    An as-of join to both sides: the different durations of functions and catalogue are one order for each language,
    along which the last and the next known duration are carried across chunks.  Of equal distances the shorter, of
    benchmarks with one duration a drawn one counts; a function without a duration, or whose language the catalogue
    has not, gets null.  All rows of ``fn`` stay; a column ``benchmark`` is replaced.
    """
    named = catalogue.where("duration_ms is not null and benchmark is not null").select(
        F.lower("language").alias("_language"), F.col("duration_ms").cast("bigint").alias("_ms"), F.col("benchmark").alias("_name")).distinct()
    place = F.row_number().over(Window.partitionBy("_language", "_ms").orderBy("_name")) - 1
    named = materialise(named.withColumn("_place", place))
    known = named.groupBy("_language", "_ms").agg(F.count("*").alias("_names"))
    fn = fn.drop("benchmark").withColumn("_language", F.lower("language"))
    asked = fn.where("duration_ms is not null and _language is not null").select("_language", F.col("duration_ms").cast("bigint").alias("_at")).distinct()
    both = known.select("_language", F.col("_ms").alias("_at"), F.col("_ms").alias("_known"), F.lit(0).alias("_side")).unionByName(
        asked.select("_language", "_at", F.lit(None).cast("bigint").alias("_known"), F.lit(1).alias("_side")))
    up = with_widths(both, ["_language"], "_at", chunk_rows)
    floors = running(up, keys=["_language"], chunk=chunk_of(up, "_at"), order=["_at", "_side"], maxes={"_floor": F.col("_known")}).drop(WIDTH)
    back = floors.withColumns({"_back": -F.col("_at"), "_from": -F.col("_known")})
    down = with_widths(back, ["_language"], "_back", chunk_rows)
    sides = running(down, keys=["_language"], chunk=chunk_of(down, "_back"), order=["_back", "_side"], maxes={"_ceiling": F.col("_from")})
    floor, ceiling, at = F.col("_floor"), -F.col("_ceiling"), F.col("_at")
    nearest = sides.where("_side = 1").select("_language", "_at", F.when(ceiling.isNull() | (at - floor <= ceiling - at), floor)
                                              .otherwise(ceiling).alias("_ms")).join(known, ["_language", "_ms"]).withColumnRenamed("_language", "_of")
    out = fn.join(nearest, (F.col("_language") == F.col("_of")) & (F.col("duration_ms") == F.col("_at")), "left").drop("_of")
    out = out.withColumn("_place", F.pmod(hash32(F.col("function"), seed, F.lit("pick")), F.col("_names")).cast("int"))
    picked = named.select("_language", "_ms", "_place", F.col("_name").alias("benchmark"))
    return out.join(picked, ["_language", "_ms", "_place"], "left").drop("_language", "_ms", "_place", "_at", "_names")


def language_stats(fn: DataFrame, shares: Mapping[str, int] = LANGUAGE_SHARES) -> DataFrame:
    """Functions and invocations per language beside the expected invocations."""
    per = fn.groupBy("language").agg(F.count("*").alias("functions"),
                                     F.sum("invocations").alias("invocations"))
    total = fn.select(F.sum("invocations")).scalar()
    percent = F.create_map(*[x for name, p in shares.items() for x in (F.lit(name), F.lit(p / 100))])
    return per.withColumn("expected", (total * F.get(F.map_values(F.map_filter(
        percent, lambda k, _: k == F.col("language"))), F.lit(0))).cast("bigint"))


def attach_language(tr: DataFrame, fn: DataFrame) -> DataFrame:
    """Add language and benchmark to every row of a trace."""
    return tr.join(fn.select("function", "language", "benchmark"), "function")


def attach_catalogue(tr: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Replace memory and duration by those of the benchmark."""
    entry = catalogue.select(F.col("name").alias("benchmark"),
                             F.col("memory").alias("_mb"), F.col("duration").alias("_ms"))
    return (tr.join(entry, "benchmark")
            .withColumn("memory_mb", F.col("_mb").cast("int"))
            .withColumn("duration_ms", F.col("_ms").cast("bigint")).drop("_mb", "_ms"))


def rewrite_ids_by_mode(tr: DataFrame, mode: str) -> DataFrame:
    """Name functions by benchmark, and owners alike, where the execution mode does."""
    if mode in MODES_NAMING_FUNCTIONS_BY_BENCHMARK:
        tr = tr.withColumn("function", F.col("benchmark"))
    if mode in MODES_WITH_ONE_OWNER:
        tr = tr.withColumn("owner", F.lit(SINGLE_OWNER))
    return tr
