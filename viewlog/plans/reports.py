"""Timing reports: comparison of engines, load/store runs, and load tests."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewlog.functions.scalars import (
    format_count,
    format_duration,
    integer_mean,
    ratio2,
    scale_to,
)
from viewlog.operators.aggregates import timing_stats

# ---- fixed values ----
AXIS_HEADROOM = 1.1
TOTAL_LINE = "Total"
# ---- end of fixed values ----

STATS = ("mean", "min", "max", "stddev")


def speedup_report(runs: DataFrame, first: str, second: str) -> DataFrame:
    """Mean whole seconds per query of two engines, their ratio, and a line of totals.

    ``runs`` has (query, engine, seconds). Every mean also goes to the total line, so one
    more tiny group-by gives all lines.
    """

    def mean_of(engine: str) -> Column:
        seconds = F.when(F.col("engine") == engine, F.col("seconds"))
        return integer_mean(F.sum(seconds), F.count(seconds))

    means = runs.groupBy("query").agg(
        mean_of(first).alias("first_sec"), mean_of(second).alias("second_sec")
    )
    lines = means.select(
        F.explode(F.array("query", F.lit(TOTAL_LINE))).alias("query"), "first_sec", "second_sec"
    )
    summed = lines.groupBy("query").agg(
        F.sum("first_sec").alias("first_sec"), F.sum("second_sec").alias("second_sec")
    )
    return summed.withColumn("multiplier", ratio2(F.col("first_sec"), F.col("second_sec")))


def load_store_stats(runs: DataFrame, sample_deviation: bool = False) -> DataFrame:
    """Statistics per spec file and kind of load/store run; ``runs`` has (file, tag, elapsed_ms)."""
    return timing_stats(runs, ["file", "tag"], F.col("elapsed_ms"), sample_deviation)


def load_store_report(runs: DataFrame) -> DataFrame:
    """One JSON document per spec file: ``{file: {tag: {avg, min, max, ...}}}``.

    A document holds one entry per kind of run, whatever the number of runs.
    """
    stats = load_store_stats(runs)
    entry = F.struct(
        F.col("tag"),
        F.struct(
            _number("mean").alias("avg"),
            _number("min"),
            _number("max"),
            _number("stddev").alias("standardDeviation"),
            F.col("count"),
        ).alias("stats"),
    )
    by_file = stats.groupBy("file").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    document = F.create_map(F.col("file"), F.map_from_entries("entries"))
    return by_file.select("file", F.to_json(document).alias("document"))


def _number(name: str) -> Column:
    """A statistic with six decimals, so that the document does not depend on summation order."""
    return F.round(name, 6).alias(name)


def printed_stats(stats: DataFrame) -> DataFrame:
    """Statistics as printed in a report: durations, ``-`` for no value, 0 for no count."""
    durations = {name: format_duration(F.col(name)) for name in STATS}
    counts = {c: format_count(F.col(c)) for c in ("count", "errors") if c in stats.columns}
    return stats.withColumns(durations | counts)


def load_test_report(results: Mapping[str, DataFrame]) -> DataFrame:
    """One JSON document per result file and task: an entry for every interval, in order.

    ``results`` maps the name of a result file to its series, which comes from
    :func:`viewlog.streaming.intervals.load_series`. An entry has the interval's minute and
    thread count; one without timings has nulls in their place, its errors still count.
    """
    entry = F.struct(
        F.col("minute"),
        F.col("threads"),
        _number("mean"),
        _number("min"),
        _number("max"),
        _number("stddev").alias("standardDeviation"),
        F.col("count"),
        F.col("errors").cast("string").alias("error"),
    )
    named = [series.select(F.lit(file).alias("file"), "tag", entry.alias("e")) for file, series in results.items()]
    by_tag = reduce(DataFrame.unionByName, named).groupBy("file", "tag")
    entries = by_tag.agg(F.array_sort(F.collect_list("e")).alias("entries"))
    return entries.select(
        "file", "tag", F.to_json("entries", {"ignoreNullFields": "false"}).alias("document")
    )


def response_vs_threads(series: DataFrame) -> DataFrame:
    """The load-test chart: mean per task over time, thread labels, position on the axis.

    The axis ends a tenth above the highest mean.
    """
    measured = series.filter("count > 0").select("tag", "minute", "threads", "mean")
    limit = measured.agg(F.max("mean") * AXIS_HEADROOM).scalar()
    return measured.withColumn("scaled", scale_to(F.col("mean"), limit))


def min_avg_max_series(stats: DataFrame) -> DataFrame:
    """The load/store chart of each file: min, mean and max per kind of run on one axis.

    The window spans the few lines of one file, after aggregation.
    """
    limit = F.max("max").over(Window.partitionBy("file")) * AXIS_HEADROOM
    scaled = {f"scaled_{n}": scale_to(F.col(n), F.col("axis_limit")) for n in ("min", "mean", "max")}
    return (
        stats.select("file", "tag", "min", "mean", "max", limit.alias("axis_limit"))
        .withColumns(scaled)
    )
