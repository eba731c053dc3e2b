"""Timing statistics as states that merge, so that stored ones need no second look at samples.

A state is what is known of the calls of one tag that start in one minute: count, mean, m2 (the
sum of squared distances from the mean), min, max and errors. States of equal keys can be stored
in any number, a part at a time as samples arrive; they merge into any longer interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewlog.streaming.intervals import minute_of

STATE = ("minute", "tag", "count", "mean", "m2", "min", "max", "errors")


def floor_minute(minute: Column, minutes: int) -> Column:
    return minute - F.pmod(minute, F.lit(minutes))


def state_columns() -> list[Column]:
    """Aggregates over samples that make a state; failed calls count as errors alone."""
    elapsed = F.when(~F.col("error"), F.col("elapsed_ms"))
    return [
        F.count(elapsed).alias("count"),
        F.avg(elapsed).alias("mean"),
        (F.var_pop(elapsed) * F.count(elapsed)).alias("m2"),
        F.min(elapsed).alias("min"),
        F.max(elapsed).alias("max"),
        F.count_if("error").alias("errors"),
    ]


def timing_states(samples: DataFrame, minutes: int = 1) -> DataFrame:
    """One state per tag and interval of ``minutes``; samples without a start have none."""
    minute = floor_minute(minute_of(F.col("start")), minutes)
    return samples.filter("start IS NOT NULL").groupBy(minute.alias("minute"), "tag").agg(*state_columns())


def merge_states(states: DataFrame, minutes: int = 1, by: tuple[str, ...] = ("tag",)) -> DataFrame:
    """States of intervals of ``minutes`` from states of any parts of them.

    The merged mean comes first; each part then adds its m2 and its count times the squared
    distance of the two means. Nothing large is subtracted from anything large, so digits are
    kept, and mean and sum share one shuffle.
    """
    wide = states.withColumn("minute", floor_minute(F.col("minute"), minutes))
    same = Window.partitionBy("minute", *by)
    whole = F.sum(F.col("count") * F.col("mean")).over(same) / F.nullif(F.sum("count").over(same), F.lit(0))
    wide = wide.withColumn("__whole", whole)
    away = F.col("mean") - F.col("__whole")
    return wide.groupBy("minute", *by).agg(
        F.sum("count").alias("count"),
        F.first("__whole").alias("mean"),
        F.sum(F.col("m2") + F.col("count") * away * away).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("errors").alias("errors"),
    )


def stats_of(states: DataFrame, sample_deviation: bool = False) -> DataFrame:
    """The rows of :func:`viewlog.streaming.intervals.interval_stats` from states."""
    freedom = F.col("count") - 1 if sample_deviation else F.col("count")
    deviation = F.sqrt(F.col("m2") / F.nullif(freedom, F.lit(0)))
    return states.select("minute", "tag", "mean", "min", "max", deviation.alias("stddev"), "count", "errors")


def append_states(samples: DataFrame, path: str, minutes: int = 1) -> None:
    """Add the states of new samples to a stored table; what is there is neither read nor changed."""
    timing_states(samples, minutes).write.mode("append").parquet(path)


def stored_stats(spark: SparkSession, path: str, minutes: int) -> DataFrame:
    """Statistics over intervals of ``minutes`` from stored states alone."""
    return stats_of(merge_states(spark.read.parquet(path), minutes))
