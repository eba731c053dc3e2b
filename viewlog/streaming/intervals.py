"""Per-interval timing statistics of call samples.

A sample is one timed call: ``mapper`` (the client), ``tag`` (the task), ``start`` (an
instant), ``elapsed_ms`` and ``error``. It belongs to the interval in which the call started. Failed
calls are counted and their timings left out. The same function serves batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def utc_instant(wall_clock: Column) -> Column:
    """The instant of a zone-less timestamp read as UTC, whatever the session's zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, wall_clock))


def minute_of(instant: Column) -> Column:
    """Whole minutes since the epoch."""
    return F.floor(F.unix_seconds(instant) / 60)


def interval_stats(samples: DataFrame, minutes: int, sample_deviation: bool = False) -> DataFrame:
    """Statistics and errors per interval and tag: partial sums on the map side, one shuffle."""
    deviation = F.stddev_samp if sample_deviation else F.stddev_pop
    elapsed = F.when(~F.col("error"), F.col("elapsed_ms"))
    grouped = samples.groupBy(F.window("start", f"{minutes} minutes").alias("w"), "tag").agg(
        F.avg(elapsed).alias("mean"),
        F.min(elapsed).alias("min"),
        F.max(elapsed).alias("max"),
        deviation(elapsed).alias("stddev"),
        F.count(elapsed).alias("count"),
        F.count_if("error").alias("errors"),
    )
    return grouped.select(
        minute_of(F.col("w.start")).alias("minute"),
        "tag",
        "mean",
        "min",
        "max",
        "stddev",
        "count",
        "errors",
    )


def closed_intervals(stats: DataFrame, minutes: int, end_minute: int) -> DataFrame:
    """Without the interval still open at ``end_minute``, which the source never reports."""
    return stats.filter(F.col("minute") + minutes <= end_minute)


def last_minute(samples: DataFrame) -> int:
    """The minute of the latest sample (one aggregate, one number)."""
    return samples.agg(minute_of(F.max("start")).alias("m")).first()["m"]


def interval_errors(samples: DataFrame, minutes: int) -> DataFrame:
    """Failed calls per interval and tag."""
    return interval_stats(samples, minutes).select("minute", "tag", "errors")


def stream_session(spark: SparkSession, state_partitions: int) -> SparkSession:
    """A session whose streams keep their state in that many partitions.

    State holds a row per open interval and tag, and each batch sends it partial sums only, so
    its partitions follow the number of tags and not the default meant for batch shuffles.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return session


def stream_interval_stats(
    samples: DataFrame,
    minutes: int,
    path: str,
    checkpoint: str,
    lateness: str,
    query_name: str | None = None,
) -> StreamingQuery:
    """Append closed intervals of a sample stream to parquet files, once over what is there.

    Samples more than ``lateness`` behind the latest one are dropped when their interval is
    closed; :func:`viewlog.streaming.ledger.account` counts them over the stream's whole life and
    :func:`dropped_late` over its last batches. Clients are not in step: choose it larger than
    their largest difference.

    An interval is written when the watermark passes its end. State holds one row per open
    interval and tag. The file sink and the checkpoint make a restart write nothing twice.
    """
    stats = interval_stats(samples.withWatermark("start", lateness), minutes)
    writer = (
        stats.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()


def dropped_late(stream: StreamingQuery) -> int:
    """Partial rows that the watermark dropped in the batches the query still remembers.

    Rows are reduced to one per interval, tag and task before the watermark looks at them.
    """
    return sum(
        int(operator["numRowsDroppedByWatermark"])
        for batch in stream.recentProgress
        for operator in batch["stateOperators"]
    )


def carry_forward(
    df: DataFrame, by: str, order: str, col: str, default: object = 0
) -> DataFrame:
    """Fill nulls with the last known value of the same series, ``default`` before the first.

    Meant for series that are already one row per interval, so a series is as long as
    time has intervals, not as the data has rows.
    """
    past = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(col, ignorenulls=True).over(past)
    return df.withColumn(col, F.coalesce(filled, F.lit(default)))


def interval_threads(samples: DataFrame, readings: DataFrame, minutes: int) -> DataFrame:
    """Running threads per interval, summed over mappers.

    ``readings`` holds (mapper, minute, threads) whenever a mapper's thread count changed;
    several readings of one interval count with the latest. A mapper counts in the intervals
    in which it has samples, with its last known reading.
    """
    start = minute_of(F.col("start"))
    active = samples.select("mapper", (start - F.pmod(start, F.lit(minutes))).alias("minute"))
    latest = readings.groupBy(
        "mapper", (F.col("minute") - F.pmod("minute", F.lit(minutes))).alias("minute")
    ).agg(F.max_by("threads", "minute").alias("threads"))
    marked = active.distinct().withColumn("threads", F.lit(None).cast("bigint"))
    series = (
        marked.withColumn("active", F.lit(True))
        .unionByName(latest.withColumn("active", F.lit(False)))
        .groupBy("mapper", "minute")
        .agg(F.max("threads").alias("threads"), F.max("active").alias("active"))
    )
    filled = carry_forward(series, "mapper", "minute", "threads")
    return (
        filled.filter("active").groupBy("minute").agg(F.sum("threads").cast("bigint").alias("threads"))
    )


def load_series(
    samples: DataFrame, readings: DataFrame, minutes: int, tags: list[str]
) -> DataFrame:
    """Thread count, statistics and errors per interval and tag.

    ``tags`` names the measured tasks. A task without samples in an interval has a row
    with null statistics and counts of 0.
    """
    threads = interval_threads(samples, readings, minutes)
    every_tag = F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag")
    grid = threads.select("minute", "threads", every_tag)
    stats = interval_stats(samples, minutes)
    return grid.join(stats, ["minute", "tag"], "left").fillna(0, subset=["count", "errors"])
