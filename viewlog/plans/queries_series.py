"""Interval statistics, their stream, and the reports over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewlog.plans import driver_views as views
from viewlog.plans import reports
from viewlog.plans.driver_views import SAMPLES_SQL, table
from viewlog.plans.registry import query, rounded
from viewlog.session import scratch_path
from viewlog.streaming import intervals, ledger, timing_states
from viewlog.streaming.load_stream import LoadStream

MINUTES = 60
STATE_PARTITIONS = 8
TAGS = ["task0", "task1", "task2", "task3"]

STATS_SQL = f"""stats AS (
  SELECT start_minute - start_minute % {MINUTES} AS minute, tag,
    round(avg(elapsed_ms) FILTER (NOT error), 6) AS mean,
    min(elapsed_ms) FILTER (NOT error) AS min, max(elapsed_ms) FILTER (NOT error) AS max,
    round(stddev_pop(elapsed_ms) FILTER (NOT error), 6) AS stddev,
    count(*) FILTER (NOT error) AS count, count(*) FILTER (error) AS errors
  FROM samples GROUP BY ALL)"""

# A client's thread count grows with each of its signups; intervals without one keep the last.
READINGS_SQL = f"""readings AS (
  SELECT mapper, minute, sum(joined) OVER (PARTITION BY mapper ORDER BY minute) AS threads
  FROM (SELECT mapper, start_minute - start_minute % {MINUTES} AS minute, count(*) AS joined
        FROM samples WHERE joins GROUP BY ALL))"""

THREADS_SQL = f"""threads AS (
  SELECT a.minute, CAST(sum(coalesce((SELECT max(r.threads) FROM readings r
      WHERE r.mapper = a.mapper AND r.minute <= a.minute), 0)) AS BIGINT) AS threads
  FROM (SELECT DISTINCT mapper, start_minute - start_minute % {MINUTES} AS minute FROM samples) a
  GROUP BY a.minute)"""


def readings(samples: DataFrame) -> DataFrame:
    """(mapper, minute, threads): signups so far, at each interval that has one."""
    minute = intervals.minute_of(F.col("start"))
    joined = (
        samples.filter("joins")
        .groupBy("mapper", (minute - F.pmod(minute, F.lit(MINUTES))).alias("minute"))
        .agg(F.count(F.lit(1)).alias("joined"))
    )
    so_far = Window.partitionBy("mapper").orderBy("minute")
    return joined.select("mapper", "minute", F.sum("joined").over(so_far).alias("threads"))


@query("interval_stats", "SELECT * FROM stats", (SAMPLES_SQL, STATS_SQL))
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = intervals.interval_stats(views.timing_samples(spark, sf_dir), MINUTES)
    return rounded(stats, 6, "mean", "stddev")


@query("interval_errors", "SELECT minute, tag, errors FROM stats", (SAMPLES_SQL, STATS_SQL))
def interval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.interval_errors(views.timing_samples(spark, sf_dir), MINUTES)


@query(
    "interval_threads", "SELECT * FROM threads", (SAMPLES_SQL, READINGS_SQL, THREADS_SQL)
)
def interval_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.timing_samples(spark, sf_dir)
    return intervals.interval_threads(samples, readings(samples), MINUTES)


@query(
    "carry_forward",
    f"""SELECT a.mapper, a.minute, coalesce((SELECT max(r.threads) FROM readings r
        WHERE r.mapper = a.mapper AND r.minute <= a.minute), 0)::BIGINT AS threads
    FROM (SELECT DISTINCT mapper, start_minute - start_minute % {MINUTES} AS minute FROM samples) a""",
    (SAMPLES_SQL, READINGS_SQL),
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.timing_samples(spark, sf_dir)
    minute = intervals.minute_of(F.col("start"))
    active = samples.select("mapper", (minute - F.pmod(minute, F.lit(MINUTES))).alias("minute"))
    known = active.distinct().join(readings(samples), ["mapper", "minute"], "left")
    return intervals.carry_forward(known, "mapper", "minute", "threads")


@query(
    "late_data",
    f"""SELECT minute, tag, count, errors FROM stats
    WHERE minute + {MINUTES} <= (SELECT max(start_minute) FROM samples)""",
    (SAMPLES_SQL, STATS_SQL),
)
def late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.timing_samples(spark, sf_dir)
    stats = intervals.interval_stats(samples, MINUTES)
    closed = intervals.closed_intervals(stats, MINUTES, intervals.last_minute(samples))
    return closed.select("minute", "tag", "count", "errors")


@query(
    "interval_stats_stream",
    f"""SELECT * FROM stats
    WHERE to_timestamp((minute + {MINUTES}) * 60)::TIMESTAMP <= (SELECT max(start) FROM samples)""",
    (SAMPLES_SQL, STATS_SQL),
)
def interval_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics from a stream of the events; intervals closed by the watermark."""
    schema = table(spark, sf_dir, "events").schema
    session = intervals.stream_session(spark, STATE_PARTITIONS)
    events = (
        session.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    target = scratch_path(spark, "interval-stats")
    stream = intervals.stream_interval_stats(
        views.samples_of(events), MINUTES, f"{target}/data", f"{target}/checkpoint", "0 seconds"
    )
    stream.awaitTermination()
    return rounded(spark.read.parquet(f"{target}/data"), 6, "mean", "stddev")


@query("timing_states", "SELECT * FROM stats", (SAMPLES_SQL, STATS_SQL))
def stored_timing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics from states per minute, stored in three goes; samples are not read again."""
    samples, path = views.timing_samples(spark, sf_dir), scratch_path(spark, "timing-states")
    for third in range(3):
        timing_states.append_states(samples.filter(F.pmod(F.xxhash64("start"), F.lit(3)) == third), path)
    return rounded(timing_states.stored_stats(spark, path, MINUTES), 6, "mean", "stddev")


# Arrivals: events in parts of so many seconds of the day they arrive; every tenth is held up.
HELD_UP_SECONDS = 30 * 3600


def arrival_part(seconds: int) -> Column:
    held_up = F.when(F.col("event_id") % 10 == 3, HELD_UP_SECONDS).otherwise(0)
    return F.floor((F.unix_seconds(intervals.utc_instant(F.col("ts"))) + held_up) / seconds)


def arrivals_sql(seconds: int) -> str:
    """Samples with the number of the part they arrive in, from 0 without gaps."""
    return f"""arrivals AS (
  SELECT s.*, dense_rank() OVER (ORDER BY (CAST(floor(epoch(ts)) AS BIGINT)
      + CASE WHEN event_id % 10 = 3 THEN {HELD_UP_SECONDS} ELSE 0 END) // {seconds}) - 1 AS part
  FROM (SELECT *, CAST(floor(epoch(ts) / 60) AS BIGINT) AS start_minute FROM events) s)"""


def write_arrivals(spark: SparkSession, sf_dir: str, path: str, seconds: int, late_half: bool | None = None) -> None:
    """A file for each part, with times of change in the order of the parts, as a stream takes them.

    ``late_half`` picks the first or the second half of the parts, for streams that start twice.
    """
    events = table(spark, sf_dir, "events").withColumn("part", arrival_part(seconds))
    if late_half is not None:
        low, high = events.agg(F.min("part"), F.max("part")).first()
        events = events.filter((F.col("part") > (low + high) // 2) == late_half)
    # Only rows of one part share a file; parts are spans of time, not keys of the data.
    events.repartition("part").write.mode("append").partitionBy("part").parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("part=")]
    for place, folder in enumerate(sorted(folders, key=lambda f: int(f.getName().removeprefix("part=")))):
        for file in files.listStatus(folder):
            files.setTimes(file.getPath(), 1_600_000_000_000 + place * 1000, -1)


def arrivals(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    options = {"maxFilesPerTrigger": "1", "recursiveFileLookup": "true", "pathGlobFilter": "*.parquet"}
    return views.samples_of(spark.readStream.schema(schema).options(**options).parquet(path))


def restarted_stream(spark: SparkSession, sf_dir: str) -> LoadStream:
    """The load stream over four or so batches of ten days, stopped and started again in between."""
    root, session = scratch_path(spark, "load-stream"), intervals.stream_session(spark, STATE_PARTITIONS)
    for late_half in (False, True):
        write_arrivals(spark, sf_dir, f"{root}/in", 10 * 86_400, late_half)
        stream = LoadStream(session, root, MINUTES, 2 * HELD_UP_SECONDS // 60)
        stream.start(arrivals(session, sf_dir, f"{root}/in")).awaitTermination()
    return stream


@query("interval_threads_stream", "SELECT * FROM threads", (SAMPLES_SQL, READINGS_SQL, THREADS_SQL))
def interval_threads_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread counts from a stream that starts twice: what it closed and what is still open."""
    return restarted_stream(spark, sf_dir).threads(with_open=True)


@query(
    "carry_forward_stream",
    f"""SELECT a.mapper, a.minute, coalesce((SELECT max(r.threads) FROM readings r
        WHERE r.mapper = a.mapper AND r.minute <= a.minute), 0)::BIGINT AS threads
    FROM (SELECT DISTINCT mapper, start_minute - start_minute % {MINUTES} AS minute FROM samples) a""",
    (SAMPLES_SQL, READINGS_SQL),
)
def carry_forward_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restarted_stream(spark, sf_dir).client_threads(with_open=True)


@query(
    "load_series_stream",
    f"""SELECT t.minute, tag, threads, mean, min, max, stddev, coalesce(count, 0) AS count,
      coalesce(errors, 0) AS errors
    FROM (SELECT *, unnest({TAGS}) AS tag FROM threads) t LEFT JOIN stats USING (minute, tag)""",
    (SAMPLES_SQL, STATS_SQL, READINGS_SQL, THREADS_SQL),
)
def load_series_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(restarted_stream(spark, sf_dir).series(TAGS, with_open=True), 6, "mean", "stddev")


LATENESS = 600


@query(
    "late_accounting",
    f"""SELECT b.part AS batch, count(*) FILTER (a.part = b.part) AS read,
      count(*) FILTER (a.part = b.part AND late) AS late,
      count(*) FILTER (NOT late AND (a.part = b.part OR ends > before) AND ends <= closed_to) AS emitted,
      count(*) FILTER (NOT late AND ends > closed_to) AS open
    FROM (SELECT part, max(max(start_minute)) OVER (ORDER BY part) - {LATENESS} AS closed_to,
            max(max(start_minute)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              - {LATENESS} AS before
          FROM arrivals GROUP BY part) b
    JOIN marked a ON a.part <= b.part
    GROUP BY b.part""",
    (
        arrivals_sql(6 * 86_400),
        f"""clocks AS (
  SELECT part, max(max(start_minute)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - {LATENESS} AS before FROM arrivals GROUP BY part)""",
        f"""marked AS (
  SELECT part, start_minute - start_minute % {MINUTES} + {MINUTES} AS ends,
    coalesce(start_minute - start_minute % {MINUTES} + {MINUTES} <= before, false) AS late
  FROM arrivals JOIN clocks USING (part))""",
    ),
)
def late_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every batch of the load stream read, closed, dropped and left open."""
    root, session = scratch_path(spark, "late-stream"), intervals.stream_session(spark, STATE_PARTITIONS)
    write_arrivals(spark, sf_dir, f"{root}/in", 6 * 86_400)
    stream = LoadStream(session, root, MINUTES, LATENESS)
    stream.start(arrivals(session, sf_dir, f"{root}/in")).awaitTermination()
    return stream.ledger().select("batch", "read", "late", "emitted", "open")


@query(
    "stream_account",
    f"""SELECT count(*) AS read, count(*) FILTER (dropped) AS dropped,
      count(*) FILTER (NOT dropped AND ends <= last) AS emitted,
      count(*) FILTER (NOT dropped AND ends > last) AS open
    FROM (
      SELECT ends, last, coalesce(ends <= watermark, false) AS dropped
      FROM (SELECT part, epoch_us(ts) AS us,
              (start_minute - start_minute % {MINUTES} + {MINUTES}) * 60000000 AS ends FROM arrivals)
      JOIN (SELECT part, max(max(epoch_ms(ts) * 1000)) OVER (ORDER BY part
              ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS watermark FROM arrivals GROUP BY part) USING (part),
      (SELECT max(epoch_ms(ts) * 1000) AS last FROM arrivals))""",
    (arrivals_sql(2 * 86_400),),
)
def stream_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples read, emitted, open and dropped by a stream of more batches than it remembers.

    Rows come late to a batch if the watermark of the batch before it had passed their interval.
    """
    root, session = scratch_path(spark, "stream-account"), intervals.stream_session(spark, 1)
    session.conf.set("spark.sql.streaming.numRecentProgressUpdates", "4")
    write_arrivals(spark, sf_dir, f"{root}/in", 2 * 86_400)
    samples, name = arrivals(session, sf_dir, f"{root}/in"), root.rsplit("/", 1)[-1]
    books = ledger.BatchLedger(session, f"{root}/checkpoint", name)
    books.follow(
        lambda: intervals.stream_interval_stats(
            samples, MINUTES, f"{root}/data", f"{root}/checkpoint", "0 seconds", name
        )
    )
    stats = spark.read.parquet(f"{root}/data")
    return ledger.account(spark, stats, f"{root}/checkpoint", f"{root}/checkpoint").drop("dropped_rows")


@query(
    "load_series",
    f"""SELECT t.minute, tag, threads, mean, min, max, stddev, coalesce(count, 0) AS count,
      coalesce(errors, 0) AS errors
    FROM (SELECT *, unnest({TAGS}) AS tag FROM threads) t LEFT JOIN stats USING (minute, tag)""",
    (SAMPLES_SQL, STATS_SQL, READINGS_SQL, THREADS_SQL),
)
def load_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series(spark, sf_dir), 6, "mean", "stddev")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.timing_samples(spark, sf_dir)
    return intervals.load_series(samples, readings(samples), MINUTES, TAGS)


@query(
    "load_test_report",
    f"""SELECT 'events' AS file, tag, '[' || string_agg('{{"minute":' || minute || ',"threads":' || threads
      || ',"mean":' || coalesce(mean::VARCHAR, 'null') || ',"min":' || coalesce(min::VARCHAR, 'null')
      || ',"max":' || coalesce(max::VARCHAR, 'null')
      || ',"standardDeviation":' || coalesce(stddev::VARCHAR, 'null') || ',"count":' || coalesce(count, 0)
      || ',"error":"' || coalesce(errors, 0) || '"}}', ',' ORDER BY minute) || ']' AS document
    FROM (SELECT *, unnest({TAGS}) AS tag FROM threads) LEFT JOIN stats USING (minute, tag)
    GROUP BY tag""",
    (SAMPLES_SQL, STATS_SQL, READINGS_SQL, THREADS_SQL),
)
def load_test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.load_test_report({"events": series(spark, sf_dir)})


@query(
    "response_vs_threads",
    """SELECT tag, minute, threads, mean,
      round(mean / (1.1::DOUBLE * (SELECT max(mean) FROM stats)), 6) AS scaled
    FROM stats JOIN threads USING (minute) WHERE count > 0""",
    (SAMPLES_SQL, STATS_SQL, READINGS_SQL, THREADS_SQL),
)
def response_vs_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.response_vs_threads(series(spark, sf_dir)), 6, "mean", "scaled")


RUNS_SQL = """runs AS (
  SELECT event_type AS file, 'run' || CAST(user_id % 4 AS VARCHAR) AS tag, value AS elapsed_ms
  FROM events)"""


def load_store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as load/store runs: a spec file per event type, four kinds of run."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("file"),
        F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")).alias("tag"),
        F.col("value").alias("elapsed_ms"),
    )


RUN_STATS_SQL = """run_stats AS (
  SELECT file, tag, round(avg(elapsed_ms), 6) AS mean, min(elapsed_ms) AS min,
    max(elapsed_ms) AS max, round(stddev_pop(elapsed_ms), 6) AS stddev, count(*) AS count
  FROM runs GROUP BY file, tag)"""


@query(
    "load_store_report",
    """SELECT file, '{"' || file || '":{' || string_agg('"' || tag || '":{"avg":' || mean
      || ',"min":' || min || ',"max":' || max || ',"standardDeviation":' || stddev
      || ',"count":' || count || '}', ',' ORDER BY tag) || '}}' AS document
    FROM run_stats GROUP BY file""",
    (RUNS_SQL, RUN_STATS_SQL),
)
def load_store_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.load_store_report(load_store_runs(spark, sf_dir))


def printed_sql(name: str) -> str:
    """A duration below a minute as seconds with three decimals."""
    return f"""CAST(round({name}) AS BIGINT) // 1000 || '.'
      || lpad(CAST(CAST(round({name}) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || 's' AS {name}"""


@query(
    "load_store_printed",
    f"""SELECT file, tag, {", ".join(map(printed_sql, ("mean", "min", "max", "stddev")))},
      CAST(count AS VARCHAR) AS count FROM run_stats""",
    (RUNS_SQL, RUN_STATS_SQL),
)
def load_store_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = reports.load_store_stats(load_store_runs(spark, sf_dir))
    return reports.printed_stats(stats)


@query(
    "min_avg_max_series",
    """SELECT file, tag, min, mean, max, round(axis_limit, 6) AS axis_limit,
      round(min / axis_limit, 6) AS scaled_min, round(mean / axis_limit, 6) AS scaled_mean,
      round(max / axis_limit, 6) AS scaled_max
    FROM (SELECT *, 1.1::DOUBLE * max(max) OVER (PARTITION BY file) AS axis_limit FROM run_stats)""",
    (RUNS_SQL, RUN_STATS_SQL),
)
def min_avg_max_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = reports.load_store_stats(load_store_runs(spark, sf_dir))
    scaled = ["scaled_min", "scaled_mean", "scaled_max"]
    return rounded(reports.min_avg_max_series(stats), 6, "mean", "axis_limit", *scaled)


@query(
    "speedup_report",
    """SELECT query, first_sec, second_sec, floor(first_sec * 100 / second_sec) / 100 AS multiplier
    FROM (
      SELECT query, first_sec, second_sec FROM means
      UNION ALL
      SELECT 'Total', CAST(sum(first_sec) AS BIGINT), CAST(sum(second_sec) AS BIGINT) FROM means)""",
    (
        """means AS (
  SELECT event_type AS query,
    CAST(sum(sec) FILTER (engine = 0) AS BIGINT) // count(*) FILTER (engine = 0) AS first_sec,
    CAST(sum(sec) FILTER (engine = 1) AS BIGINT) // count(*) FILTER (engine = 1) AS second_sec
  FROM (SELECT event_type, user_id % 2 AS engine, CAST(trunc(value) AS BIGINT) AS sec FROM events)
  GROUP BY event_type)""",
    ),
)
def speedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("query"),
        F.when(F.col("user_id") % 2 == 0, "script").otherwise("program").alias("engine"),
        F.col("value").cast("bigint").alias("seconds"),
    )
    return reports.speedup_report(runs, "script", "program")
