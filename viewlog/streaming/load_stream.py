"""A stream of call samples to statistics and thread counts of closed intervals, with its books.

Each batch reduces its samples once, merges them with the open part of the stream, and stores
under its batch id what it closes and what stays open:

- ``timing``: states of open intervals (:mod:`viewlog.streaming.timing_states`);
- ``threads``: per client the change of its thread count in each open interval, and one row
  without a minute that holds all changes before: the value that is carried forward;
- ``series`` and ``clients``: what the batch closed;
- ``ledger``: one row that counts the samples the batch read, closed, dropped as late and left
  open. It is written last and makes the batch valid.

The state follows from the previous batch's state and the batch's samples alone, and every
table of a batch is overwritten if it runs again: a restart or a repeated batch changes nothing
and counts nothing twice. State has a row per open interval and tag or client, however many
samples there are; the driver sees one ledger row a batch. Rows without a start take no part.

An interval closes when the clock (the latest start seen) passes its end by ``lateness``
minutes. A sample of a closed interval is late and dropped, its thread change too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from viewlog.sources.catalog import write_finished
from viewlog.streaming import timing_states as ts
from viewlog.streaming.intervals import minute_of

LEDGER = "batch bigint, read bigint, emitted bigint, late bigint, open bigint, clock bigint, closed_to bigint"
TIMING = "minute bigint, tag string, count bigint, mean double, m2 double, min double, max double, errors bigint"
# Before the first sample every interval is open.
NEVER = -(1 << 60)


class LoadStream:
    """Samples have mapper, tag, start, elapsed_ms, error, and joins: a thread of the client began."""

    def __init__(self, spark: SparkSession, root: str, minutes: int, lateness: int):
        self.spark, self.root, self.minutes, self.lateness = spark, root.rstrip("/"), minutes, lateness

    def start(self, samples: DataFrame) -> StreamingQuery:
        """Take in what is there, in the batches the source makes, and stop."""
        return (
            samples.writeStream.foreachBatch(self.advance)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    def _at(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def _put(self, rows: DataFrame, table: str, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._at(table, batch))
        return rows.sparkSession.read.schema(rows.schema).parquet(self._at(table, batch))

    def advance(self, samples: DataFrame, batch: int) -> None:
        """Merge one batch into the state of the batch before."""
        spark = samples.sparkSession
        floor = ts.floor_minute(minute_of(F.col("start")), self.minutes)
        cells = samples.filter("start IS NOT NULL").groupBy("mapper", "tag", floor.alias("minute")).agg(
            *ts.state_columns(),
            F.count_if("joins").alias("joined"),
            F.count(F.lit(1)).alias("samples"),
            F.max(minute_of(F.col("start"))).alias("latest"),
        )
        cells = self._put(cells, "cells", batch)
        before = {"clock": NEVER, "closed_to": NEVER}
        if batch:
            if not write_finished(spark, self._at("ledger", batch - 1)):
                raise RuntimeError(f"the state of batch {batch - 1} is missing below {self.root}")
            before = spark.read.schema(LEDGER).parquet(self._at("ledger", batch - 1)).first().asDict()
        in_time = F.col("minute") + self.minutes > before["closed_to"]
        read, late, latest = cells.agg(
            F.coalesce(F.sum("samples"), F.lit(0)),
            F.coalesce(F.sum(F.when(~in_time, F.col("samples"))), F.lit(0)),
            F.max("latest"),
        ).first()
        clock = max(before["clock"], NEVER if latest is None else latest)
        closed_to = max(before["closed_to"], clock - self.lateness)
        closed = F.col("minute") + self.minutes <= closed_to
        cells = cells.filter(in_time)

        timing = cells.select(*ts.STATE)
        if batch:
            timing = timing.unionByName(spark.read.schema(timing.schema).parquet(self._at("timing", batch - 1)))
        timing = ts.merge_states(timing, self.minutes)
        series = self._put(ts.stats_of(timing.filter(closed)), "series", batch)
        timing = self._put(timing.filter(~closed), "timing", batch)

        changes = cells.groupBy("mapper", "minute").agg(F.sum("joined").alias("joined"))
        if batch:
            known = spark.read.schema(changes.schema).parquet(self._at("threads", batch - 1))
            changes = changes.unionByName(known).groupBy("mapper", "minute").agg(F.sum("joined").alias("joined"))
        self._put(self._carried(changes).filter(closed), "clients", batch)
        past = F.when(~closed, F.col("minute"))
        self._put(changes.groupBy("mapper", past.alias("minute")).agg(F.sum("joined").alias("joined")), "threads", batch)

        calls = F.coalesce(F.sum(F.col("count") + F.col("errors")), F.lit(0))
        emitted, left = series.agg(calls).first()[0], timing.agg(calls).first()[0]
        row = [(batch, read, emitted, late, left, clock, closed_to)]
        self._put(spark.createDataFrame(row, LEDGER).coalesce(1), "ledger", batch)

    def _carried(self, changes: DataFrame) -> DataFrame:
        """(mapper, minute, threads): all changes up to each interval in which a client has samples.

        The row without a minute comes first and carries what was closed before.
        """
        so_far = Window.partitionBy("mapper").orderBy(F.col("minute").asc_nulls_first())
        threads = F.sum("joined").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
        return changes.select("mapper", "minute", threads.alias("threads")).filter("minute IS NOT NULL")

    def ledger(self) -> DataFrame:
        """One row per batch of the stream's whole life."""
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger").select(*[c.split()[0] for c in LEDGER.split(", ")])

    def _last(self) -> int:
        return self.ledger().agg(F.max("batch")).first()[0]

    def _closed(self, table: str, last: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}").filter(F.col("batch") <= last).drop("batch")

    def statistics(self, with_open: bool = False) -> DataFrame:
        """Statistics per interval and tag: closed ones, and on demand the open ones as they stand."""
        last = self._last()
        found = self._closed("series", last)
        return found.unionByName(ts.stats_of(self.spark.read.parquet(self._at("timing", last)))) if with_open else found

    def client_threads(self, with_open: bool = False) -> DataFrame:
        """(mapper, minute, threads) of the intervals in which a client has samples."""
        last = self._last()
        found = self._closed("clients", last)
        return found.unionByName(self._carried(self.spark.read.parquet(self._at("threads", last)))) if with_open else found

    def threads(self, with_open: bool = False) -> DataFrame:
        """Threads per interval, summed over clients."""
        return self.client_threads(with_open).groupBy("minute").agg(F.sum("threads").alias("threads"))

    def series(self, tags: list[str], with_open: bool = False) -> DataFrame:
        """Threads, statistics and errors per interval and tag, as of the batch report."""
        every_tag = F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag")
        grid = self.threads(with_open).select("minute", "threads", every_tag)
        return grid.join(self.statistics(with_open), ["minute", "tag"], "left").fillna(0, subset=["count", "errors"])
