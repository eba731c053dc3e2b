"""A record of every batch of a stream, kept for its whole life beside its checkpoint.

A query object remembers its last 100 batches and forgets all of them when the stream is started
again. A :class:`BatchLedger` stores what each progress report says under the batch's number; a
batch that runs again overwrites its record.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

RECORD = "batch bigint, read bigint, dropped_rows bigint, state_rows bigint"


def ledger_path(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-ledger"


class BatchLedger(StreamingQueryListener):
    """Writes one small record per batch of the query named ``name``."""

    def __init__(self, spark: SparkSession, checkpoint: str, name: str):
        self.spark, self.path, self.name = spark, ledger_path(checkpoint), name
        self.ended = threading.Event()
        self.run_id = None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run_id = event.runId

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name == self.name:
            record = {
                "batch": progress.batchId,
                "read": progress.numInputRows,
                "dropped_rows": sum(o.numRowsDroppedByWatermark for o in progress.stateOperators),
                "state_rows": sum(o.numRowsTotal for o in progress.stateOperators),
            }
            self._store(f"{self.path}/batch-{progress.batchId:012d}.json", json.dumps(record))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run_id:
            self.ended.set()

    def _store(self, path: str, text: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def follow(self, start) -> StreamingQuery:
        """Run ``start()``, which begins the query of this name, until it ends and all is recorded.

        Reports arrive in order on a thread of their own; the end of the query is the last one.
        """
        streams = self.spark.streams
        streams.addListener(self)
        try:
            query = start()
            query.awaitTermination()
            if not self.ended.wait(60):
                raise TimeoutError("the end of the stream was not reported")
        finally:
            streams.removeListener(self)
        return query


def records(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All records of a stream, one row a batch."""
    return spark.read.schema(RECORD).json(ledger_path(checkpoint))


def account(spark: SparkSession, stats: DataFrame, checkpoint: str, state_path: str) -> DataFrame:
    """(read, emitted, open, dropped, dropped_rows) of an interval-statistics stream's whole life.

    Samples read are counted by the ledger, emitted ones in the stored statistics, open ones in
    the stream's own state; what is in neither was dropped as late. The watermark drops rows that
    are reduced to one per interval, tag and task: ``dropped_rows`` counts those.
    """
    state = spark.read.format("statestore").load(state_path)
    # The state holds the aggregates in their order, names repeated; the last two are counts.
    kinds = [f.dataType.simpleString() for f in state.schema["value"].dataType.fields]
    held = F.col("value").cast(f"struct<{', '.join(f'c{i}: {k}' for i, k in enumerate(kinds))}>")
    held = held[f"c{len(kinds) - 2}"] + held[f"c{len(kinds) - 1}"]
    nothing = {n: F.lit(0).cast("bigint") for n in ("read", "emitted", "open", "dropped_rows")}

    def part(rows: DataFrame, **found: Column) -> DataFrame:
        return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in {**nothing, **found}.items()])

    parts = part(records(spark, checkpoint), read=F.col("read"), dropped_rows=F.col("dropped_rows"))
    parts = parts.unionByName(part(stats, emitted=F.col("count") + F.col("errors"))).unionByName(part(state, open=held))
    whole = parts.agg(*[F.sum(n).alias(n) for n in nothing])
    return whole.withColumn("dropped", F.col("read") - F.col("emitted") - F.col("open"))
