"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs are planned for. Everything works without them; with them AQE
# splits hot join keys, merges small shuffle partitions and keeps output files even.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Shuffles start with this many partitions and are merged to the size above. AQE merges
    # partitions and does not cut them, so it bounds the size of one on large inputs; raise it
    # with the input (a shuffle of 100 TB wants 800,000 of 128 MB).
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.session.timeZone": "UTC",
    # The JVM compiles no method above 8000 bytes of code. Wide projections, such as those of
    # the generator, run five times faster if Spark then splits them instead of fusing them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cpus: int | str = "*", app: str = "viewlog", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    # A thousand tiny partitions would cost a local run more than they save.
    few = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "64"}
    if "spark.sql.shuffle.partitions" in extra:
        few = {k: extra["spark.sql.shuffle.partitions"] for k in few}
    for key, value in {**SETTINGS, **few, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a cluster
    a missing setting is an error, because a machine-local folder would lose data.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="viewlog-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created or removed."""
    return os.path.join(shared_dir(spark), "viewlog", f"{name}-{uuid.uuid4().hex[:12]}")
