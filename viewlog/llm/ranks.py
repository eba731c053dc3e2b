"""Numbers of rows within groups in a given order, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewlog.operators.ordering import parts_for
from viewlog.session import scratch_path


def ranked(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Rows with ``index`` (from 0, within their group, in ascending order) and ``total``.

    Rows are dealt in ranges of (groups, order), so a hot group is cut like all others, and
    stored below the shared folder. The number of a row is its number in its file and the rows
    of its group in the files before; that sum has one row a file and group. ``rows`` is read
    twice (for the ranges), so it should be stored. Nulls come first. Rows equal in ``order``
    may be numbered in any way and stay in one range.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "ranks")
    keys = [F.col(c) for c in (*groups, *order)]
    rows.repartitionByRange(parts_for(rows), *keys).sortWithinPartitions(*keys).write.parquet(path)
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)-.*-c(\d+)", 1).cast("bigint") * 100_000
    file += F.regexp_extract("_metadata.file_name", r"part-(\d+)-.*-c(\d+)", 2).cast("bigint")
    stored = spark.read.schema(rows.schema).parquet(path)
    stored = stored.select("*", file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    runs = stored.groupBy("__file", *groups).agg(F.min("__row").alias("__first"), F.count("*").alias("__rows"))
    group = Window.partitionBy(*groups)
    before = F.sum("__rows").over(group.orderBy("__file")) - F.col("__rows")
    runs = runs.select(
        *[F.col(c).alias(f"__{c}") for c in ("__file", *groups)],
        (before - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(group).alias("total"),
    )
    same = [stored[c].eqNullSafe(runs[f"__{c}"]) for c in ("__file", *groups)]
    return stored.join(runs, same).select(
        *rows.columns, (F.col("__row") + F.col("__shift")).alias("index"), "total"
    )
