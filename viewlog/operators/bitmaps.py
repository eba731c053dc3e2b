"""Exact distinct counts of integers that merge: bitmaps by key, stored and or-ed.

An integer is a bit in one of many buckets of 64, the bits of a bigint. A row per key and bucket
holds the bits seen; rows of any parts of the data (a day, a file) combine by or. There are never
more such rows than distinct values, however thin a key's values lie, and unlike rows they never
grow with the input's, so a hot key sends one row a bucket and task to the shuffle, and several
distinct counts of one input need no copy of it per column.

Rows have a fixed width on purpose. Bitmaps of 4 KB that are almost empty shrink so well in a shuffle
that partitions merged by their bytes there fill a task's memory once they are unpacked.

Rows are dealt out before bitmaps are made of them. A scan task reads whole row groups, however long, and
would hold a bitmap for every key and bucket in them. Equal rows of a key come to one task, which streams
them and holds one bitmap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BUCKET_BITS = 6  # 2^6 values, one for each bit of a bigint
# Partitions that rows are dealt to; AQE merges small ones and cuts large ones to its advisory size. Up to
# spark.shuffle.sort.bypassMergeThreshold of them, 200, a scan task writes rows straight to files and holds none.
DEAL_PARTS = 200


def bitmaps(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """(by..., bucket, bits) of an integer column. A key with nulls alone has an empty bitmap."""
    value = F.col(f"`{col}`").cast("bigint")
    place = value.bitwiseAND(F.lit(2**BUCKET_BITS - 1).cast("bigint")).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    # By key and value, so that a hot key is in many partitions and equal rows meet before the next shuffle.
    dealt = df.hint("rebalance", DEAL_PARTS, *[F.col(c) for c in by], F.col(f"`{col}`"))
    return dealt.groupBy(*by, F.shiftright(value, BUCKET_BITS).alias("bucket")).agg(
        F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint")).alias("bits")
    )


def merge_bitmaps(parts: DataFrame, by: list[str]) -> DataFrame:
    """Bitmaps of coarser keys, or of parts that were stored apart."""
    return parts.groupBy(*by, "bucket").agg(F.bit_or("bits").alias("bits"))


def count_bits(parts: DataFrame, by: list[str], alias: str) -> DataFrame:
    """Distinct values per key from bitmaps of any parts: or, then count."""
    merged = merge_bitmaps(parts, by)
    return merged.groupBy(*by).agg(F.sum(F.bit_count("bits")).alias(alias))


def append_bitmaps(df: DataFrame, path: str, by: list[str], cols: list[str], part: Column, name: str = "day") -> None:
    """Store the bitmaps of some columns for each value of ``part``, beside what is there.

    Each column has a folder of its own, as its buckets are its own.
    """
    for col in cols:
        rows = bitmaps(df.withColumn(name, part), [name, *by], col)
        rows.hint("rebalance", name).write.mode("append").partitionBy(name).parquet(f"{path}/{col}")


def stored_counts(
    spark: SparkSession, path: str, by: list[str], aliases: dict[str, str], where: Column | None = None
) -> DataFrame:
    """Distinct counts per key of several columns (column: alias) from stored bitmaps alone.

    ``where`` chooses parts, such as a range of days. Columns meet on the key, each a row a key.
    """

    def counted(col: str, alias: str) -> DataFrame:
        parts = spark.read.parquet(f"{path}/{col}")
        return count_bits(parts if where is None else parts.filter(where), by, alias)

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        names = {c: f"__{c}" for c in by}
        b = b.withColumnsRenamed(names)
        same = reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{n}`")) for c, n in names.items()])
        return a.join(b, same).drop(*names.values())

    return reduce(met, [counted(c, a) for c, a in aliases.items()])
