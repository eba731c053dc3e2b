"""Bounded samples of labelled documents, and the fold that labels are never read from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thinned(key: Column, wanted: int, total: int) -> Column:
    """True for a few more than ``wanted`` of ``total`` rows, by a hash of the key.

    Put before an ordered limit, which gathers up to ``wanted`` rows of every task otherwise.
    Eight standard deviations more than wanted pass on average.
    """
    share = min(1.0, (wanted + 8 * wanted**0.5 + 64) / max(1, total))
    return F.pmod(F.xxhash64(F.lit(101), key), F.lit(1 << 30)) < int(share * (1 << 30))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Callable[[Column], Column], rows_per_class: int
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most ``rows_per_class`` labelled documents of either label.

    The rows with the smallest hash of their id are taken, whatever the partitioning, and a
    document has one label (the larger of several). Also gives the count of all training rows
    by label, to undo the uneven sampling.
    """
    known = labels.select(
        F.col("doc_id").cast("bigint").alias("label_id"), F.col(f"`{label}`").cast("int").alias("y")
    )
    known = known.filter("label_id IS NOT NULL AND y IN (0, 1)").groupBy("label_id").agg(F.max("y").alias("y"))
    known = known.withColumn("trained", train(F.col("label_id"))).filter("trained")
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        few = thinned(F.col("label_id"), rows_per_class, totals.get(y, 0))
        part = known.filter((F.col("y") == y) & few).orderBy(F.xxhash64("label_id"), "label_id").limit(rows_per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(picked), F.col("doc_id") == F.col("label_id")
    )
    return rows.select("doc_id", "text", "y"), totals
