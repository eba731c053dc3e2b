"""Duplicate removal and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def distinct(df: DataFrame) -> DataFrame:
    """Each row once; null counts as a value. Map columns must be projected away before."""
    return df.distinct()


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of the inputs, duplicates kept, columns matched by name."""
    for other in others:
        first = first.unionByName(other)
    return first


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Each row of the inputs once: one shuffle, duplicates already dropped before it."""
    return union_all(first, *others).distinct()
