"""Projection, renaming, flattening, splitting and widening."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[f"`{n}`" for n in names])


def project_positional(df: DataFrame, *positions: int) -> DataFrame:
    """Columns by position, for rows whose fields have no agreed names."""
    return df.select(*[df[f"`{df.columns[i]}`"] for i in positions])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(dict(names))


def flatten_bag(df: DataFrame, bag: str, alias: str | None = None) -> DataFrame:
    """One row per element; a null bag keeps its row with a null, an empty bag drops it."""
    col = F.col(bag)
    item = F.explode(F.when(col.isNull(), F.array(F.lit(None))).otherwise(col))
    rest = [F.col(f"`{c}`") for c in df.columns if c != bag]
    return df.select(*rest, item.alias(alias or bag))


def flattened_rows(bag: Column) -> Column:
    """How many rows :func:`flatten_bag` makes of a row, without making them."""
    return F.when(bag.isNull(), F.lit(1)).otherwise(F.size(bag)).cast("bigint")


def filter_null(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which all the named columns are null."""
    for name in names:
        df = df.filter(F.col(name).isNull())
    return df


def filter_not_null(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names))


def split(df: DataFrame, branches: Mapping[str, Column]) -> dict[str, DataFrame]:
    """Named outputs by predicate; a row may go to several of them or to none.

    Each branch is a filter of the same input, so its predicate reaches the scan. Who
    runs several branches as separate jobs over an expensive input persists it first.
    """
    return {name: df.filter(predicate) for name, predicate in branches.items()}


def widen(df: DataFrame, copies: int) -> DataFrame:
    """Every column ``copies`` times; the repeats carry the suffixes _1, _2, ..."""
    return df.select(
        *[
            F.col(f"`{c}`").alias(c if i == 0 else f"{c}_{i}")
            for i in range(copies)
            for c in df.columns
        ]
    )
