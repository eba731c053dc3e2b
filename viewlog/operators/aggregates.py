"""Grouped aggregates. All of them reduce on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_bag(first_field: str | Column) -> Column:
    """Number of rows whose first field is not null."""
    return F.count(first_field)


def conditional_count(condition: Column, first_field: Column) -> Column:
    """:func:`count_bag` over the rows of a nested filter."""
    return F.count_if(condition & first_field.isNotNull())


def count_distinct(df: DataFrame, key: str, col: str, alias: str) -> DataFrame:
    """Distinct non-null values of a column per key."""
    return df.groupBy(key).agg(F.count_distinct(col).alias(alias))


def int_mean_distinct(col: Column) -> Column:
    """Whole part of the mean of the distinct values."""
    return (F.sum_distinct(col) / F.nullif(F.count_distinct(col), F.lit(0))).cast("int")


def tagged_aggregate(
    df: DataFrame,
    branches: Mapping[str, tuple[Column, Column, Column]],
    key: str,
    exclusive: bool = False,
) -> DataFrame:
    """Several filtered group-bys over one input in one scan and one shuffle.

    ``branches`` maps a name to (predicate, key, aggregate). A row of the input counts in every
    branch whose predicate it meets. A row of the result has its branch, its key as text, and a
    column named after each branch, of which only that of its own branch is filled.

    With ``exclusive`` the caller states that no row meets two predicates: a row is then tagged
    by its first branch, in place of being copied once for each branch it meets.
    """
    if exclusive:
        tag = group = F.lit(None).cast("string")
        for name, (predicate, by, _) in reversed(branches.items()):
            tag = F.when(predicate, F.lit(name)).otherwise(tag)
            group = F.when(predicate, by.cast("string")).otherwise(group)
        tagged = df.withColumns({"__branch": tag, "__key": group}).filter("__branch IS NOT NULL")
    else:
        met = F.filter(
            F.array(
                *[
                    F.when(predicate, F.struct(F.lit(name).alias("b"), by.cast("string").alias("k")))
                    for name, (predicate, by, _) in branches.items()
                ]
            ),
            lambda branch: branch.isNotNull(),
        )
        tagged = df.withColumn("__met", F.explode(met)).withColumns(
            {"__branch": F.col("__met.b"), "__key": F.col("__met.k")}
        )
    aggregates = {f"__{name}": aggregate for name, (_, _, aggregate) in branches.items()}
    grouped = tagged.groupBy(F.col("__branch").alias("branch"), F.col("__key").alias(key)).agg(
        *[aggregate.alias(name) for name, aggregate in aggregates.items()]
    )
    return grouped.select(
        "branch",
        key,
        *[F.when(F.col("branch") == name, F.col(f"__{name}")).alias(name) for name in branches],
    )


def timing_stats(
    df: DataFrame, by: list[Column | str], elapsed: Column, sample_deviation: bool = False
) -> DataFrame:
    """Mean, min, max, standard deviation and count of timings per group.

    The deviation is that of the population unless ``sample_deviation`` is set.
    """
    deviation = F.stddev_samp if sample_deviation else F.stddev_pop
    return df.groupBy(*by).agg(
        F.avg(elapsed).alias("mean"),
        F.min(elapsed).alias("min"),
        F.max(elapsed).alias("max"),
        deviation(elapsed).alias("stddev"),
        F.count(elapsed).alias("count"),
    )
