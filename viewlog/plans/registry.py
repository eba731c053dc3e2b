"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``ctes`` are the views its SQL reads."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(ctes)}\n" if ctes else "") + sql.strip()
        return run

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Doubles whose last bits depend on the order of summation, made comparable."""
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


def placed(positions: DataFrame, *keys: str) -> DataFrame:
    """Rows with the position at which the rows of their key begin, as ``place``.

    Ties may stand in any order, so their own positions are not compared; but a row that stands
    apart from its key's block, or a block in the wrong place, gives another place or fails.
    """
    blocks = positions.groupBy(*keys).agg(
        F.min("position").alias("__first"),
        (F.max("position") - F.min("position") + 1 - F.count(F.lit(1))).alias("__gaps"),
    )
    names = {k: f"__{k}" for k in keys}
    blocks = blocks.withColumnsRenamed(names)
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in names.items()]
    whole = F.when(F.col("__gaps") == 0, F.col("__first")).otherwise(
        F.raise_error(F.lit("rows of one key are not next to each other")).cast("bigint")
    )
    return (
        positions.join(blocks, same)
        .withColumn("place", whole)
        .drop("position", "__first", "__gaps", *names.values())
    )


def round6(col: Column) -> Column:
    return F.round(col, 6)
