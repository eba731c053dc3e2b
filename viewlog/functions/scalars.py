"""Scalar column expressions of the queries and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COPY_SUFFIX = "_copy"


def bincond(condition: Column, then: Column, otherwise: Column) -> Column:
    """Two-way choice; a null condition gives null."""
    return F.when(condition, then).when(~condition, otherwise)


def map_lookup(col: Column, key: str) -> Column:
    """Value of a key, null when the map or the key is missing."""
    return F.try_element_at(col, F.lit(key))


def to_int(col: Column) -> Column:
    """Integer cast: numbers lose their fraction, unreadable text becomes null."""
    return col.try_cast("int")


def text_to_int(col: Column) -> Column:
    """Integer of a text that may carry a fraction (``3.7`` gives 3), null when unreadable."""
    return F.coalesce(col.try_cast("int"), col.try_cast("double").try_cast("int"))


def floor_to(stamp: Column, step: int) -> Column:
    """Start of the ``step``-wide interval an integer stamp lies in."""
    return stamp - F.pmod(stamp, F.lit(step))


def integer_mean(total: Column, count: Column) -> Column:
    """Whole part of a mean of whole numbers, as shell arithmetic gives it."""
    return F.floor(total / F.nullif(count, F.lit(0))).cast("bigint")


def ratio2(left: Column, right: Column) -> Column:
    """Quotient cut (not rounded) to two decimals; null where the divisor is 0."""
    return F.floor(left * 100 / F.nullif(right, F.lit(0))) / 100


def scale_to(col: Column, limit: Column) -> Column:
    """Share of a series value in its axis limit; 0 for an axis without extent."""
    return F.when(limit > 0, col / limit).otherwise(F.lit(0.0))


def format_duration(millis: Column) -> Column:
    """``1h2m3.456s`` from milliseconds, ``-`` for null.

    Parts that are zero are left out, except that a zero duration prints ``0.000s``.
    """
    ms = F.round(millis).cast("bigint")
    hours = F.floor(ms / 3600000)
    minutes = F.floor(F.pmod(ms, F.lit(3600000)) / 60000)
    rest = F.pmod(ms, F.lit(60000))
    seconds = F.format_string("%d.%03ds", F.floor(rest / 1000), F.pmod(rest, F.lit(1000)))
    text = F.concat_ws(
        "",
        F.when(hours != 0, F.concat(hours.cast("string"), F.lit("h"))),
        F.when(minutes != 0, F.concat(minutes.cast("string"), F.lit("m"))),
        F.when((rest != 0) | (ms == 0), seconds),
    )
    return F.when(ms.isNull(), F.lit("-")).otherwise(text)


def format_count(count: Column) -> Column:
    return F.coalesce(count.cast("string"), F.lit("0"))


def qualified_name(database: Column, table: Column) -> Column:
    return F.concat_ws(".", database, table)


def copy_name(table: Column) -> Column:
    return F.concat(table, F.lit(COPY_SUFFIX))


def original_name(table: Column) -> Column:
    """Undo :func:`copy_name`; a name without the suffix is an error."""
    return F.when(
        table.endswith(COPY_SUFFIX), F.regexp_replace(table, f"{COPY_SUFFIX}$", "")
    ).otherwise(
        F.raise_error(F.concat(F.lit(f"no {COPY_SUFFIX} suffix in the name: "), table))
    )


def with_slash(path: Column) -> Column:
    """A directory name with a closing slash; an empty name is an error."""
    checked = F.when(
        F.coalesce(F.length(path), F.lit(0)) == 0, F.raise_error(F.lit("empty directory name"))
    ).otherwise(path)
    return F.when(checked.endswith("/"), checked).otherwise(F.concat(checked, F.lit("/")))


def partition_dir(key: str, value: Column) -> Column:
    """``key=value``, the directory name of a partition."""
    return F.concat(F.lit(f"{key}="), value.cast("string"))
