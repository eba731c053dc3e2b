"""Delimited and line-oriented text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlog.functions import text
from viewlog.schema import PAGE_VIEWS


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = text.FIELD_SEP,
    columns: list[str] | None = None,
) -> DataFrame:
    """Separated text under a declared schema, fields by position.

    The layout has no quotes, escapes or comments: every character but the separator is
    data. An empty or missing field and an unreadable number are null; a line of empty
    fields is a row of nulls (a CSV reader would skip it as blank). With ``columns``, lines
    are split no further than the last of them, which saves most of the work on wide rows.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wanted = schema.names if columns is None else columns
    last = max(schema.names.index(c) for c in wanted)
    names = schema.names[: last + 1]
    limit = -1 if last + 1 == len(schema.names) else last + 2
    raw = split_lines(read_lines(spark, path), names, sep, limit)
    return raw.select(
        *[
            F.col(f"`{name}`")
            if isinstance(schema[name].dataType, T.StringType)
            else F.col(f"`{name}`").try_cast(schema[name].dataType).alias(name)
            for name in wanted
        ]
    )


def write_delimited(
    df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists"
) -> None:
    """Rows as separated text, a null as an empty field.

    The layout has no escapes: a value that holds the separator or a line break would shift or
    split its row when read, so it fails the write.
    """
    df.select(as_line(df, df.columns, sep).alias("line")).write.mode(mode).text(path)


def as_line(df: DataFrame, columns: list[str], sep: str) -> Column:
    """A row's line in the layout of :func:`write_delimited`, of the named columns."""
    nested = [c for c in columns if isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType))]
    if nested:
        raise ValueError(f"encode map and bag columns before writing text: {nested}")
    fields = [F.coalesce(_plain(df, c, [sep, "\n", "\r"]), F.lit("")) for c in columns]
    return F.concat_ws(sep, *fields)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, one column holding all of it."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def split_lines(
    lines: DataFrame, names: list[str], sep: str = text.FIELD_SEP, limit: int = -1
) -> DataFrame:
    """Lines to text columns by position."""
    fields = lines.select(text.split_raw(F.col("line"), sep, limit).alias("f"))
    return fields.select(
        *[text.empty_to_null(F.get("f", F.lit(i))).alias(n) for i, n in enumerate(names)]
    )


def drop_malformed(lines: DataFrame, n: int, sep: str = text.FIELD_SEP) -> DataFrame:
    """Only the lines that have exactly ``n`` fields."""
    return lines.filter(_field_count(sep) == n)


def count_malformed(lines: DataFrame, n: int, sep: str = text.FIELD_SEP) -> DataFrame:
    """How many lines :func:`drop_malformed` keeps and rejects."""
    good = _field_count(sep) == n
    return lines.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("rejected"))


def _field_count(sep: str) -> Column:
    return F.length("line") - F.length(F.translate("line", sep, "")) + 1


def read_tuple_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``(f1, f2, ...)`` lines to trimmed text columns; a missing field is null."""
    fields = read_lines(spark, path).select(text.tuple_fields(F.col("line")).alias("f"))
    return fields.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def write_tuple_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each row as one ``(a,b,c)`` line; a value with a comma or a line break fails the write."""
    fields = [_plain(df, c, [",", "\n", "\r"]) for c in df.columns]
    df.select(text.tuple_text(*fields).alias("line")).write.mode(mode).text(path)


def _plain(df: DataFrame, name: str, signs: list[str]) -> Column:
    """A column as text, which must not hold one of the signs; only text columns can."""
    field = F.col(f"`{name}`").cast("string")
    if not isinstance(df.schema[name].dataType, T.StringType):
        return field
    bad = reduce(Column.__or__, [F.contains(field, F.lit(sign)) for sign in signs])
    message = F.concat(F.lit(f"a value of {name} holds a separator or line break: "), F.substring(field, 1, 80))
    return F.when(bad, F.raise_error(message).cast("string")).otherwise(field)


def encode_page_views(df: DataFrame) -> DataFrame:
    """The nine page-view columns with map and bag as text, ready for :func:`write_delimited`."""
    return df.select(*PAGE_VIEWS.names).withColumns(
        {
            "page_info": text.encode_map(F.col("page_info")),
            "page_links": text.encode_bag(F.col("page_links")),
        }
    )


def decode_page_views(df: DataFrame, duplicates: str = "last") -> DataFrame:
    """Text columns to the page-view schema; a field that does not parse is null."""
    typed = []
    for field in (PAGE_VIEWS[name] for name in df.columns):
        col = F.col(f"`{field.name}`")
        if field.name == "page_info":
            col = text.decode_map(col, duplicates)
        elif field.name == "page_links":
            col = text.decode_bag(col, duplicates=duplicates)
        elif not isinstance(field.dataType, T.StringType):
            col = col.try_cast(field.dataType)
        typed.append(col.alias(field.name))
    return df.select(*typed)


def read_page_views(
    spark: SparkSession, path: str, columns: list[str] | None = None, duplicates: str = "last"
) -> DataFrame:
    """The nine-column page-view source, or some of its columns, with map and bag decoded.

    What a query does not use is neither decoded nor parsed. For files whose maps are known to
    have no key twice, ``duplicates="error"`` saves the search for repeats.
    """
    raw = T.StructType([T.StructField(n, T.StringType()) for n in PAGE_VIEWS.names])
    return decode_page_views(read_delimited(spark, path, raw, columns=columns), duplicates)


def write_page_views(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_delimited(encode_page_views(df), path, text.FIELD_SEP, mode)
