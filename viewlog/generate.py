"""Synthetic tables as Spark jobs: a range of row numbers and column expressions over it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlog.functions import draw
from viewlog.operators.joins import join_replicated
from viewlog.schema import (
    PAGE_VIEW_SPECS,
    WIDE_ROW_INT_SPEC,
    WIDE_ROW_INTS,
    WIDE_ROW_USER_SPEC,
    ColSpec,
    TableSpec,
    parse_colspec,
)
from viewlog.sources.delimited import read_delimited, write_delimited

ROW_KEY = "__row"
DOMAIN_TYPES = ("float", "double", "string")
DOMAIN_SEP = "\t"
DRAWN_ROWS = 25_000  # a task draws the maps of so many rows in a second or two


def _parsed(specs: Mapping[str, ColSpec | str]) -> dict[str, ColSpec]:
    return {n: parse_colspec(s) if isinstance(s, str) else s for n, s in specs.items()}


def check_gen_conf(
    specs: Mapping[str, ColSpec | str],
    rows: int | None = None,
    source: DataFrame | None = None,
    output: str | None = "",
) -> None:
    """Refuse a generation request that cannot mean anything.

    Either a row count or existing rows to append to; at least one column; a null
    share within 0-100 (checked by the spec); a named output when one is asked for.
    """
    if (rows is None or rows < 1) and source is None:
        raise ValueError(f"row count {rows} is below 1 and there are no input rows")
    if rows is not None and rows > 0 and source is not None:
        raise ValueError(f"row count {rows} and input rows exclude each other")
    if not specs:
        raise ValueError("no column specs given")
    if output is None or (isinstance(output, str) and output != "" and not output.strip()):
        raise ValueError("the output needs a name")
    for spec in _parsed(specs).values():
        inner = spec.element or spec
        if inner.dtype == "string":
            draw.length_shares(inner)
        if inner.dtype == "map":
            draw.string_lengths(inner.avg_length)


def _add(df: DataFrame, specs: Mapping[str, ColSpec | str], key: Column, seed: int) -> DataFrame:
    """The rows with all generated columns; values of mapped columns come from their files."""
    parsed, kept = _parsed(specs), df.columns
    mapped = {n: s for n, s in parsed.items() if s.map_file and s.dtype in DOMAIN_TYPES}
    cells = {
        name: draw.nullable_index(spec, key, seed, position)
        if name in mapped
        else draw.nullable_value(spec, key, seed, position)
        for position, (name, spec) in enumerate(parsed.items())
    }
    df = draw.add_columns(df, cells)
    for name, spec in mapped.items():
        df = _look_up(df, name, spec)
    return df.select(*[F.col(f"`{c}`") for c in [*kept, *parsed]])


def _look_up(df: DataFrame, name: str, spec: ColSpec) -> DataFrame:
    """Replace a column's domain index by its value in the spec's map file."""
    spark = df.sparkSession
    schema = f"__at bigint, __value {spec.spark_type.simpleString()}"
    domain = read_delimited(spark, spec.map_file, schema, DOMAIN_SEP)
    rows = df.withColumnRenamed(name, "__index")
    joined = join_replicated(rows, domain, "__index", "__at", "left")
    problem = F.concat(F.lit(f"{spec.map_file} has no value for number "), F.col("__index"))
    missing = F.col("__index").isNotNull() & F.col("__at").isNull()
    value = F.when(missing, F.raise_error(problem)).otherwise(F.col("__value"))
    return joined.withColumn(name, value).drop("__index", "__at", "__value")


def gen_table(
    spark: SparkSession,
    specs: Mapping[str, ColSpec | str],
    rows: int,
    seed: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """``rows`` independent rows; ``parts`` sets the parallelism and never the data."""
    check_gen_conf(specs, rows=rows)
    numbers = spark.range(0, rows, 1, parts).withColumnRenamed("id", ROW_KEY)
    return _add(numbers, specs, F.col(ROW_KEY), seed).drop(ROW_KEY)


def gen_append(
    df: DataFrame,
    specs: Mapping[str, ColSpec | str],
    key: Column | str,
    seed: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """Existing rows with generated columns added, drawn from the row's key.

    ``parts`` deals the rows out to that many tasks first and never sets the data. Maps and bags take
    far longer to draw than their keys to read, and one task reads a few megabytes of keys.
    """
    check_gen_conf(specs, source=df)
    taken = {c.lower() for c in df.columns} & {n.lower() for n in specs}
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    key = F.col(key) if isinstance(key, str) else key
    return _add(df if parts is None else df.repartition(parts), specs, key, seed)


def parts_to_draw(df: DataFrame) -> int:
    """Tasks for the maps or bags of stored rows, by their count."""
    return max(1, -(-df.count() // DRAWN_ROWS))


def value_domain(spark: SparkSession, spec: ColSpec | str, seed: int = 0, column: int = 0) -> DataFrame:
    """All values of a float, double or string column by index; each value comes once."""
    spec = parse_colspec(spec) if isinstance(spec, str) else spec
    stream = draw.salt(seed, column, draw.TEXT)
    idx = F.col("index")
    if spec.dtype not in DOMAIN_TYPES:
        raise ValueError(f"a {spec.dtype} column has no value domain")
    if spec.dtype == "string":
        cell = draw.domain_string(spec, idx, stream)
    else:
        cell = _ready(draw.domain_number(spec, idx, stream))
    indexes = spark.range(spec.cardinality).withColumnRenamed("id", "index")
    return draw.add_columns(indexes, {"value": cell})


def write_value_domain(
    spark: SparkSession, spec: ColSpec | str, path: str, seed: int = 0, column: int = 0
) -> None:
    """Store a domain as a map file (number, tab, value) for the sixth part of a column spec."""
    write_delimited(value_domain(spark, spec, seed, column), path, DOMAIN_SEP)


def _ready(col: Column) -> draw.Cell:
    """A finished expression as a cell."""
    return col
    yield


def gen_page_views(spark: SparkSession, rows: int, seed: int = 0, parts: int | None = None) -> DataFrame:
    return gen_table(spark, PAGE_VIEW_SPECS, rows, seed, parts)


def wide_row_specs() -> dict[str, str]:
    return {"user": WIDE_ROW_USER_SPEC} | {
        f"int_{i}": WIDE_ROW_INT_SPEC for i in range(1, WIDE_ROW_INTS + 1)
    }


def gen_wide_rows(spark: SparkSession, rows: int, seed: int = 0, parts: int | None = None) -> DataFrame:
    return gen_table(spark, wide_row_specs(), rows, seed, parts)


def gen_from_spec(
    spark: SparkSession, spec: TableSpec, seed: int = 0, parts: int | None = None
) -> DataFrame:
    """The rows of a table spec, partition keys last."""
    return gen_table(spark, dict(spec.columns + spec.partitions), spec.rows, seed, parts)
