"""Catalog tables: definition, partitions, and load, store and copy jobs."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlog.functions.scalars import COPY_SUFFIX
from viewlog.generate import gen_from_spec
from viewlog.schema import TableSpec
from viewlog.sources.delimited import read_delimited, write_delimited

LOG = logging.getLogger(__name__)
TEXT_SEP = ","


class RowCountError(AssertionError):
    """A write stored another number of rows than its spec asks for."""


def quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def create_table(spark: SparkSession, spec: TableSpec, location: str | None = None) -> None:
    """Create the table unless it exists: columns, then partition keys, stored by column.

    Without a location the catalog keeps the files and removes them when the table is dropped.
    """
    names = [f"`{n}` {s.spark_type.simpleString()}" for n, s in spec.columns + spec.partitions]
    keys = ", ".join(f"`{n}`" for n, _ in spec.partitions)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted(spec.qualified)} ({', '.join(names)}) USING parquet"
        + (f" PARTITIONED BY ({keys})" if keys else "")
        + (f" LOCATION {_literal(location)}" if location else "")
    )


def drop_table(spark: SparkSession, name: str) -> bool:
    """Drop a table if it is there; a failure is logged, not raised."""
    try:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
        return True
    except AnalysisException as problem:
        LOG.info("could not drop %s: %s", name, problem)
        return False


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """Column and storage metadata of a table."""
    return spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}")


def load_catalog(spark: SparkSession, name: str) -> DataFrame:
    """A scan of a catalog table under the catalog's schema."""
    return spark.table(quoted(name))


def store_catalog(df: DataFrame, name: str) -> None:
    """Append rows to an existing table; partitions follow from the rows' values.

    Rows are first brought together by partition value. The rebalance lets AQE merge small
    partitions and cut large ones, so neither thousands of tiny files nor one huge task arise.
    """
    spark = df.sparkSession
    keys = [c.name for c in spark.catalog.listColumns(quoted(name)) if c.isPartition]
    rows = df.select(*[f"`{c}`" for c in spark.table(quoted(name)).columns])
    if keys:
        rows = rows.hint("rebalance", *keys)
    rows.write.insertInto(quoted(name))


def add_partition(spark: SparkSession, name: str, values: Mapping[str, object]) -> None:
    """Register one partition at its usual directory; an existing one is left alone."""
    spec = ", ".join(f"`{k}` = {_literal(v)}" for k, v in values.items())
    spark.sql(f"ALTER TABLE {quoted(name)} ADD IF NOT EXISTS PARTITION ({spec})")


def add_partitions(spark: SparkSession, name: str, values: Sequence[Mapping[str, object]]) -> None:
    """Register many partitions in one statement, which the catalog takes as one request."""
    if values:
        specs = [", ".join(f"`{k}` = {_literal(v)}" for k, v in each.items()) for each in values]
        listed = " ".join(f"PARTITION ({spec})" for spec in specs)
        spark.sql(f"ALTER TABLE {quoted(name)} ADD IF NOT EXISTS {listed}")


def recover_partitions(spark: SparkSession, name: str) -> None:
    """Register every partition whose directory lies below the table, in one statement."""
    spark.sql(f"ALTER TABLE {quoted(name)} RECOVER PARTITIONS")


def analyze_table(spark: SparkSession, name: str) -> None:
    """Store the row count and column statistics of a table, and the rows of each partition.

    Joins then know its size without a job (:mod:`viewlog.operators.table_sizes`).
    """
    columns = spark.table(quoted(name)).schema
    keys = [c.name for c in spark.catalog.listColumns(quoted(name)) if c.isPartition]
    plain = [f"`{f.name}`" for f in columns if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    if keys:
        listed = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"ANALYZE TABLE {quoted(name)} PARTITION ({listed}) COMPUTE STATISTICS")
    spark.sql(f"ANALYZE TABLE {quoted(name)} COMPUTE STATISTICS")
    if plain:
        spark.sql(f"ANALYZE TABLE {quoted(name)} COMPUTE STATISTICS FOR COLUMNS {', '.join(plain)}")


def partition_rows(spark: SparkSession, name: str, values: Mapping[str, object]) -> int | None:
    """Rows of a partition by its statistics, without a look at its files; None if not analysed."""
    spec = ", ".join(f"`{k}` = {_literal(v)}" for k, v in values.items())
    said = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)} PARTITION ({spec})")
    found = said.filter("col_name = 'Partition Statistics'").select("data_type").first()
    rows = re.search(r"(\d+) rows", found[0]) if found else None
    return int(rows.group(1)) if rows else None


def _literal(value: object) -> str:
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def list_partitions(spark: SparkSession, name: str) -> DataFrame:
    """All partitions of a table, one row each, as ``key=value/...`` names."""
    return spark.sql(f"SHOW PARTITIONS {quoted(name)}")


def partition_sizes(spark: SparkSession, name: str) -> DataFrame:
    """Rows per partition."""
    keys = [c.name for c in spark.catalog.listColumns(quoted(name)) if c.isPartition]
    return load_catalog(spark, name).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def check_row_count(
    df: DataFrame,
    expected: int,
    write: Callable[[DataFrame], None],
    recount: Callable[[], int] | None = None,
) -> int:
    """Run ``write`` on the rows and compare the number written to ``expected``.

    ``recount`` counts what is stored and decides whenever it is given: rows counted while they
    are written tell nothing about what arrived. Without it, the rows counted during the write
    decide; a stage that ran again after a lost executor may be counted twice there.
    """
    if recount is None:
        seen = Observation()
        write(df.observe(seen, F.count(F.lit(1)).alias("n")))
        written = seen.get["n"]
    else:
        write(df)
        written = recount()
    if written != expected:
        raise RowCountError(f"expected {expected} rows to be written, got {written}")
    return written


def generate_if_missing(
    spark: SparkSession, spec: TableSpec, path: str, seed: int = 0, parts: int | None = None
) -> None:
    """Generate the text file of a table spec unless a finished one is there.

    Only a directory with the marker of a committed write counts; what a broken run left is
    written anew.
    """
    if not write_finished(spark, path):
        write_delimited(gen_from_spec(spark, spec, seed, parts), path, TEXT_SEP, mode="overwrite")


def write_finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to this directory was committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def copy_table(spark: SparkSession, spec: TableSpec, location: str | None = None) -> str:
    """Create the empty ``_copy`` twin of a table and return its name."""
    twin = spec.renamed(spec.name + COPY_SUFFIX)
    create_table(spark, twin, location)
    return twin.qualified


def text_to_text(
    spark: SparkSession, spec: TableSpec, source: str, target: str, mode: str = "errorifexists"
) -> None:
    rows = read_delimited(spark, source, spec.struct, TEXT_SEP)
    _checked(spec, rows, *_text_sink(spark, target, mode))


def text_to_catalog(spark: SparkSession, spec: TableSpec, source: str) -> None:
    rows = read_delimited(spark, source, spec.struct, TEXT_SEP)
    _checked(spec, rows, *_table_sink(spark, spec.qualified))


def catalog_to_text(
    spark: SparkSession, spec: TableSpec, target: str, mode: str = "errorifexists"
) -> None:
    rows = load_catalog(spark, spec.qualified)
    _checked(spec, rows, *_text_sink(spark, target, mode))


def catalog_to_catalog(spark: SparkSession, spec: TableSpec) -> None:
    """Copy a table into its ``_copy`` twin, which must exist."""
    rows = load_catalog(spark, spec.qualified)
    _checked(spec, rows, *_table_sink(spark, spec.qualified + COPY_SUFFIX))


Sink = tuple[Callable[[DataFrame], None], Callable[[], int], bool]


def _text_sink(spark: SparkSession, target: str, mode: str) -> Sink:
    """How to write text, how to count what is stored there, and whether rows are appended."""
    return (
        lambda df: write_delimited(df, target, mode=mode),
        lambda: spark.read.text(target).count(),
        mode == "append" and write_finished(spark, target),
    )


def _table_sink(spark: SparkSession, name: str) -> Sink:
    return lambda df: store_catalog(df, name), lambda: load_catalog(spark, name).count(), True


def _checked(
    spec: TableSpec,
    rows: DataFrame,
    write: Callable[[DataFrame], None],
    stored: Callable[[], int],
    appends: bool,
) -> None:
    """Run a write; if the spec says how many rows its table has, that many must arrive.

    What is stored is counted, before and after the write where rows are appended.
    """
    if spec.rows:
        before = stored() if appends else 0
        check_row_count(rows, spec.rows, write, recount=lambda: stored() - before)
    else:
        write(rows)


def set_up(
    spark: SparkSession, spec: TableSpec, root: str, seed: int = 0, parts: int | None = None
) -> str:
    """Table, copy twin and text data of a spec; returns the text directory."""
    create_table(spark, spec)
    copy_table(spark, spec)
    data = f"{root}/data/{spec.name}"
    generate_if_missing(spark, spec, data, seed, parts)
    return data


def clean_up(spark: SparkSession, spec: TableSpec) -> None:
    """Drop the table and its copy twin."""
    drop_table(spark, spec.qualified)
    drop_table(spark, spec.qualified + COPY_SUFFIX)
