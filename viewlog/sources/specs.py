"""Table specifications from XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from viewlog.schema import DISTRIBUTION_LETTERS, TYPE_LETTERS, ColSpec, TableSpec

COLUMN = (
    "name string, type string, avgLength string, distribution string,"
    " cardinality string, percentageNull string"
)
SPEC_SCHEMA = (
    "namePrefix string, dbName string,"
    f" columns struct<column:array<struct<{COLUMN.replace(' string', ':string')}>>,"
    f" partition:array<struct<{COLUMN.replace(' string', ':string')}>>>,"
    f" partitions struct<partition:array<struct<{COLUMN.replace(' string', ':string')}>>>,"
    " instances struct<instance:array<struct<size:string, count:string>>>"
)


def read_spec_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``<table>`` element of the spec files, numbered as they come."""
    rows = spark.read.format("xml").option("rowTag", "table").schema(SPEC_SCHEMA).load(path)
    return rows.withColumn("position", F.monotonically_increasing_id())


def expand_instances(specs: DataFrame) -> DataFrame:
    """One row per table to build: ``<prefix>_<size>_<i>`` for each i below an instance's count."""
    sized = specs.select("*", F.posexplode("instances.instance").alias("nth", "instance")).select(
        "*",
        F.col("instance.size").cast("bigint").alias("rows"),
        F.col("instance.count").cast("int").alias("copies"),
    )
    numbered = sized.filter("copies > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("number")
    )
    name = F.concat_ws("_", F.trim("namePrefix"), F.col("rows"), F.col("number"))
    return numbered.withColumn("name", name).drop("instance", "copies", "instances")


def spec_columns(tables: DataFrame) -> DataFrame:
    """One row per column of each table of :func:`expand_instances`, typed, partition keys last.

    ``problem`` says which rule of a table spec a column breaks; it is null where all are kept.
    A table without columns has one row, without a column name.
    """
    part = "columns.partition"
    misplaced = F.when(F.size(part) > 0, F.array_join(F.transform(part, lambda p: p["name"]), ", "))
    elements = F.concat(
        F.transform(F.col("columns.column"), lambda c: F.struct(c.alias("c"), F.lit(False).alias("key"))),
        F.coalesce(
            F.transform(F.col("partitions.partition"), lambda c: F.struct(c.alias("c"), F.lit(True).alias("key"))),
            F.array(),
        ),
    )
    rows = tables.select(
        "position", "nth", "number", "name", F.trim("dbName").alias("database"), "rows",
        misplaced.alias("misplaced"), F.posexplode_outer(elements).alias("at", "e"),
    )
    column, is_key = F.col("e.c"), F.col("e.key")
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_LETTERS.items() for x in pair])
    words = F.array(*[F.lit(w) for w in TYPE_LETTERS.values()])
    word = F.lower(column["type"])
    laws = F.create_map(*[F.lit(x) for pair in DISTRIBUTION_LETTERS.items() for x in pair])
    law = column["distribution"]
    typed = rows.select(
        "position", "nth", "number", "name", "database", "rows", "misplaced", "at",
        column["name"].alias("column_name"),
        is_key.alias("is_partition"),
        F.coalesce(kinds[column["type"]], F.when(F.array_contains(words, word), word)).alias("dtype"),
        column["avgLength"].cast("int").alias("avg_length"),
        column["cardinality"].cast("bigint").alias("cardinality"),
        F.coalesce(laws[law], F.when(law.isin(*DISTRIBUTION_LETTERS.values()), law)).alias("distribution"),
        column["percentageNull"].cast("int").alias("percent_null"),
        column["type"].alias("given_type"),
        law.alias("given_law"),
    )
    broken = {
        "table %s has no columns": ("column_name IS NULL", "name"),
        "partition keys [%s] stand inside <columns>": ("misplaced IS NOT NULL", "misplaced"),
        "unknown data type [%s]": ("dtype IS NULL", "given_type"),
        "unknown distribution [%s]": ("distribution IS NULL", "given_law"),
        "string column %s needs avgLength": ("dtype = 'string' AND avg_length IS NULL", "column_name"),
        "partition key %s cannot have percentageNull": ("is_partition AND percent_null IS NOT NULL", "column_name"),
        "column %s needs percentageNull": ("NOT is_partition AND percent_null IS NULL", "column_name"),
        "column %s needs a cardinality": ("cardinality IS NULL", "column_name"),
    }
    problem = F.coalesce(
        *[F.when(F.expr(rule), F.format_string(text, F.col(about))) for text, (rule, about) in broken.items()]
    )
    return typed.withColumn("problem", problem).drop("misplaced", "given_type", "given_law")


def read_table_specs(spark: SparkSession, path: str) -> list[TableSpec]:
    """The tables a spec file asks for, in the order of the file.

    A spec file is a handful of table descriptions, so its rows come to the driver.
    """
    rows = spec_columns(expand_instances(read_spec_rows(spark, path)))
    tables: dict[tuple[int, int, int], list[Row]] = {}
    for row in rows.orderBy("position", "nth", "number", "at").collect():
        if row["problem"]:
            raise ValueError(f"table {row['name']}: {row['problem']}")
        tables.setdefault((row["position"], row["nth"], row["number"]), []).append(row)
    return [_table(columns) for columns in tables.values()]


def _table(columns: list[Row]) -> TableSpec:
    first = columns[0]
    specs = [(c["is_partition"], (c["column_name"], _column(c))) for c in columns]
    return TableSpec(
        name=first["name"],
        database=first["database"],
        columns=tuple(spec for is_key, spec in specs if not is_key),
        partitions=tuple(spec for is_key, spec in specs if is_key),
        rows=first["rows"],
    )


def _column(row: Row) -> ColSpec:
    return ColSpec(
        dtype=row["dtype"],
        avg_length=row["avg_length"] or 0,
        cardinality=row["cardinality"],
        distribution=row["distribution"],
        percent_null=row["percent_null"] or 0,
    )
