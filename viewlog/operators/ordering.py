"""Total orders, range partitions, top-k, sampling and sorted storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewlog.functions import draw
from viewlog.operators.joins import row_hash

TIE = "__tie"
# An estimate that asks for more ranges than this is no estimate.
MOST_PARTS = 2_000_000


PART_BYTES = 128 * 1024 * 1024


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Partitions of about ``part_bytes``, from the optimizer's size estimate: no job is run.

    Spark's own number of shuffle partitions is the least; where the plan tells no size (a join
    is taken for a product), it is what is used.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // part_bytes)) if size < MOST_PARTS * part_bytes else least


def order_total(
    df: DataFrame, *order: Column | str, tie: Column | None = None, parts: int | None = None
) -> DataFrame:
    """Total order over the whole table, in ``parts`` ranges (default: by the input's size).

    Nulls come first ascending and last descending. Ranges are cut by the order and then by
    ``tie``, by default a hash of the row: a boundary can fall inside one hot (or null) key,
    which otherwise would go to a single task whole. Inside a range rows are sorted by the
    order alone, so rows with equal keys cost no further comparisons.
    """
    tie = row_hash(df) if tie is None else tie
    order = tuple(F.col(o) if isinstance(o, str) else o for o in order)
    parts = parts_for(df) if parts is None else parts
    ranges = df.withColumn(TIE, tie).repartitionByRange(parts, *order, F.col(TIE))
    return ranges.drop(TIE).sortWithinPartitions(*order)


def range_partition_skewed(df: DataFrame, parts: int, *keys: Column | str) -> DataFrame:
    """Ordered, disjoint key ranges of even size, hot keys and nulls cut like all others."""
    salted = df.withColumn(TIE, row_hash(df))
    keys = tuple(F.col(k) if isinstance(k, str) else k for k in keys)
    return salted.repartitionByRange(parts, *keys, F.col(TIE)).drop(TIE)


def nested_order(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Rows in order inside each group of a key.

    Done as a total order by (key, order): a group is contiguous but may span tasks, so no
    group has to fit one task.
    """
    return order_total(df, F.col(key).asc_nulls_first(), *order)


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows; every task keeps k rows at most."""
    return df.orderBy(*order).limit(k)


def sample(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Bernoulli sample of rows."""
    return df.sample(False, fraction, seed)


def sample_by_key(df: DataFrame, key: Column | str, percent: int, seed: int = 0) -> DataFrame:
    """Bernoulli sample by key hash: the same rows in every run and for any partitioning."""
    key = F.col(key) if isinstance(key, str) else key
    return df.filter(draw.keep_percent(key, percent, seed))


def parallelism(df: DataFrame, n: int) -> DataFrame:
    """Rows dealt evenly over ``n`` tasks (and files, if written next)."""
    return df.repartition(n)


def colocated_scan(df: DataFrame, key: str) -> DataFrame:
    """All rows of a key in one task, next to each other.

    The promise itself puts a hot key into one task; the rows stream through it sorted and
    spill, they are not collected. Use it where the promise is needed, not for plain grouping.
    """
    return df.repartition(key).sortWithinPartitions(key)


def sorted_write(df: DataFrame, path: str, *order: Column | str) -> None:
    """Store a total order: files in range order, each sorted."""
    order_total(df, *order).write.mode("errorifexists").parquet(path)


def read_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """Stored rows with their position over all files, from 1, in the order of the file numbers.

    A row's position is its number in its file and the rows of the files before; that sum runs
    over one small row per file.
    """
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows"))
    number = F.regexp_extract("__file", r"part-(\d+)", 1).cast("bigint")
    before = F.sum("__rows").over(Window.orderBy(number, "__file")) - F.col("__rows")
    files = files.select("__file", before.alias("__before"))
    return rows.join(files, "__file").select(
        *[F.col(f"`{c}`") for c in rows.columns if not c.startswith("__")],
        (F.col("__before") + F.col("__row") + 1).alias(name),
    )


def write_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, path: str, null_keys: bool = True
) -> None:
    """Store a table bucketed and sorted by key, for joins that shuffle neither side.

    All rows of a key share a bucket: that is what the layout promises. Null keys match nothing
    in an inner join; without ``null_keys`` they are left out and fill no bucket.
    """
    rows = df if null_keys else df.filter(F.col(key).isNotNull())
    (
        rows.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .mode("errorifexists")
        .saveAsTable(table)
    )
