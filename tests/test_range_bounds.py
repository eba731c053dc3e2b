"""Orders by stored bounds: the order of the keys, in even ranges, from one read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from viewlog.operators import range_bounds as rb
from viewlog.session import scratch_path

PARTS = 12


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    long_name = F.concat(F.lit("a common beginning of "), F.lpad((n % 997).cast("string"), 4, "0"))
    name = (
        F.when(n % 3 == 0, "a hot key of twenty b")
        .when(n % 11 == 1, None)
        .when(n % 5 == 0, long_name)
        .when(n % 7 == 0, F.concat(F.lit("é"), (n % 50).cast("string")))
        .otherwise(F.concat(F.lit("u"), (n % 1999).cast("string")))
    )
    df = spark.range(40_000).select(name.alias("name"), (n % 13 - 6).cast("int").alias("k"), n.alias("id"))
    path = scratch_path(spark, "bounded")
    df.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("keys", [("name",), ("name", "k"), ("k",), ("id",)])
def test_order_and_ranges(spark, rows, keys):
    path = scratch_path(spark, "bounds")
    rb.store_bounds(spark, rb.measure_bounds(rows, PARTS, *keys), path)
    ordered = rb.order_by_bounds(rows, rb.load_bounds(spark, path), *keys)
    got = ordered.select(*keys, F.spark_partition_id().alias("p")).collect()
    assert len(got) == 40_000

    def place(row):
        return [(row[k] is not None, row[k].encode() if isinstance(row[k], str) else row[k] or 0) for k in keys]

    assert all(place(a) <= place(b) for a, b in zip(got, got[1:], strict=False))
    sizes = {}
    for row in got:
        sizes[row["p"]] = sizes.get(row["p"], 0) + 1
    assert max(sizes.values()) <= 1.5 * 40_000 / PARTS


def test_empty_input_and_one_read(spark, rows, plan):
    assert rb.measure_bounds(rows.limit(0), PARTS, "name") == []
    assert rb.order_by_bounds(rows.limit(0), [], "name").count() == 0
    text = plan(rb.order_by_bounds(rows, rb.measure_bounds(rows, PARTS, "name"), "name"))
    assert text.count("FileScan") == 1 and "rangepartitioning" not in text
