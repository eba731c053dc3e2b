"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlog.session import scratch_path


def _star(edges: DataFrame, forward: Column) -> DataFrame:
    """Link all neighbours chosen by ``forward`` of each node to its smallest neighbour."""
    ways = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = ways.groupBy("u").agg(F.min("v").alias("m"))
    smallest = smallest.select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    linked = ways.join(smallest, F.col("u") == F.col("node")).filter(forward)
    return linked


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (u, v); a component is its smallest node.

    Large-star and small-star steps in turn, until no link changes; every round is stored in
    the shared folder. Nodes of many links are reduced on the map side before the join, and
    the join itself has one row a node on one side.
    """
    spark = edges.sparkSession
    edges = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    state = None
    while True:
        large = _star(edges, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: nodes not above u, and u itself, go to the smallest.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        )
        path = scratch_path(spark, "links")
        small.filter("u <> v").distinct().write.parquet(path)
        edges = spark.read.parquet(path)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
