"""The given tables seen as page-view data: once as DataFrames, once as SQL for the checks.

Every view keeps all rows of its table. Null shares come from row numbers, so that both
engines see the same nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlog.operators.ordering import sample_by_key
from viewlog.schema import POWER_USER_SAMPLE_PERCENT
from viewlog.streaming.intervals import utc_instant

SAMPLE_SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def _name(number: Column) -> Column:
    return F.concat(F.lit("u"), number.cast("string"))


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page views, with event_id as an extra last column."""
    return views_of(table(spark, sf_dir, "events"))


def views_of(e: DataFrame, *more: Column) -> DataFrame:
    """Page views of some events; ``more`` columns of the events come last."""
    n = e["event_id"]
    link_count = F.when(n % 5 == 1, None).when(n % 10 == 3, 0).otherwise(5 + n % 5).cast("int")
    info = F.when(n % 9 == 0, F.create_map(F.lit("c"), e["event_type"])).otherwise(
        F.create_map(
            F.lit("a"), F.concat(F.lit("p"), (n % 7).cast("string")), F.lit("c"), e["event_type"]
        )
    )
    links = [
        F.create_map(
            F.lit("a"),
            F.lit(f"x{i}"),
            F.lit("b"),
            F.concat(F.lit("l"), ((n + i) % 13).cast("string")),
        )
        for i in range(1, 10)
    ]
    return e.select(
        _unless(n % 14 == 0, _name(e["user_id"])).alias("user"),
        F.when(e["event_type"].isin("click", "purchase"), 1).otherwise(0).alias("action"),
        _unless(n % 11 == 0, (n % 20).cast("int")).alias("timespent"),
        _unless(n % 5 == 0, F.concat(F.lit("q"), (n % 6).cast("string"))).alias("query_term"),
        (n % 2).alias("ip_addr"),
        (F.floor(F.hour("ts") / 6) * 21600).cast("bigint").alias("timestamp"),
        _unless(n % 20 == 0, e["value"]).alias("estimated_revenue"),
        info.alias("page_info"),
        F.slice(F.array(*links), F.lit(1), link_count).alias("page_links"),
        n,
        *more,
    )


PAGE_VIEWS_SQL = """page_views AS (
  SELECT
    CASE WHEN event_id % 14 = 0 THEN NULL ELSE 'u' || CAST(user_id AS VARCHAR) END AS "user",
    CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS action,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 20 AS INTEGER) END AS timespent,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'q' || CAST(event_id % 6 AS VARCHAR) END AS query_term,
    event_id % 2 AS ip_addr,
    CAST(floor(hour(ts) / 6) * 21600 AS BIGINT) AS "timestamp",
    CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS estimated_revenue,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'p' || CAST(event_id % 7 AS VARCHAR) END AS info_a,
    event_type AS info_c,
    CASE WHEN event_id % 5 = 1 THEN NULL WHEN event_id % 10 = 3 THEN 0
         ELSE 5 + event_id % 5 END AS n_links,
    event_id
  FROM events)"""

# One row per flattened link; a null bag keeps its row, an empty one has none.
FLAT_LINKS_SQL = """flat AS (
  SELECT *, CASE WHEN i IS NULL THEN NULL ELSE 'l' || CAST((event_id + i) % 13 AS VARCHAR) END AS link_b
  FROM (SELECT *, unnest(CASE WHEN n_links IS NULL THEN [NULL] ELSE range(1, n_links + 1) END) AS i
        FROM page_views))"""


def dated_page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views with the day of the event, ``day``, taken from the event's own row; events without an id are left out."""
    e = table(spark, sf_dir, "events").filter("event_id IS NOT NULL")
    return views_of(e, F.to_date(e["ts"]).alias("day"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as users; those in debt have no name."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        _unless(s["s_acctbal"] < 0, _name(s["s_suppkey"])).alias("name"),
        s["s_name"].alias("phone"),
        F.concat(F.lit("street "), s["s_suppkey"].cast("string")).alias("address"),
        F.concat(F.lit("city "), s["s_nationkey"].cast("string")).alias("city"),
        F.lit(None).cast("string").alias("state"),
        s["s_nationkey"].alias("zip"),
    )


USERS_SQL = """users AS (
  SELECT CASE WHEN s_acctbal < 0 THEN NULL ELSE 'u' || CAST(s_suppkey AS VARCHAR) END AS name,
    s_name AS phone, s_nationkey AS zip
  FROM supplier)"""


def power_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as power users."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        _name(n["n_nationkey"]).alias("name"), n["n_name"].alias("phone"), n["n_nationkey"]
    )


POWER_USERS_SQL = """power_users AS (
  SELECT 'u' || CAST(n_nationkey AS VARCHAR) AS name, n_name AS phone, n_nationkey FROM nation)"""


def power_user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    everyone = power_users(spark, sf_dir)
    key = F.col("n_nationkey").cast("bigint")
    return sample_by_key(everyone, key, POWER_USER_SAMPLE_PERCENT, SAMPLE_SEED)


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as wide rows."""
    c = table(spark, sf_dir, "customer")
    return c.select(_name(c["c_custkey"]).alias("name"), c["c_nationkey"], c["c_acctbal"])


WIDE_ROWS_SQL = """wide_rows AS (
  SELECT 'u' || CAST(c_custkey AS VARCHAR) AS name FROM customer)"""


def timing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed calls: four tasks run by twenty clients, errors as failed calls."""
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 20).alias("mapper"),
        F.concat(F.lit("task"), (F.col("user_id") % 4).cast("string")).alias("tag"),
        utc_instant(F.col("ts")).alias("start"),
        F.col("value").alias("elapsed_ms"),
        (F.col("event_type") == "error").alias("error"),
        (F.col("event_type") == "signup").alias("joins"),
    )


SAMPLES_SQL = """samples AS (
  SELECT user_id % 20 AS mapper, 'task' || CAST(user_id % 4 AS VARCHAR) AS tag, ts AS start,
    CAST(floor(epoch(ts) / 60) AS BIGINT) AS start_minute,
    value AS elapsed_ms, event_type = 'error' AS error, event_type = 'signup' AS joins
  FROM events)"""
