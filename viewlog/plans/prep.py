"""Preparation of the page-view tables: users, power users, samples, sorted and wide copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlog.generate import gen_append, gen_page_views, gen_wide_rows
from viewlog.operators.ordering import sample_by_key, sorted_write, top_k
from viewlog.operators.shaping import widen
from viewlog.schema import (
    PAGE_VIEWS,
    POWER_USER_SAMPLE_PERCENT,
    POWER_USERS,
    USER_DETAIL_SPECS,
)


def distinct_users(page_views: DataFrame) -> DataFrame:
    """Every user of the page views once, the unknown user included."""
    return page_views.select(F.col("user").alias("name")).distinct()


def with_details(names: DataFrame, seed: int) -> DataFrame:
    """Phone, address, city, state and zip for each name, drawn from the name."""
    key = F.xxhash64(F.coalesce("name", F.lit("")))
    return gen_append(names, USER_DETAIL_SPECS, key, seed)


def make_users(page_views: DataFrame, seed: int = 0) -> DataFrame:
    return with_details(distinct_users(page_views), seed)


def make_power_users(page_views: DataFrame, n: int = POWER_USERS, seed: int = 0) -> DataFrame:
    """The first ``n`` users in order of name, with details."""
    first = top_k(distinct_users(page_views), n, F.col("name").asc_nulls_first())
    return with_details(first, seed)


def make_power_user_samples(power_users: DataFrame, seed: int = 0) -> DataFrame:
    key = F.xxhash64(F.coalesce("name", F.lit("")))
    return sample_by_key(power_users, key, POWER_USER_SAMPLE_PERCENT, seed)


def make_wide_group_by_data(page_views: DataFrame) -> DataFrame:
    """The nine page-view columns three times."""
    return widen(page_views.select(*PAGE_VIEWS.names), 3)


def prep_page_view_tables(
    spark: SparkSession, root: str, rows: int, seed: int = 0, parts: int | None = None
) -> dict[str, str]:
    """Generate and store all tables the queries read; returns their paths by name.

    Each table is written once and the next ones are derived from the stored one.
    """
    paths = {
        name: f"{root}/{name}"
        for name in (
            "page_views",
            "users",
            "power_users",
            "power_users_samples",
            "widerow",
            "page_views_sorted",
            "users_sorted",
            "widegroupbydata",
        )
    }

    def store(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("errorifexists").parquet(paths[name])
        return spark.read.parquet(paths[name])

    page_views = store("page_views", gen_page_views(spark, rows, seed, parts))
    users = store("users", make_users(page_views, seed + 1))
    power_users = store("power_users", make_power_users(page_views, seed=seed + 1))
    store("power_users_samples", make_power_user_samples(power_users, seed + 2))
    store("widerow", gen_wide_rows(spark, rows, seed + 3, parts))
    sorted_write(page_views, paths["page_views_sorted"], F.col("user").asc_nulls_first())
    sorted_write(users, paths["users_sorted"], F.col("name").asc_nulls_first())
    store("widegroupbydata", make_wide_group_by_data(page_views))
    return paths
