"""The seventeen page-view queries on DataFrames of the schemas in :mod:`viewlog.schema`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlog.functions.scalars import bincond, map_lookup
from viewlog.operators import aggregates, bitmaps, joins, ordering, sets, shaping
from viewlog.operators.exact_sum import exact_sum
from viewlog.schema import NOON_SECOND


def flattened_headers(page_views: DataFrame) -> DataFrame:
    """(user, header) for every page link; the header comes from page_info or the link."""
    rows = shaping.flatten_bag(
        page_views.select("user", "action", "page_info", "page_links"), "page_links"
    )
    header = bincond(
        F.col("action") == 1,
        map_lookup(F.col("page_info"), "a"),
        map_lookup(F.col("page_links"), "b"),
    )
    return rows.select("user", header.alias("header"))


def l1_links_per_user(page_views: DataFrame) -> DataFrame:
    """Flattened page links per user.

    Only the number of flattened rows is stored, so bag sizes are added up and neither the
    rows nor their headers are made. A user with empty bags only has no row; the null
    user's group counts 0, because its first field is null.
    """
    rows = page_views.groupBy("user").agg(
        F.sum(shaping.flattened_rows(F.col("page_links"))).alias("rows")
    )
    count = F.when(F.col("user").isNull(), F.lit(0)).otherwise(F.col("rows")).cast("bigint")
    return rows.filter("rows > 0").select("user", count.alias("cnt"))


def visit_hash() -> Column:
    """Tells the rows of one user apart; parts of a hot user are dealt by it."""
    return F.xxhash64("ip_addr", "timestamp", "query_term", "timespent", "estimated_revenue")


def l2_power_user_views(page_views: DataFrame, power_users: DataFrame) -> DataFrame:
    joined = joins.join_replicated(
        page_views, power_users.select("name"), "user", "name", spread_by=visit_hash()
    )
    return joined.select("user", "estimated_revenue")


def l3_revenue_per_known_user(page_views: DataFrame, users: DataFrame) -> DataFrame:
    return joins.join_then_sum(page_views, users, "user", "name", "estimated_revenue", "revenue")


def l4_actions_per_user(page_views: DataFrame) -> DataFrame:
    return aggregates.count_distinct(page_views, "user", "action", "n_actions")


def l5_unknown_users(page_views: DataFrame, users: DataFrame) -> DataFrame:
    return joins.anti_join(page_views, users, "user", "name")


def l6_timespent_per_visit_key(page_views: DataFrame) -> DataFrame:
    return page_views.groupBy("user", "query_term", "ip_addr", "timestamp").agg(
        F.sum("timespent").alias("timespent")
    )


def l7_views_by_half_day(page_views: DataFrame) -> DataFrame:
    user, second = F.col("user"), F.col("timestamp")
    return page_views.groupBy("user").agg(
        aggregates.conditional_count(second < NOON_SECOND, user).alias("morning"),
        aggregates.conditional_count(second >= NOON_SECOND, user).alias("afternoon"),
    )


def l8_totals(page_views: DataFrame) -> DataFrame:
    return page_views.agg(
        F.sum("timespent").alias("timespent"), F.avg("estimated_revenue").alias("mean_revenue")
    )


def l9_order_by_term(page_views: DataFrame, tie: Column | None = None) -> DataFrame:
    return ordering.order_total(page_views, F.col("query_term").asc_nulls_first(), tie=tie)


def l10_order_by_three(page_views: DataFrame, tie: Column | None = None) -> DataFrame:
    return ordering.order_total(
        page_views,
        F.col("query_term").asc_nulls_first(),
        F.col("estimated_revenue").desc_nulls_last(),
        F.col("timespent").asc_nulls_first(),
        tie=tie,
    )


def l11_all_users(page_views: DataFrame, wide_rows: DataFrame) -> DataFrame:
    return sets.union_distinct(
        page_views.select(F.col("user").alias("name")),
        shaping.project_positional(wide_rows, 0).toDF("name"),
    )


def l12_branches() -> dict[str, Column]:
    """User and term known; user unknown; user known but term unknown."""
    user, term = F.col("user"), F.col("query_term")
    return {
        "highest_value_page_per_user": user.isNotNull() & term.isNotNull(),
        "total_timespent_per_term": user.isNull(),
        "queries_per_action": user.isNotNull() & term.isNull(),
    }


def l12a_highest_value(page_views: DataFrame) -> DataFrame:
    branch = shaping.split(page_views, l12_branches())["highest_value_page_per_user"]
    return branch.groupBy("user").agg(F.max("estimated_revenue").alias("highest_value"))


def l12b_timespent_per_term(page_views: DataFrame) -> DataFrame:
    branch = shaping.split(page_views, l12_branches())["total_timespent_per_term"]
    return branch.groupBy("query_term").agg(F.sum("timespent").alias("timespent"))


def l12c_queries_per_action(page_views: DataFrame) -> DataFrame:
    branch = shaping.split(page_views, l12_branches())["queries_per_action"]
    return branch.groupBy("action").agg(aggregates.count_bag("user").alias("n_queries"))


def l12_three_outputs(page_views: DataFrame) -> DataFrame:
    """All three outputs, told apart by ``branch``: one scan and one shuffle for all."""
    branches = l12_branches()
    return aggregates.tagged_aggregate(
        page_views,
        {
            "highest_value_page_per_user": (
                branches["highest_value_page_per_user"],
                F.col("user"),
                F.max("estimated_revenue"),
            ),
            "total_timespent_per_term": (
                branches["total_timespent_per_term"],
                F.col("query_term"),
                F.sum("timespent"),
            ),
            "queries_per_action": (
                branches["queries_per_action"],
                F.col("action"),
                aggregates.count_bag("user"),
            ),
        },
        key="group",
        exclusive=True,
    )


def l13_views_with_power_user(page_views: DataFrame, power_user_samples: DataFrame) -> DataFrame:
    named = power_user_samples.select("name", "phone")
    joined = joins.join_left_outer(page_views, named, "user", "name", spread_by=visit_hash())
    return joined.select("user", "estimated_revenue", "name", "phone")


def l14_merge_join(page_views: DataFrame, users: DataFrame) -> DataFrame:
    joined = joins.join_merge(
        page_views, users.select("name"), "user", "name", spread_by=visit_hash()
    )
    return joined.select("user", "estimated_revenue", "name")


def l15_distinct_values_per_user(page_views: DataFrame) -> DataFrame:
    return page_views.groupBy("user").agg(
        F.count_distinct("action").alias("n_actions"),
        F.sum_distinct("estimated_revenue").alias("revenue"),
        aggregates.int_mean_distinct(F.col("timespent")).alias("mean_timespent"),
    )


def store_daily_bitmaps(page_views: DataFrame, path: str) -> None:
    """The distinct actions and times of each user and ``day``, for L4 and L15 over any days."""
    rows = page_views.select("user", "action", "timespent", "day")
    bitmaps.append_bitmaps(rows, path, ["user"], ["action", "timespent"], F.col("day"))


def l4_from_bitmaps(spark: SparkSession, path: str, days: Column | None = None) -> DataFrame:
    return bitmaps.stored_counts(spark, path, ["user"], {"action": "n_actions"}, days)


def l15_counts_from_bitmaps(spark: SparkSession, path: str, days: Column | None = None) -> DataFrame:
    """The counts of integer values of L15; its sums of distinct values need the values."""
    names = {"action": "n_actions", "timespent": "n_timespent"}
    return bitmaps.stored_counts(spark, path, ["user"], names, days)


def l16_exact_revenue(page_views: DataFrame) -> DataFrame:
    """Revenue per user as the exact sum rounded once: the same bits for any order and partitioning."""
    return exact_sum(page_views, ["user"], "estimated_revenue", "revenue")


def l16_revenue_per_user(page_views: DataFrame) -> DataFrame:
    """Revenue per user. A sum does not depend on the order asked for, so nothing is sorted."""
    return page_views.groupBy("user").agg(F.sum("estimated_revenue").alias("revenue"))


WIDE_KEYS = (
    "user",
    "action",
    "timespent",
    "query_term",
    "ip_addr",
    "timestamp",
    "estimated_revenue",
)


def l17_wide_groups(wide_group_by_data: DataFrame) -> DataFrame:
    """Groups over a 21-column key; sums and means without the key."""
    suffixes = ("", "_1", "_2")
    keys = [f"{k}{s}" for s in suffixes for k in WIDE_KEYS]
    sums = [F.sum(f"timespent{s}").alias(f"sum_timespent{s}") for s in suffixes]
    means = [F.avg(f"estimated_revenue{s}").alias(f"mean_revenue{s}") for s in suffixes]
    grouped = wide_group_by_data.groupBy(*keys).agg(*sums, *means)
    return grouped.select(
        *[f"sum_timespent{s}" for s in suffixes], *[f"mean_revenue{s}" for s in suffixes]
    )
