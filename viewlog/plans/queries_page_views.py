"""The seventeen page-view queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlog.functions.text import encode_bag, encode_map
from viewlog.operators.exact_sum import exact_sum_sql
from viewlog.operators.ordering import read_positions
from viewlog.plans import driver_views as views
from viewlog.plans import page_views as plans
from viewlog.plans.driver_views import (
    FLAT_LINKS_SQL,
    PAGE_VIEWS_SQL,
    POWER_USERS_SQL,
    USERS_SQL,
    WIDE_ROWS_SQL,
)
from viewlog.plans.oracle_sql import HASH_SAMPLE_SQL, INFO_TEXT_SQL, LINKS_TEXT_SQL
from viewlog.plans.prep import make_wide_group_by_data
from viewlog.plans.registry import placed, query, rounded
from viewlog.session import scratch_path


@query(
    "L1",
    'SELECT "user", count("user") AS cnt FROM flat GROUP BY "user"',
    (PAGE_VIEWS_SQL, FLAT_LINKS_SQL),
)
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l1_links_per_user(views.page_views(spark, sf_dir))


@query(
    "L2",
    """SELECT "user", estimated_revenue FROM page_views JOIN power_users ON "user" = name""",
    (PAGE_VIEWS_SQL, POWER_USERS_SQL),
)
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l2_power_user_views(
        views.page_views(spark, sf_dir), views.power_users(spark, sf_dir)
    )


@query(
    "L3",
    """SELECT "user", round(sum(estimated_revenue), 4) AS revenue
    FROM page_views JOIN users ON "user" = name GROUP BY "user" """,
    (PAGE_VIEWS_SQL, USERS_SQL),
)
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = plans.l3_revenue_per_known_user(
        views.page_views(spark, sf_dir), views.users(spark, sf_dir)
    )
    return rounded(result, 4, "revenue")


@query(
    "L4",
    'SELECT "user", count(DISTINCT action) AS n_actions FROM page_views GROUP BY "user"',
    (PAGE_VIEWS_SQL,),
)
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l4_actions_per_user(views.page_views(spark, sf_dir))


@query(
    "L5",
    """SELECT coalesce(v.k, u.k) AS "user"
    FROM (SELECT DISTINCT "user" AS k FROM page_views) v
    FULL JOIN (SELECT name AS k, count(name) AS n FROM users GROUP BY name) u ON v.k = u.k
    WHERE coalesce(u.n, 0) = 0""",
    (PAGE_VIEWS_SQL, USERS_SQL),
)
def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l5_unknown_users(views.page_views(spark, sf_dir), views.users(spark, sf_dir))


@query(
    "L6",
    """SELECT "user", query_term, ip_addr, "timestamp", CAST(sum(timespent) AS BIGINT) AS timespent
    FROM page_views GROUP BY "user", query_term, ip_addr, "timestamp" """,
    (PAGE_VIEWS_SQL,),
)
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l6_timespent_per_visit_key(views.page_views(spark, sf_dir))


@query(
    "L7",
    """SELECT "user", count(CASE WHEN "timestamp" < 43200 THEN "user" END) AS morning,
      count(CASE WHEN "timestamp" >= 43200 THEN "user" END) AS afternoon
    FROM page_views GROUP BY "user" """,
    (PAGE_VIEWS_SQL,),
)
def l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l7_views_by_half_day(views.page_views(spark, sf_dir))


@query(
    "L8",
    """SELECT CAST(sum(timespent) AS BIGINT) AS timespent,
      round(avg(estimated_revenue), 6) AS mean_revenue FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plans.l8_totals(views.page_views(spark, sf_dir)), 6, "mean_revenue")


def stored(page_views: DataFrame) -> DataFrame:
    """Maps and bags as the text a file would hold; applied last, after rows were moved."""
    return page_views.withColumns(
        {
            "page_info": encode_map(F.col("page_info")),
            "page_links": encode_bag(F.col("page_links")),
        }
    )


def whole_rows(order: str) -> str:
    """Whole rows, each with the place at which the rows of its key begin in the order."""
    return f"""SELECT "user", action, timespent, query_term, ip_addr, "timestamp",
    estimated_revenue, {INFO_TEXT_SQL} AS page_info, {LINKS_TEXT_SQL} AS page_links, event_id,
    rank() OVER (ORDER BY {order}) AS place
  FROM page_views"""


def in_files(ordered: DataFrame, *keys: str) -> DataFrame:
    """An order as it is stored: read back by position, with the place of each row's key."""
    spark, path = ordered.sparkSession, scratch_path(ordered.sparkSession, "ordered-views")
    stored(ordered).write.parquet(path)
    return placed(read_positions(spark, path), *keys)


@query(
    "L9",
    whole_rows("query_term NULLS FIRST"),
    (PAGE_VIEWS_SQL,),
)
def l9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = plans.l9_order_by_term(views.page_views(spark, sf_dir), tie=F.col("event_id"))
    return in_files(ordered, "query_term")


@query(
    "L10",
    whole_rows("query_term NULLS FIRST, estimated_revenue DESC NULLS LAST, timespent NULLS FIRST"),
    (PAGE_VIEWS_SQL,),
)
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = plans.l10_order_by_three(views.page_views(spark, sf_dir), tie=F.col("event_id"))
    return in_files(ordered, "query_term", "estimated_revenue", "timespent")


@query(
    "L11",
    'SELECT "user" AS name FROM page_views UNION SELECT name FROM wide_rows',
    (PAGE_VIEWS_SQL, WIDE_ROWS_SQL),
)
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l11_all_users(views.page_views(spark, sf_dir), views.wide_rows(spark, sf_dir))


@query(
    "L12",
    """SELECT 'highest_value_page_per_user' AS branch, "user" AS "group",
      max(estimated_revenue) AS highest_value_page_per_user,
      CAST(NULL AS BIGINT) AS total_timespent_per_term, CAST(NULL AS BIGINT) AS queries_per_action
    FROM page_views WHERE "user" IS NOT NULL AND query_term IS NOT NULL GROUP BY "user"
    UNION ALL
    SELECT 'total_timespent_per_term', query_term, NULL, CAST(sum(timespent) AS BIGINT), NULL
    FROM page_views WHERE "user" IS NULL GROUP BY query_term
    UNION ALL
    SELECT 'queries_per_action', CAST(action AS VARCHAR), NULL, NULL, count(*)
    FROM page_views WHERE "user" IS NOT NULL AND query_term IS NULL GROUP BY action""",
    (PAGE_VIEWS_SQL,),
)
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l12_three_outputs(views.page_views(spark, sf_dir))


@query(
    "L12a",
    """SELECT "user", max(estimated_revenue) AS highest_value FROM page_views
    WHERE "user" IS NOT NULL AND query_term IS NOT NULL GROUP BY "user" """,
    (PAGE_VIEWS_SQL,),
)
def l12a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l12a_highest_value(views.page_views(spark, sf_dir))


@query(
    "L12b",
    """SELECT query_term, CAST(sum(timespent) AS BIGINT) AS timespent FROM page_views
    WHERE "user" IS NULL GROUP BY query_term""",
    (PAGE_VIEWS_SQL,),
)
def l12b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l12b_timespent_per_term(views.page_views(spark, sf_dir))


@query(
    "L12c",
    """SELECT action, count(*) AS n_queries FROM page_views
    WHERE "user" IS NOT NULL AND query_term IS NULL GROUP BY action""",
    (PAGE_VIEWS_SQL,),
)
def l12c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l12c_queries_per_action(views.page_views(spark, sf_dir))


@query(
    "L13",
    f"""SELECT "user", estimated_revenue, name, phone FROM page_views
    LEFT JOIN (SELECT name, phone FROM power_users WHERE {HASH_SAMPLE_SQL}) s ON "user" = name""",
    (PAGE_VIEWS_SQL, POWER_USERS_SQL),
)
def l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l13_views_with_power_user(
        views.page_views(spark, sf_dir), views.power_user_samples(spark, sf_dir)
    )


@query(
    "L14",
    'SELECT "user", estimated_revenue, name FROM page_views JOIN users ON "user" = name',
    (PAGE_VIEWS_SQL, USERS_SQL),
)
def l14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l14_merge_join(views.page_views(spark, sf_dir), views.users(spark, sf_dir))


@query(
    "L15",
    """SELECT "user", count(DISTINCT action) AS n_actions,
      round(sum(DISTINCT estimated_revenue), 4) AS revenue,
      CAST(trunc(avg(DISTINCT timespent)) AS INTEGER) AS mean_timespent
    FROM page_views GROUP BY "user" """,
    (PAGE_VIEWS_SQL,),
)
def l15(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = plans.l15_distinct_values_per_user(views.page_views(spark, sf_dir))
    return rounded(result, 4, "revenue")


@query(
    "L16",
    'SELECT "user", round(sum(estimated_revenue), 4) AS revenue FROM page_views GROUP BY "user"',
    (PAGE_VIEWS_SQL,),
)
def l16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plans.l16_revenue_per_user(views.page_views(spark, sf_dir)), 4, "revenue")


@query(
    "L16_exact",
    f'SELECT "user", {exact_sum_sql("estimated_revenue")} AS revenue FROM page_views GROUP BY "user"',
    (PAGE_VIEWS_SQL,),
)
def l16_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compared to the last bit, without rounding."""
    return plans.l16_exact_revenue(views.page_views(spark, sf_dir))


def daily_bitmaps(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "daily-bitmaps")
    plans.store_daily_bitmaps(views.dated_page_views(spark, sf_dir), path)
    return path


@query(
    "L4_bitmaps",
    'SELECT "user", count(DISTINCT action) AS n_actions FROM page_views GROUP BY "user"',
    (PAGE_VIEWS_SQL,),
)
def l4_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l4_from_bitmaps(spark, daily_bitmaps(spark, sf_dir))


@query(
    "L15_bitmaps",
    """SELECT "user", count(DISTINCT action) AS n_actions, count(DISTINCT timespent) AS n_timespent
    FROM page_views GROUP BY "user" """,
    (PAGE_VIEWS_SQL,),
)
def l15_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.l15_counts_from_bitmaps(spark, daily_bitmaps(spark, sf_dir))


@query(
    "L17",
    """SELECT CAST(sum(timespent) AS BIGINT) AS sum_timespent,
      CAST(sum(timespent) AS BIGINT) AS sum_timespent_1,
      CAST(sum(timespent) AS BIGINT) AS sum_timespent_2,
      round(avg(estimated_revenue), 4) AS mean_revenue,
      round(avg(estimated_revenue), 4) AS mean_revenue_1,
      round(avg(estimated_revenue), 4) AS mean_revenue_2
    FROM page_views
    GROUP BY "user", action, timespent, query_term, ip_addr, "timestamp", estimated_revenue""",
    (PAGE_VIEWS_SQL,),
)
def l17(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = make_wide_group_by_data(views.page_views(spark, sf_dir))
    result = plans.l17_wide_groups(wide)
    return rounded(result, 4, "mean_revenue", "mean_revenue_1", "mean_revenue_2")
