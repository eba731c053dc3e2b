"""The seventeen queries as jobs: from the prepared tables to stored text, timed."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlog.functions.text import encode_bag, encode_map
from viewlog.plans import page_views as q
from viewlog.sources.delimited import write_delimited
from viewlog.sources.routing import route_write

RUN_SCHEMA = "query string, engine string, seconds bigint"

Tables = Mapping[str, DataFrame]

JOBS: dict[str, Callable[[Tables], DataFrame]] = {
    "L1": lambda t: q.l1_links_per_user(t["page_views"]),
    "L2": lambda t: q.l2_power_user_views(t["page_views"], t["power_users"]),
    "L3": lambda t: q.l3_revenue_per_known_user(t["page_views"], t["users"]),
    "L4": lambda t: q.l4_actions_per_user(t["page_views"]),
    "L5": lambda t: q.l5_unknown_users(t["page_views"], t["users"]),
    "L6": lambda t: q.l6_timespent_per_visit_key(t["page_views"]),
    "L7": lambda t: q.l7_views_by_half_day(t["page_views"]),
    "L8": lambda t: q.l8_totals(t["page_views"]),
    "L9": lambda t: q.l9_order_by_term(t["page_views"]),
    "L10": lambda t: q.l10_order_by_three(t["page_views"]),
    "L11": lambda t: q.l11_all_users(t["page_views"], t["widerow"]),
    "L12": lambda t: q.l12_three_outputs(t["page_views"]),
    "L13": lambda t: q.l13_views_with_power_user(t["page_views"], t["power_users_samples"]),
    "L14": lambda t: q.l14_merge_join(t["page_views_sorted"], t["users_sorted"]),
    "L15": lambda t: q.l15_distinct_values_per_user(t["page_views"]),
    "L16": lambda t: q.l16_revenue_per_user(t["page_views"]),
    "L17": lambda t: q.l17_wide_groups(t["widegroupbydata"]),
}


def load_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables that :func:`viewlog.plans.prep.prep_page_view_tables` stored."""
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def run_job(name: str, tables: Tables, output: str) -> None:
    """Run one query and store its rows as tabbed text in ``<output>/<name>out``, replacing it.

    The three outputs of L12 go to a directory each.
    """
    result, path = JOBS[name](tables), f"{output}/{name}out"
    if name == "L12":
        routes = {
            f"{path}/{branch}": (F.col("branch") == branch, ["group", branch])
            for branch in q.l12_branches()
        }
        route_write(result, routes, mode="overwrite")
        return
    nested = {"page_info": encode_map, "page_links": encode_bag}
    printed = {c: f(F.col(c)) for c, f in nested.items() if c in result.columns}
    write_delimited(result.withColumns(printed), path, mode="overwrite")


def time_jobs(
    spark: SparkSession,
    tables: Tables,
    output: str,
    names: list[str] | None = None,
    runs: int = 1,
    engine: str = "spark",
) -> DataFrame:
    """Run jobs several times; rows (query, engine, seconds) for the speedup report."""
    timings = []
    for name in names or list(JOBS):
        for _ in range(runs):
            start = time.perf_counter()
            run_job(name, tables, output)
            timings.append((name, engine, int(time.perf_counter() - start)))
    return spark.createDataFrame(timings, RUN_SCHEMA)
