"""From generated tables to the stored output of all queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from viewlog.plans import jobs, prep, reports
from viewlog.plans import page_views as q
from viewlog.session import scratch_path
from viewlog.sources.delimited import read_delimited, read_lines


@pytest.fixture(scope="module")
def tables(spark):
    root = scratch_path(spark, "test-jobs")
    return jobs.load_tables(spark, prep.prep_page_view_tables(spark, root, 1200, seed=7, parts=3))


def test_all_queries_store_their_rows(spark, tables):
    output = scratch_path(spark, "test-output")
    timings = jobs.time_jobs(spark, tables, output, runs=1)
    assert timings.count() == 17
    for name in jobs.JOBS:
        if name != "L12":
            stored = read_lines(spark, f"{output}/{name}out").count()
            assert stored == jobs.JOBS[name](tables).count() > 0, name
    views = tables["page_views"]
    for branch, single in {
        "highest_value_page_per_user": q.l12a_highest_value(views),
        "total_timespent_per_term": q.l12b_timespent_per_term(views),
        "queries_per_action": q.l12c_queries_per_action(views),
    }.items():
        stored = read_delimited(spark, f"{output}/L12out/{branch}", "k string, v double", "\t")
        expected = single.toDF("k", "v").select(F.col("k").cast("string"), F.col("v").cast("double"))
        assert stored.exceptAll(expected).count() == 0
        assert stored.count() == expected.count()
    report = reports.speedup_report(timings, "spark", "other")
    assert report.count() == 18


def test_relations_between_results(tables):
    views, users = tables["page_views"], tables["users"]
    # All users are known, so only the null groups of both sides are left.
    assert [r["user"] for r in q.l5_unknown_users(views, users).collect()] == [None, None]
    known = views.filter("user is not null").count()
    assert q.l14_merge_join(tables["page_views_sorted"], tables["users_sorted"]).count() == known
    assert q.l13_views_with_power_user(views, tables["power_users_samples"]).count() == 1200
    by_half = q.l7_views_by_half_day(views).agg(F.sum("morning") + F.sum("afternoon")).first()[0]
    assert by_half == known
    l3 = {r["user"]: r["revenue"] for r in q.l3_revenue_per_known_user(views, users).collect()}
    l16 = {r["user"]: r["revenue"] for r in q.l16_revenue_per_user(views).collect()}
    l16.pop(None)
    assert l3 == pytest.approx(l16)
    assert q.l17_wide_groups(tables["widegroupbydata"]).count() <= 1200


def test_a_job_replaces_its_old_output(spark, tables):
    output = scratch_path(spark, "test-replace")
    for _ in range(2):
        jobs.run_job("L4", tables, output)
        jobs.run_job("L12", tables, output)
    assert read_lines(spark, f"{output}/L4out").count() == q.l4_actions_per_user(tables["page_views"]).count()
