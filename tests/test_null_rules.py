"""Rules the given tables do not show, on rows small enough to work out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from viewlog.functions import scalars
from viewlog.operators import aggregates, joins, ordering, sets, shaping
from viewlog.plans import page_views as plans
from viewlog.schema import PAGE_VIEWS


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def page_views(spark, *records):
    """Page views from partial records; what is not given is null."""
    full = [tuple(r.get(n) for n in PAGE_VIEWS.names) for r in records]
    return spark.createDataFrame(full, PAGE_VIEWS)


def test_count_skips_rows_with_null_first_field(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    counted = df.groupBy("k").agg(aggregates.count_bag("k").alias("n"))
    assert rows(counted) == [(None, 0), ("a", 1)]


def test_flatten_keeps_null_bag_and_drops_empty_one(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "id int, bag array<string>")
    assert rows(shaping.flatten_bag(df, "bag")) == [(1, "x"), (1, "y"), (3, None)]
    counted = df.select("id", shaping.flattened_rows(F.col("bag")).alias("n"))
    assert rows(counted) == [(1, 2), (2, 0), (3, 1)]


def test_flattened_count_equals_flattening(spark):
    link = {"a": "1", "b": "2"}
    pv = page_views(
        spark,
        {"user": "a", "action": 1, "page_links": [link, link]},
        {"user": "a", "action": 2, "page_links": None},
        {"user": "b", "action": 2, "page_links": []},
        {"user": None, "action": 1, "page_links": [link]},
    )
    flat = plans.flattened_headers(pv).groupBy("user").agg(F.count("user").alias("cnt"))
    assert rows(plans.l1_links_per_user(pv)) == rows(flat) == [(None, 0), ("a", 3)]


def test_header_choice(spark):
    pv = page_views(
        spark,
        {"user": "u", "action": 1, "page_info": {"a": "info"}, "page_links": [{"b": "link"}]},
        {"user": "v", "action": 0, "page_info": {"a": "info"}, "page_links": [{"b": "link"}]},
        {"user": "w", "action": None, "page_info": {"a": "info"}, "page_links": [{"b": "link"}]},
        {"user": "x", "action": 0, "page_info": None, "page_links": [{"c": "other"}]},
    )
    assert rows(plans.flattened_headers(pv)) == [
        ("u", "info"),
        ("v", "link"),
        ("w", None),
        ("x", None),
    ]


def test_bad_cast_is_null_and_fraction_is_cut(spark):
    df = spark.createDataFrame([("x", 2.9), ("-3.7", -2.9), ("5", None)], "t string, d double")
    got = df.select(scalars.text_to_int(F.col("t")), scalars.to_int(F.col("d")))
    assert [tuple(r) for r in got.collect()] == [(None, 2), (-3, -2), (5, None)]


def test_null_keys_do_not_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "name string, w int")
    for limit in (2**20, 0):
        inner = joins.join_replicated(left, right, "k", "name", limit=limit)
        assert rows(inner) == [("a", 2, "a", 20)]
        outer = joins.join_replicated(left, right, "k", "name", "left", limit=limit)
        assert rows(outer) == [(None, 1, None, None), ("a", 2, "a", 20)]


def test_semi_join_does_not_multiply(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    right = spark.createDataFrame([("a",), ("a",)], "name string")
    assert rows(joins.semi_join_set(left, right, "k", "name")) == [("a", 1)]
    assert joins.join_replicated(left, right, "k", "name").count() == 2


def test_join_then_sum_counts_repeated_partners(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 9.0)], "k string, v double")
    right = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "name string")
    summed = joins.join_then_sum(left, right, "k", "name", "v", "total")
    plain = left.join(right, left.k == right.name).groupBy("k").agg(F.sum("v"))
    assert rows(summed) == rows(plain) == [("a", 6.0), ("b", None)]


@pytest.mark.parametrize("null_names, expected", [(0, [(None,), ("b",)]), (2, [(None,), (None,), ("b",)])])
def test_anti_join_null_groups(spark, null_names, expected):
    left = spark.createDataFrame([(None,), (None,), ("a",), ("b",), ("b",)], "user string")
    right = spark.createDataFrame([("a",), ("c",)] + [(None,)] * null_names, "name string")
    assert rows(joins.anti_join(left, right, "user", "name")) == expected


def test_cogroup_keeps_null_groups_apart(spark):
    left = spark.createDataFrame([(None,), ("a",)], "l string")
    right = spark.createDataFrame([(None,), ("b",)], "r string")
    one = F.count(F.lit(1))
    got = joins.cogroup(left, right, "l", "r", [one.alias("n")], [one.alias("m")])
    assert rows(got.select("key", "n", "m")) == [
        (None, None, 1),
        (None, 1, None),
        ("a", 1, None),
        ("b", None, 1),
    ]


def test_distinct_aggregates(spark):
    pv = page_views(
        spark,
        *[
            {"user": "u", "action": a, "estimated_revenue": r, "timespent": t}
            for a, r, t in [(1, 1.0, 1), (1, 1.0, 1), (0, 4.0, 4), (None, None, None)]
        ],
    )
    assert rows(plans.l15_distinct_values_per_user(pv)) == [("u", 2, 5.0, 2)]


def test_only_nulls_give_null_aggregates(spark):
    pv = page_views(spark, {"user": "u", "query_term": "q"})
    assert rows(plans.l15_distinct_values_per_user(pv)) == [("u", 0, None, None)]
    assert rows(plans.l6_timespent_per_visit_key(pv)) == [("u", "q", None, None, None)]
    assert rows(plans.l8_totals(pv)) == [(None, None)]


def test_max_of_negatives_and_mean_with_null(spark):
    pv = page_views(
        spark,
        *[{"user": "u", "query_term": "q", "estimated_revenue": r} for r in (-3.0, -1.0)],
    )
    assert rows(plans.l12a_highest_value(pv)) == [("u", -1.0)]
    means = page_views(spark, *[{"estimated_revenue": r} for r in (1.0, None, 3.0)])
    assert rows(plans.l8_totals(means)) == [(None, 2.0)]


def test_three_outputs_equal_their_single_forms(spark):
    pv = page_views(
        spark,
        {"user": "u", "query_term": "q", "estimated_revenue": 2.0},
        {"user": "u", "query_term": None, "action": 1},
        {"user": None, "query_term": "q", "timespent": 3},
        {"user": None, "query_term": None, "timespent": None},
    )
    tagged = plans.l12_three_outputs(pv)

    def branch(name):
        return rows(tagged.filter(F.col("branch") == name).select("group", name))

    assert branch("highest_value_page_per_user") == rows(plans.l12a_highest_value(pv))
    assert branch("total_timespent_per_term") == rows(plans.l12b_timespent_per_term(pv))
    assert branch("total_timespent_per_term") == [(None, None), ("q", 3)]
    assert branch("queries_per_action") == [("1", 1)]


def test_sort_places_nulls(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    up = ordering.order_total(df, F.col("v").asc_nulls_first())
    down = ordering.order_total(df, F.col("v").desc_nulls_last())
    assert [r.v for r in up.collect()] == [None, 1, 2]
    assert [r.v for r in down.collect()] == [2, 1, None]


def test_l10_order(spark):
    records = [
        ("b", 1.0, 1),
        ("a", 1.0, 2),
        ("a", 1.0, None),
        ("a", None, 1),
        ("a", 5.0, 1),
        (None, 0.0, 0),
    ]
    pv = page_views(
        spark,
        *[{"query_term": q, "estimated_revenue": r, "timespent": t} for q, r, t in records],
    )
    got = plans.l10_order_by_three(pv).select("query_term", "estimated_revenue", "timespent")
    assert [tuple(r) for r in got.collect()] == [
        (None, 0.0, 0),
        ("a", 5.0, 1),
        ("a", 1.0, None),
        ("a", 1.0, 2),
        ("a", None, 1),
        ("b", 1.0, 1),
    ]


def test_union_distinct_keeps_null_once(spark):
    a = spark.createDataFrame([(None,), ("x",), ("x",)], "name string")
    b = spark.createDataFrame([(None,), ("y",)], "name string")
    assert rows(sets.union_distinct(a, b)) == [(None,), ("x",), ("y",)]
    assert sets.union_all(a, b).count() == 5


def test_split_may_overlap_and_miss(spark):
    df = spark.range(10)
    parts = shaping.split(df, {"low": F.col("id") < 6, "even": F.col("id") % 2 == 0})
    assert parts["low"].count() == 6
    assert parts["even"].count() == 5


@pytest.mark.parametrize(
    "millis, text",
    [
        (None, "-"),
        (0.0, "0.000s"),
        (0.4, "0.000s"),
        (1.5, "0.002s"),
        (999.0, "0.999s"),
        (61001.0, "1m1.001s"),
        (3600000.0, "1h"),
        (3723456.0, "1h2m3.456s"),
        (90000000.0, "25h"),
    ],
)
def test_duration_text(spark, millis, text):
    df = spark.createDataFrame([(millis,)], "ms double")
    assert df.select(scalars.format_duration(F.col("ms"))).first()[0] == text


def test_names(spark):
    df = spark.createDataFrame([("t_copy", "/d")], "t string, d string")
    got = df.select(
        scalars.original_name(F.col("t")),
        scalars.copy_name(F.col("t")),
        scalars.with_slash(F.col("d")),
        scalars.with_slash(F.concat("d", F.lit("/"))),
    ).first()
    assert tuple(got) == ("t", "t_copy_copy", "/d/", "/d/")
    for bad in (scalars.original_name(F.col("d")), scalars.with_slash(F.lit(""))):
        with pytest.raises(Exception, match="suffix|empty"):
            df.select(bad).collect()


def test_tagged_aggregate_counts_a_row_in_each_branch_it_meets(spark):
    df = spark.range(6)
    branches = {
        "even": (F.col("id") % 2 == 0, F.col("id") % 2, F.count("id")),
        "small": (F.col("id") < 3, F.lit(None).cast("int"), F.sum("id")),
    }
    both = aggregates.tagged_aggregate(df, branches, "k")
    assert sorted(map(tuple, both.collect())) == [("even", "0", 3, None), ("small", None, None, 3)]
    first = aggregates.tagged_aggregate(df, branches, "k", exclusive=True)
    assert sorted(map(tuple, first.collect())) == [("even", "0", 3, None), ("small", None, None, 1)]
