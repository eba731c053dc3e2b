"""Shapes of physical plans and the spread of hot keys: what matters once tables are large."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viewlog.operators import joins, ordering, shaping
from viewlog.operators.key_filter import drop_unmatched
from viewlog.operators.table_sizes import known_size
from viewlog.plans import driver_views as views
from viewlog.plans import page_views as plans
from viewlog.plans.driver_views import table
from viewlog.schema import PAGE_VIEWS
from viewlog.session import scratch_path, shared_dir
from viewlog.sources import catalog


def exchanges(text: str) -> int:
    """Shuffles of a plan, broadcasts not counted."""
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|Round|REBAL)", text))


@pytest.fixture(scope="module")
def pv(spark, data):
    return views.page_views(spark, data)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows have one key, a third have none."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("hot")).when(n % 3 == 1, F.concat(F.lit("k"), n % 500))
    return spark.range(0, 30_000, 1, 6).select(n, key.alias("k"))


def partition_sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize(
    "run, columns",
    [
        (plans.l4_actions_per_user, {"event_id", "user_id", "event_type"}),
        (plans.l7_views_by_half_day, {"event_id", "user_id", "ts"}),
        (plans.l16_revenue_per_user, {"event_id", "user_id", "value"}),
    ],
)
def test_scans_read_only_needed_columns(pv, plan, run, columns):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(run(pv))).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == columns


def test_filters_reach_the_scan(spark, data, plan):
    lines = table(spark, data, "lineitem").filter("l_quantity > 40").select("l_orderkey")
    assert "GreaterThan(l_quantity,40" in plan(lines)


def test_replicated_join_shuffles_nothing(spark, data, pv, plan):
    text = plan(plans.l2_power_user_views(pv, views.power_users(spark, data)))
    assert "BroadcastHashJoin" in text
    assert exchanges(text) == 0


def test_side_beyond_the_limit_is_not_broadcast(spark, data, pv, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.join_replicated(pv, views.users(spark, data), "user", "name", limit=10)
        text = plan(joined)
        assert "SortMergeJoin [user" in text
        # Only the bits of the key filter are broadcast, never the side itself.
        assert "BroadcastHashJoin [user" not in text and text.count("BroadcastExchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_measured_size_covers_the_values(spark):
    df = spark.createDataFrame([("x" * 1000,), (None,)], "s string")
    assert 1000 < joins.measured_bytes(df) < 1200
    assert joins.measured_bytes(df.filter("false")) == 0


def test_join_then_sum_shuffles_each_side_once(spark, data, pv, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(plans.l3_revenue_per_known_user(pv, views.users(spark, data)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges(text) == 2
    assert text.count("partial_") >= 2


def test_grouped_sides_meet_without_another_shuffle(spark, data, pv, plan):
    """Keys are reduced before they are compared, and the reduction's shuffle serves the join."""
    people = views.users(spark, data)
    one = F.count(F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unknown = plan(plans.l5_unknown_users(pv, people))
        together = plan(
            joins.cogroup(pv, people, "user", "name", [one.alias("n")], [one.alias("m")])
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges(unknown) == 3  # users of views, users of the table, null groups of the table
    assert "LeftAnti" in unknown
    assert exchanges(together) == 2


@pytest.mark.parametrize(
    "run",
    [
        plans.l1_links_per_user,
        plans.l6_timespent_per_visit_key,
        plans.l7_views_by_half_day,
        plans.l8_totals,
        plans.l12_three_outputs,
        plans.l16_revenue_per_user,
    ],
)
def test_aggregates_reduce_before_their_only_shuffle(pv, plan, run):
    text = plan(run(pv))
    assert exchanges(text) == 1
    assert "partial_" in text.split("Exchange", 1)[1]


def test_union_distinct_has_one_shuffle(spark, data, pv, plan):
    assert exchanges(plan(plans.l11_all_users(pv, views.wide_rows(spark, data)))) == 1


def test_link_count_makes_no_rows(pv, plan):
    assert "Generate" not in plan(plans.l1_links_per_user(pv))
    assert "Generate" in plan(shaping.flatten_bag(pv, "page_links"))


def test_no_python_in_any_query(spark, data, plan):
    from viewlog.plans.all_queries import QUERIES

    for name, run in QUERIES.items():
        assert "Python" not in plan(run(spark, data)), name


def test_merge_join_of_bucketed_tables_shuffles_nothing(spark, data, plan):
    import __spark_entry__ as entry_point

    text = plan(entry_point.queries()["join_merge_bucketed"](spark, data))
    assert "SortMergeJoin" in text
    assert exchanges(text) == 0


def test_hot_and_null_keys_are_cut(spark, hot):
    names = spark.createDataFrame([("hot", 1), ("k1", 2), ("k4", 3), ("none", 4)], "name string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for how in ("inner", "left"):
            plain = hot.join(names, hot["k"] == names["name"], how)
            cut = joins.join_skewed_key(hot, names, "k", "name", how, hot_rows=1000)
            assert cut.columns == plain.columns
            assert cut.exceptAll(plain).count() == 0
            assert cut.count() == plain.count()
            assert max(partition_sizes(cut)) < max(partition_sizes(plain)) / 2
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.enabled", "shuffle.partitions"):
            spark.conf.unset(f"spark.sql.{name}")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_left", [False, True])
def test_keys_hot_on_the_right_are_cut(spark, how, hot_left):
    """The right side has a hot key, and so may the left; rows match as in a plain join."""
    n = 60 if hot_left else 1
    left = spark.range(n).selectExpr("'hot' AS k", "id AS a").union(
        spark.sql("SELECT * FROM VALUES ('k1', 7L), ('none', 8L), (CAST(NULL AS STRING), 9L) AS t(k, a)")
    )
    right = spark.range(2000).selectExpr("IF(id % 10 < 9, 'hot', concat('k', id % 4)) AS name", "id AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        plain = left.join(right, left["k"] == right["name"], how)
        cut = joins.join_skewed_key(left, right, "k", "name", how, hot_rows=50)
        assert cut.columns == plain.columns
        assert cut.count() == plain.count()
        assert cut.exceptAll(plain).count() == 0
        assert max(partition_sizes(cut)) < max(partition_sizes(plain)) / 2
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.enabled", "shuffle.partitions"):
            spark.conf.unset(f"spark.sql.{name}")


def test_semi_join_reduces_its_members_before_the_shuffle(spark, hot, plan):
    few = spark.createDataFrame([("hot",)], "name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(joins.semi_join_set(few, hot, "name", "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    members = text.split("LeftSemi", 1)[1]
    assert members.count("HashAggregate(keys=[__member") == 2
    assert joins.semi_join_set(few, hot, "name", "k").count() == 1


def test_ranges_follow_the_size(spark, plan):
    small, large = spark.range(10), spark.range(10_000_000)
    assert ordering.parts_for(large, 1 << 16) > ordering.parts_for(small, 1 << 16)
    ordered = ordering.order_total(large, "id", parts=77)
    assert "77" in plan(ordered).split("rangepartitioning", 1)[1].split("\n", 1)[0]


def test_shuffled_order_is_found_out(spark):
    """What the order queries return depends on the order that was stored."""
    from viewlog.plans.queries_operators import stored_order

    df = spark.range(100).selectExpr("id % 10 AS k", "id")
    right = {r["id"]: r["place"] for r in stored_order(ordering.order_total(df, "k"), "k").collect()}
    assert right == {i: i % 10 * 10 + 1 for i in range(100)}
    down = stored_order(ordering.order_total(df, F.col("k").desc()), "k").collect()
    assert {r["id"]: r["place"] for r in down} != right
    with pytest.raises(Exception, match="not next to each other"):
        stored_order(df.coalesce(1), "k").collect()


def test_hot_key_of_equal_rows_is_cut_by_an_id(spark, hot):
    """Rows that agree in every column of the join are dealt by what is given for it."""
    names = spark.createDataFrame([("hot", 1)], "name string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        cut = joins.join_skewed_key(
            hot, names, "k", "name", hot_rows=500, spread_by=F.col("id")
        ).select("k", "v")
        sizes = partition_sizes(cut)
        assert sum(sizes) == 10_000
        assert max(sizes) < 4_000
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.enabled", "shuffle.partitions"):
            spark.conf.unset(f"spark.sql.{name}")


@pytest.mark.parametrize("run", [plans.l2_power_user_views, plans.l14_merge_join])
def test_spreading_columns_are_not_read_when_nothing_is_hot(spark, data, pv, plan, run):
    text = plan(run(pv, views.users(spark, data)))
    events = next(s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "event_id" in s)
    assert {c.split(":")[0] for c in events.split(",")} == {"event_id", "user_id", "value"}


keys = st.one_of(st.none(), st.sampled_from(["a", "b", "c"]))


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(st.tuples(keys, st.integers(0, 2)), max_size=30),
    st.lists(st.tuples(keys, st.integers(0, 2)), max_size=6),
    st.sampled_from(["inner", "left"]),
)
def test_cut_join_equals_nested_loops(spark, left_rows, right_rows, how):
    left = spark.createDataFrame(left_rows, "k string, v int")
    right = spark.createDataFrame(right_rows, "name string, w int")
    expected = []
    for k, v in left_rows:
        partners = [(n, w) for n, w in right_rows if k is not None and n == k]
        expected += [(k, v, n, w) for n, w in partners]
        if how == "left" and not partners:
            expected.append((k, v, None, None))
    got = joins.join_skewed_key(left, right, "k", "name", how, hot_rows=2).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))


def test_hot_list_finds_the_hot_key(spark, hot):
    """From sketches of many tasks; nulls, another third of the rows, are no key."""
    expected = hot.select(F.xxhash64(F.lit("hot"))).first()[0]
    rows, listed = joins.key_profile(hot.repartition(70), "k", 4000)
    assert (rows, {r["__hash"]: r["__parts"] for r in listed}) == (30_000, {expected: 3})
    assert joins.key_profile(hot, "k", 30_000) == (30_000, [])
    assert joins.key_profile(hot.limit(0), "k", 10) == (0, [])
    assert joins.key_profile(hot.filter("k IS NULL"), "k", 10) == (10_000, [])


def test_sketch_with_more_keys_than_it_keeps(spark, monkeypatch):
    """No key above the limit is missed, and each gets parts enough."""
    monkeypatch.setattr(joins, "SKETCH_KEYS", 64)
    n = F.col("id")
    df = spark.range(0, 40_000, 1, 40).select(F.when(n % 4 == 0, -(n / 4 % 3).cast("bigint") - 1).otherwise(n).alias("k"))
    rows, listed = joins.key_profile(df, "k", 2000)
    hashes = {r[0] for r in spark.sql("SELECT xxhash64(k) FROM VALUES (-1L), (-2L), (-3L) AS t(k)").collect()}
    assert rows == 40_000 and {r["__hash"] for r in listed} == hashes
    assert all(r["__parts"] in (2, 3) for r in listed)


def jobs_of(spark, group, run):
    """Number of jobs that building (not running) something takes."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = run()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_skewed_join_reads_each_side_once_more(spark, hot):
    names = spark.createDataFrame([("hot", 1)], "name string, v int")
    # With adaptive execution each of the two shuffles of a profile is a job of its own.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined, jobs = jobs_of(spark, "profile", lambda: joins.join_skewed_key(hot, names, "k", "name", hot_rows=1000))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert jobs == 2
    assert joined.count() == 10_000


@pytest.fixture(scope="module")
def analysed(spark, data):
    """Page views and users as catalog tables with statistics."""
    names = {"viewlog_test_views": views.page_views(spark, data), "viewlog_test_users": views.users(spark, data)}
    for name, df in names.items():
        df.write.mode("overwrite").saveAsTable(name)
        catalog.analyze_table(spark, name)
    yield [spark.table(name) for name in names]
    for name in names:
        catalog.drop_table(spark, name)


def test_joins_of_analysed_tables_are_planned_without_a_job(spark, analysed):
    pv, users = analysed
    for number, run in enumerate((plans.l2_power_user_views, plans.l14_merge_join)):
        joined, jobs = jobs_of(spark, f"planned-{number}", lambda run=run: run(pv, users))
        assert jobs == 0
        assert joined.count() > 0


def test_known_sizes_are_bounds(spark, analysed):
    pv, users = analysed
    known = known_size(users.filter("zip > 3").select("name", "zip"))
    assert known.rows == users.count() and known.bytes >= joins.measured_bytes(users.filter("zip > 3").select("name", "zip"))
    assert known_size(users.groupBy("zip").count()).rows is None
    assert known_size(pv.select("user", "page_links")).bytes is None
    assert known_size(pv.select(F.upper("user").alias("u"))) .bytes is None
    assert known_size(spark.range(5)).rows is None


def test_rows_without_a_partner_are_not_shuffled(spark, plan):
    left = spark.range(20_000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 5000).alias("k"), "id")
    right = spark.range(0, 5000, 10).select(F.col("id").alias("name"))
    kept = drop_unmatched(left, right, "k", "name", 500)
    matched = left.join(right, left["k"] == right["name"])
    assert kept.columns == left.columns
    assert kept.join(right, kept["k"] == right["name"]).count() == matched.count()
    assert matched.count() <= kept.count() <= matched.count() + left.count() // 10
    text = plan(joins.join_replicated(left, right, "k", "name", limit=0))
    assert "bitmap_construct_agg" in text and "BroadcastHashJoin" in text
    joined = joins.join_replicated(left, right, "k", "name", limit=0)
    assert joined.exceptAll(matched).count() == 0 and joined.count() == matched.count()


def test_filters_that_cannot_help_are_left_out(spark):
    left, right = spark.range(10).withColumnRenamed("id", "k"), spark.range(3).select(F.col("id").cast("int").alias("name"))
    assert drop_unmatched(left, right, "k", "name", 3) is left
    same = right.select(F.col("name").cast("bigint").alias("name"))
    assert drop_unmatched(left, same, "k", "name", 1 << 40) is left
    assert drop_unmatched(left, same.limit(0), "k", "name", 0).count() == 0


def test_hot_list_stays_bounded(spark, monkeypatch):
    """With more hot keys than the list may hold, the row limit rises instead of the list."""
    monkeypatch.setattr(joins, "HOT_LIST_LIMIT", 4)
    left = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    right = spark.range(10).withColumnRenamed("id", "name")
    cut = joins.join_skewed_key(left, right, "k", "name", hot_rows=5)
    assert cut.count() == 1000
    assert cut.filter("k <> name").count() == 0


def test_merge_hint_survives_salting(hot, spark, plan):
    names = spark.createDataFrame([("hot", 1)], "name string, v int")
    cut = joins.join_skewed_key(hot, names, "k", "name", hot_rows=1000, merge=True)
    assert "SortMergeJoin" in plan(cut)


@pytest.mark.parametrize("build", ["order", "range"])
def test_sorted_ranges_are_even_despite_hot_keys(hot, spark, build):
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        key = F.col("k").asc_nulls_first()
        df = ordering.order_total(hot, key) if build == "order" else ordering.range_partition_skewed(hot, 12, key)
        sizes = partition_sizes(df)
        assert len(sizes) == 12
        assert max(sizes) < 2 * 30_000 / 12
        assert max(partition_sizes(hot.orderBy(key))) >= 10_000
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_total_order_is_total(hot):
    got = [r.k for r in ordering.order_total(hot, F.col("k").asc_nulls_first()).collect()]
    assert got == sorted(got, key=lambda k: (k is not None, k or ""))


def test_nested_order_is_sorted_within_groups(pv):
    df = ordering.nested_order(
        pv.select("user", "estimated_revenue"), "user", F.col("estimated_revenue").asc_nulls_first()
    )
    got = [(r.user, r.estimated_revenue) for r in df.collect()]
    assert got == sorted(got, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))


def test_top_k_sorts_no_whole_table(spark, data, plan):
    orders = table(spark, data, "orders")
    assert "TakeOrderedAndProject" in plan(ordering.top_k(orders, 5, F.col("o_totalprice").desc()))


def test_sorted_files_are_in_order(spark, hot):
    path = scratch_path(spark, "test-sorted")
    ordering.sorted_write(hot, path, F.col("k").asc_nulls_first())
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(
        F.min(F.coalesce("k", F.lit(""))).alias("low"), F.max(F.coalesce("k", F.lit(""))).alias("high")
    )
    ranges = [(r.low, r.high) for r in files.orderBy("f").collect()]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_samples_repeat(hot):
    by_key = [ordering.sample_by_key(hot.repartition(n), "id", 50).count() for n in (1, 5)]
    assert by_key[0] == by_key[1]
    assert abs(by_key[0] - 15_000) < 400
    assert abs(ordering.sample(hot, 0.5, seed=1).count() - 15_000) < 400


def test_parallelism_and_colocation(hot):
    assert len(partition_sizes(ordering.parallelism(hot, 9))) == 9
    seen = ordering.colocated_scan(hot, "k").withColumn("p", F.spark_partition_id())
    assert seen.groupBy("k").agg(F.count_distinct("p").alias("n")).filter("n > 1").count() == 0


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/")
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_l12_tags_rows_without_copying_them(spark, plan):
    views = spark.createDataFrame([], PAGE_VIEWS)
    text = plan(plans.l12_three_outputs(views))
    assert "Generate" not in text
    assert text.count("Exchange") == 1
