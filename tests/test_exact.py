"""Exact sums against Fractions, and distinct counts from stored bitmaps."""

from __future__ import annotations

import math
import random
import struct
from datetime import datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from viewlog.operators import bitmaps
from viewlog.operators.exact_sum import exact_sum
from viewlog.plans import driver_views as views
from viewlog.plans import page_views as plans
from viewlog.plans import queries_page_views as queries
from viewlog.session import scratch_path

SCHEMA = "k int, v double"


def bits(x):
    return None if x is None else struct.pack(">d", x)


def rounded_once(values):
    total = sum((Fraction(v) for v in values), Fraction(0))
    try:
        return float(total)  # the division of two integers is rounded correctly
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def test_sums_are_exact(spark):
    deal, rows = random.Random(4), []
    for k in range(60):
        span = deal.choice([0, 3, 40, 300, 1000])
        for _ in range(deal.choice([1, 2, 30])):
            rows.append((k, math.ldexp(deal.uniform(-1, 1), deal.randint(-span, min(span, 900)))))
    rows += [(100, v) for v in (1e308, 1e308, -1e308)] + [(101, v) for v in (1e308, 1e308)]
    rows += [(102, v) for v in (5e-324, 5e-324, -1.5e-323)] + [(103, v) for v in (2.0**53, 1.0, 2.0**-60)]
    rows += [(104, v) for v in (2.0**53, 1.0)] + [(105, v) for v in (2.0**53 + 2, 1.0)] + [(106, v) for v in (1e16, -1e16)]
    rows += [(107, 0.1)] * 10 + [(108, 2.0**k) for k in range(-60, 60)] + [(109, -v) for v in (2.0**53, 1.0, 2.0**-900)]
    rows += [(110, 2.2250738585072014e-308), (110, -5e-324), (111, 1.7976931348623157e308)]
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    got = {r.k: r.s for r in exact_sum(spark.createDataFrame(rows, SCHEMA), ["k"], "v", "s").collect()}
    assert {k: v for k, v in got.items() if bits(v) != bits(rounded_once(want[k]))} == {}
    assert len(got) == len(want)


def test_sums_of_odd_values(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, None), (2, 0.0), (2, -0.0), (3, inf), (3, 1.0), (4, inf), (4, -inf), (5, nan), (6, None), (6, 2.5), (None, 1.5)]
    got = {r.k: r.s for r in exact_sum(spark.createDataFrame(rows, SCHEMA), ["k"], "v", "s").collect()}
    assert math.isnan(got.pop(4)) and math.isnan(got.pop(5))
    assert got == {1: None, 2: 0.0, 3: inf, 6: 2.5, None: 1.5}
    assert exact_sum(spark.createDataFrame([], SCHEMA), ["k"], "v", "s").collect() == []


def test_partitioning_changes_no_bit(spark):
    values = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.rand(3) * F.pow(F.lit(10.0), F.rand(4) * 20 - 10)).alias("v"))
    path = scratch_path(spark, "doubles")
    values.write.parquet(path)
    seen = {
        tuple(sorted((r.k, bits(r.s)) for r in exact_sum(spark.read.parquet(path).repartition(n), ["k"], "v", "s").collect()))
        for n in (1, 7, 200)
    }
    assert len(seen) == 1


def test_bitmaps_count_and_merge(spark):
    rows = [("a", 1, 0), ("a", 1, 1), ("a", 2, 1), ("a", 2, 40_000), ("a", 2, -3), ("b", 1, None), (None, 1, 7), (None, 2, 7), ("c", 3, -(2**40))]
    df, path = spark.createDataFrame(rows, "k string, day int, v bigint"), scratch_path(spark, "bits")
    for low in (1, 2):  # two appends
        part = df.filter((F.col("day") == 1) == (low == 1))
        bitmaps.append_bitmaps(part, path, ["k"], ["v"], F.col("day"))
    counted = bitmaps.stored_counts(spark, path, ["k"], {"v": "n"})
    assert {r.k: r.n for r in counted.collect()} == {"a": 4, "b": 0, None: 1, "c": 1}
    some = bitmaps.stored_counts(spark, path, ["k"], {"v": "n"}, F.col("day") < 2)
    assert {r.k: r.n for r in some.collect()} == {"a": 2, "b": 0, None: 1}


def test_bitmap_counts_have_no_expand(spark, plan):
    df, path = spark.range(100).select((F.col("id") % 5).alias("k"), "id", (F.col("id") % 7).alias("v")), scratch_path(spark, "bits")
    bitmaps.append_bitmaps(df, path, ["k"], ["id", "v"], F.lit(1))
    counted = bitmaps.stored_counts(spark, path, ["k"], {"id": "n", "v": "m"})
    assert "Expand" not in plan(counted)
    assert {tuple(r) for r in counted.collect()} == {(k, 20, 7) for k in range(5)}


@pytest.mark.parametrize("bad", ["text"])
def test_bitmaps_want_integers(spark, bad):
    df = spark.createDataFrame([("a", bad)], "k string, v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bitmaps.bitmaps(df, ["k"], "v").collect()


def test_thin_bitmaps_stay_small_unpacked(spark, plan):
    """A key's lone values cost a few words each, in the shuffle's bytes and in a task's memory alike."""
    edges = [0, 63, 64, -1, -64, -65, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(k, v) for k in range(50) for v in (*edges, k * 2**20, None)], "k int, v bigint")
    thin = bitmaps.bitmaps(df, ["k"], "v")
    assert [f.dataType.simpleString() for f in thin.schema] == ["int", "bigint", "bigint"]
    merged = bitmaps.count_bits(thin, ["k"], "n")
    assert "SortAggregate" not in plan(merged)  # buffers of a fixed width, so nothing is sorted
    assert {r.k: r.n for r in merged.collect()} == {k: 9 - (k == 0) for k in range(50)}


def stored_days(spark):
    """Actions and times of a few views, stored by day; a user and a day come with nulls alone."""
    rows = [("u1", 0, 5, 1), ("u1", 1, 5, 1), ("u1", 1, 63, 2), ("u1", 1, 64, 2), (None, 0, 7, 2), (None, 0, 7, 3), ("u2", None, None, 3)]
    path = scratch_path(spark, "days")
    views = spark.createDataFrame(rows, "user string, action int, timespent int, day int")
    plans.store_daily_bitmaps(views, path)
    return path


def test_l15_counts_from_daily_bitmaps_of_fixed_width(spark, plan):
    path = stored_days(spark)
    counts = plans.l15_counts_from_bitmaps(spark, path)
    assert "SortAggregate" not in plan(counts)
    assert {tuple(r) for r in counts.collect()} == {("u1", 2, 3), (None, 1, 1), ("u2", 0, 0)}
    assert dict(spark.read.parquet(f"{path}/timespent").dtypes)["bits"] == "bigint"


def test_l4_counts_of_chosen_days_from_bitmaps_of_fixed_width(spark, plan):
    path = stored_days(spark)
    for days, expected in (
        (None, {("u1", 2), (None, 1), ("u2", 0)}),
        (F.col("day") > 1, {("u1", 1), (None, 1), ("u2", 0)}),
        (F.col("day") == 1, {("u1", 2)}),
    ):
        counts = plans.l4_from_bitmaps(spark, path, days)
        assert "SortAggregate" not in plan(counts)
        assert {tuple(r) for r in counts.collect()} == expected


def stored_events(spark):
    """A folder of events; two of one id lie on different days, one has no id and one no time."""
    rows = [
        (1, datetime(2024, 1, 1, 23, 59), 7, "click"),
        (1, datetime(2024, 1, 2), 7, "view"),
        (2, datetime(2024, 1, 2, 5), 8, "view"),
        (None, datetime(2024, 1, 1), 9, "view"),
        (3, None, 7, "click"),
    ]
    folder = scratch_path(spark, "tables")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame([(*r, 1.0, None) for r in rows], schema).write.parquet(f"{folder}/events.parquet")
    return folder


def test_l15_days_come_from_the_row_itself(spark, plan):
    """No join by id, whose sorted sides filled a task's memory and whose rows grew with the square of a repeated id."""
    folder = stored_events(spark)
    dated = views.dated_page_views(spark, folder)
    assert not any(node in plan(dated) for node in ("Join", "Exchange", "Sort"))
    found = sorted((r.event_id, r.user, r.action, str(r.day)) for r in dated.collect())
    assert found == [(1, "u7", 0, "2024-01-02"), (1, "u7", 1, "2024-01-01"), (2, "u8", 0, "2024-01-02"), (3, "u7", 1, "None")]
    assert {tuple(r) for r in queries.l15_bitmaps(spark, folder).collect()} == {("u7", 2, 2), ("u8", 1, 1)}


def test_l4_views_of_a_repeated_id_stay_on_their_own_days(spark):
    path = queries.daily_bitmaps(spark, folder := stored_events(spark))
    for day, expected in (("2024-01-01", {("u7", 1)}), ("2024-01-02", {("u7", 1), ("u8", 1)})):
        counts = plans.l4_from_bitmaps(spark, path, F.col("day") == F.lit(day).cast("date"))
        assert {tuple(r) for r in counts.collect()} == expected
    assert {tuple(r) for r in queries.l4_bitmaps(spark, folder).collect()} == {("u7", 2), ("u8", 1)}


def test_l4_scan_tasks_hold_no_bitmaps(spark, plan):
    """A scan task reads a whole row group; bitmaps are made of dealt rows, in partitions that AQE keeps to a size."""
    dated = views.dated_page_views(spark, stored_events(spark))
    daily = bitmaps.bitmaps(dated, ["day", "user"], "action")
    lowest = plan(daily).rpartition("HashAggregate")[2]
    assert "hashpartitioning(day" in lowest and "REBALANCE_PARTITIONS_BY_COL" in lowest
    assert "props" not in lowest  # only the columns that are used are moved
    found = sorted((str(r.day), r.user, r.bucket, r.bits) for r in daily.collect())
    assert found == [("2024-01-01", "u7", 0, 2), ("2024-01-02", "u7", 0, 1), ("2024-01-02", "u8", 0, 1), ("None", "u7", 0, 2)]


def test_dealt_rows_of_a_hot_key_count_the_same(spark):
    """A key with most rows, nulls among them, and names that need quoting."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), F.expr("if(id % 7 = 0, null, id % 200)").alias("a.v")
    )
    counts = bitmaps.count_bits(bitmaps.bitmaps(df, ["k"], "a.v"), ["k"], "n")
    expected = df.groupBy("k").agg(F.count_distinct("`a.v`").alias("n"))
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in expected.collect()}
