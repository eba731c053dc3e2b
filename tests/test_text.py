from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viewlog.functions import text
from viewlog.plans import driver_views
from viewlog.schema import PAGE_VIEWS
from viewlog.session import scratch_path
from viewlog.sources import delimited, routing
from viewlog.sources.catalog import write_finished

A, B, C, D = text.FIELD_SEP, text.BAG_SEP, text.PAIR_SEP, text.KEY_SEP


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_map_text(spark):
    assert one(spark, text.decode_map, f"a{D}v1{C}b{D}v2") == {"a": "v1", "b": "v2"}
    assert one(spark, text.decode_map, f"a{D}v1{C}b{D}v2{C}a{D}v3") == {"a": "v3", "b": "v2"}
    assert one(spark, text.decode_map, None) is None
    assert one(spark, text.decode_map, "") == {}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        one(spark, lambda c: text.decode_map(c, "error"), f"a{D}v1{C}a{D}v3")


def test_bag_text(spark):
    assert one(spark, text.decode_bag, f"ma{D}1{B}mb{D}2") == [{"a": "1"}, {"b": "2"}]
    assert one(spark, lambda c: text.decode_bag(c, "i"), f"i1{B}ix{B}i3") == [1, None, 3]
    assert one(spark, lambda c: text.decode_bag(c, "d"), f"d1.5{B}f2") == [1.5, 2.0]
    assert one(spark, lambda c: text.decode_bag(c, "s"), f"sab{B}s") == ["ab", ""]
    assert one(spark, text.decode_bag, None) is None
    assert one(spark, text.decode_bag, "") == []


@pytest.mark.parametrize("letter, element, message", [("z", "m", "unknown type z"), ("s", "m", "cannot hold")])
def test_bag_type_errors(spark, letter, element, message):
    with pytest.raises(Exception, match=message):
        one(spark, lambda c: text.decode_bag(c, element), f"{letter}x")


plain = st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.lists(st.dictionaries(st.sampled_from("abcdef"), plain, min_size=1), min_size=1)), min_size=1, max_size=20))
def test_bag_round_trip(spark, bags):
    df = spark.createDataFrame([(b,) for b in bags], "b array<map<string,string>>")
    back = df.select(text.decode_bag(text.encode_bag(F.col("b"))))
    assert [r[0] for r in back.collect()] == bags


def test_page_views_round_trip(spark, data):
    pv = driver_views.page_views(spark, data).select(*PAGE_VIEWS.names)
    path = scratch_path(spark, "test-round-trip")
    delimited.write_page_views(pv, path)
    back = delimited.read_page_views(spark, path)
    assert back.schema == PAGE_VIEWS
    assert back.count() == pv.count()
    links = F.sum(F.size("page_links")).alias("n")
    counted = pv.filter(F.size("page_links") > 0).agg(links)
    assert back.filter(F.col("page_links").isNotNull()).agg(links).first() == counted.first()


def test_rows_of_nulls_and_odd_characters_survive(spark):
    path = scratch_path(spark, "test-odd")
    records = [(None, None), ('"', "\\"), (" x ", "# y"), ("a,b", "'"), ("é", "\ttab")]
    df = spark.createDataFrame(records, "a string, b string")
    delimited.write_delimited(df, path, A)
    back = delimited.read_delimited(spark, path, "a string, b string", A)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_short_and_unreadable_fields_are_null(spark):
    path = scratch_path(spark, "test-short")
    spark.createDataFrame([("1,x",), ("2",), ("z,y,more",)], "line string").write.text(path)
    back = delimited.read_delimited(spark, path, "n int, s string", ",")
    assert sorted(back.collect(), key=str) == [(1, "x"), (2, None), (None, "y")]


def test_malformed_lines(spark):
    lines = [A.join("x" * n) for n in (8, 9, 10)] + [A * 8]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    assert delimited.drop_malformed(df, 9).count() == 2
    assert tuple(delimited.count_malformed(df, 9).first()) == (2, 2)


def test_tuple_text(spark):
    path = scratch_path(spark, "test-tuple")
    lines = [("(a, b,c)",), ("(1,,3)",), ("no tuple",)]
    spark.createDataFrame(lines, "line string").coalesce(1).write.text(path)
    back = delimited.read_tuple_text(spark, path, ["x", "y", "z"])
    assert [tuple(r) for r in back.collect()] == [("a", "b", "c"), ("1", "", "3"), (None,) * 3]


def test_nested_columns_are_refused(spark):
    df = spark.createDataFrame([({"a": "b"},)], "m map<string,string>")
    with pytest.raises(ValueError, match="encode"):
        delimited.write_delimited(df, scratch_path(spark, "test-nested"))


def test_route_write_refuses_existing_target_before_writing(spark):
    root = scratch_path(spark, "test-routes")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "route string, v int")
    df.write.csv(f"{root}/b")
    routes = {f"{root}/{r}": (F.col("route") == r, ["v"]) for r in "ab"}
    with pytest.raises(FileExistsError):
        routing.route_write(df, routes)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.text(f"{root}/a")


def test_routes_may_overlap_and_store_chosen_columns(spark):
    root = scratch_path(spark, "test-overlap")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "route string, v int")
    routing.route_write(
        df, {f"{root}/low": (F.col("v") < 3, ["v"]), f"{root}/all": (F.lit(True), ["route", "v"])}
    )
    assert sorted(r[0] for r in delimited.read_lines(spark, f"{root}/low").collect()) == ["1", "2"]
    assert delimited.read_lines(spark, f"{root}/all").count() == 3


def test_routes_are_written_in_one_pass(spark, plan):
    """One scan, nothing cached, and a line per route a row meets."""
    path = scratch_path(spark, "test-one-pass")
    spark.range(100).write.parquet(path)
    df = spark.read.parquet(path)
    routes = {"low": (F.col("id") < 30, ["id"]), "even": (F.col("id") % 2 == 0, ["id"]), "none": (F.col("id") < 0, ["id"])}
    lines = routing.routed_lines(df, routes)
    assert plan(lines).count("FileScan") == 1
    assert not any(word in plan(lines) for word in ("InMemoryTableScan", "Exchange", "Union"))
    assert lines.count() == 80


def test_modes_of_routes(spark):
    root = scratch_path(spark, "test-modes")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "route string, v int")
    routes = {f"{root}/x/{r}": (F.col("route") == r, ["v"]) for r in "abz"}

    def stored(r):
        return sorted(x[0] for x in delimited.read_lines(spark, f"{root}/x/{r}").collect())

    routing.route_write(df, routes)
    routing.route_write(df, routes, mode="append")
    assert (stored("a"), stored("b"), stored("z")) == (["1", "1"], ["2", "2"], [])
    routing.route_write(df.filter("v = 2"), routes, mode="overwrite")
    assert (stored("a"), stored("b")) == ([], ["2"])
    assert all(write_finished(spark, path) for path in routes)
    bad = spark.createDataFrame([("a", "x\ty")], "route string, v string")
    with pytest.raises(Exception, match="separator or line break"):
        routing.route_write(bad, {f"{root}/x/b": (F.lit(True), ["v"])}, mode="overwrite")
    assert stored("b") == ["2"]
    with pytest.raises(ValueError, match="mode"):
        routing.route_write(df, routes, mode="ignore")


def test_reading_some_columns_splits_no_further(spark, plan):
    path = scratch_path(spark, "test-some")
    df = spark.createDataFrame([("a", 1, None, "z"), (None, 2, "y", "z")], "a string, b int, c string, d string")
    delimited.write_delimited(df, path, A)
    some = delimited.read_delimited(spark, path, df.schema, A, columns=["b", "a"])
    assert sorted(some.collect(), key=str) == [(1, "a"), (2, None)]
    assert ", 3)" in plan(some)


@pytest.mark.parametrize("value", ["a,b", "x\ny", "x\ry"])
def test_values_that_would_break_their_row_are_refused(spark, value):
    df = spark.createDataFrame([(value, "c")], "p string, `q.r` string")
    for write in (lambda path: delimited.write_delimited(df, path, ","), lambda path: delimited.write_tuple_text(df, path)):
        with pytest.raises(Exception, match="separator or line break"):
            write(scratch_path(spark, "refused"))
