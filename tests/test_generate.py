"""Laws of generated data: domains, shares, lengths, distributions, repeatability."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from viewlog import generate
from viewlog.functions import draw
from viewlog.functions.text import encode_map
from viewlog.plans import prep
from viewlog.plans.all_queries import QUERIES
from viewlog.schema import (
    PAGE_VIEW_SPECS,
    PAGE_VIEWS,
    USERS,
    ColSpec,
    distribution_name,
    parse_colspec,
    TableSpec,
    type_name,
)
from viewlog.session import scratch_path

N = 20_000


@pytest.mark.parametrize("text", ["s:20:160000:z:7", "bm:10:1:z:20", "i:1:2:u:0", "d:1:9:u:5:/maps/x"])
def test_spec_text_round_trip(text):
    assert parse_colspec(text).to_string() == text


def test_spec_parts():
    spec = parse_colspec("s:20:160000:z:7")
    assert (spec.dtype, spec.avg_length, spec.cardinality) == ("string", 20, 160000)
    assert (spec.distribution, spec.percent_null) == ("zipf", 7)
    bag = parse_colspec("bm:10:1:z:20")
    assert bag.element.dtype == "map"
    assert bag.percent_null == 20


@pytest.mark.parametrize("text", ["s:20:1:z", "s:20:1:z:7:a:b", "q:1:1:u:0", "i:1:1:x:0", "i:1:1:u:101", "i:1:1:u:-1", "i:1:0:u:0"])
def test_bad_specs(text):
    with pytest.raises(ValueError):
        parse_colspec(text)


def test_type_and_distribution_names():
    assert type_name("l") == "long"
    assert type_name("DOUBLE") == "double"
    assert distribution_name("z") == distribution_name("zipf") == "zipf"
    for bad in ("x", "text"):
        with pytest.raises(ValueError):
            type_name(bad)


def test_generation_requests(spark):
    specs = {"a": "i:1:2:u:0"}
    source = spark.range(3)
    for rows, df, columns, output in [
        (0, None, specs, "out"),
        (None, None, specs, "out"),
        (5, source, specs, "out"),
        (5, None, {}, "out"),
        (5, None, specs, None),
        (5, None, {"s": "s:1:60:u:0"}, "out"),
    ]:
        with pytest.raises(ValueError):
            generate.check_gen_conf(columns, rows, df, output)
    generate.check_gen_conf(specs, rows=5, output="out")
    generate.check_gen_conf(specs, source=source)
    with pytest.raises(ValueError, match="exist already"):
        generate.gen_append(source, {"ID": "i:1:2:u:0"}, "id")


def test_same_seed_same_data_for_any_partition_count(spark):
    def checksum(parts, seed):
        df = generate.gen_page_views(spark, 300, seed, parts)
        flat = df.withColumns({c: F.to_json(c) for c in ("page_info", "page_links")})
        return flat.agg(F.sum(F.xxhash64(*flat.columns).cast("decimal(38,0)"))).first()[0]

    assert checksum(1, 5) == checksum(3, 5) == checksum(16, 5)
    assert checksum(3, 5) != checksum(3, 6)


def test_page_view_schema_and_shares(spark):
    df = generate.gen_page_views(spark, N, seed=2, parts=8).cache()
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in PAGE_VIEWS]
    row = df.agg(
        *[(F.count_if(F.col(c).isNull()) / N * 100).alias(c) for c in df.columns],
        F.min("action").alias("low"),
        F.max("action").alias("high"),
        F.max("timespent").alias("longest"),
        F.min(F.size("page_info")).alias("small"),
        F.max(F.size("page_info")).alias("large"),
        F.min(F.when(F.col("page_links").isNotNull(), F.size("page_links"))).alias("few"),
        F.max(F.size("page_links")).alias("many"),
        F.min(F.length("query_term")).alias("short"),
        F.max(F.length("query_term")).alias("long"),
    ).first()
    for name, text in PAGE_VIEW_SPECS.items():
        share = parse_colspec(text).percent_null
        assert row[name] == share == 0 or abs(row[name] - share) < 1.5, name
    assert (row.low, row.high, row.longest) == (0, 1, 19)
    assert (row.small, row.large, row.few, row.many) == (6, 25, 5, 9)
    assert (row.short, row.long) == (7, 12)
    letters = df.filter(F.col("user").rlike("[^A-y]")).count()
    assert letters == 0
    df.unpersist()


def test_zipf_follows_its_law(spark):
    card = 1000
    df = generate.gen_table(spark, {"v": f"i:1:{card}:z:0"}, 200_000, seed=1, parts=8)
    counts = {r.v: r["count"] for r in df.groupBy("v").count().collect()}
    assert min(counts) >= 0 and max(counts) < card
    total = draw.harmonic(card)
    for rank in (1, 2, 3, 10, 13, 14, 50):
        expected = 200_000 / (rank * total)
        assert abs(counts[rank - 1] - expected) < 5 * math.sqrt(expected), rank


def test_harmonic_series():
    for n in (1, 5, 199, 200, 1000, 100_000):
        assert draw.harmonic(n) == pytest.approx(math.fsum(1 / k for k in range(1, n + 1)), abs=1e-12)


def test_uniform_is_even(spark):
    df = generate.gen_table(spark, {"v": "l:1:10:u:0"}, 100_000, seed=1, parts=8)
    counts = [r["count"] for r in df.groupBy("v").count().collect()]
    assert len(counts) == 10
    assert all(abs(c - 10_000) < 500 for c in counts)


@pytest.mark.parametrize("text", ["s:2:1600:z:20", "s:10:180000:z:20", "s:1:58:u:0", "d:1:100000:u:0", "f:1:100000:u:0"])
def test_domain_values_are_distinct(spark, text):
    spec = parse_colspec(text)
    values = generate.value_domain(spark, spec, seed=4, column=3)
    got = values.agg(F.count("value").alias("n"), F.count_distinct("value").alias("d")).first()
    assert got.n == got.d == spec.cardinality
    if spec.dtype == "string":
        lengths = draw.string_lengths(spec.avg_length)
        size = F.length("value")
        low, high = values.agg(F.min(size), F.max(size)).first()
        assert lengths[0] <= low and high <= lengths[-1]
    else:
        low, high = values.agg(F.min("value"), F.max("value")).first()
        assert -(2.0**31) <= low and high <= 2.0**31


def test_generated_values_come_from_the_domain(spark):
    specs = {"a": "i:1:2:u:0", "t": "s:3:50:z:0"}
    drawn = generate.gen_table(spark, specs, 2000, seed=9, parts=3).select(F.col("t").alias("value"))
    domain = generate.value_domain(spark, specs["t"], seed=9, column=1)
    assert drawn.join(domain, "value", "left_anti").count() == 0


@pytest.mark.parametrize("text", ["s:1:59:u:0", "s:2:3307:u:0", "s:0:2:u:0", "f:1:9000000:u:0"])
def test_impossible_domains_are_refused(spark, text):
    with pytest.raises(ValueError):
        generate.value_domain(spark, text)


def test_append_keeps_rows(spark):
    base = spark.range(100).withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))
    got = generate.gen_append(base, {"phone": "s:10:500:z:20"}, "id", seed=1)
    assert got.columns == ["id", "name", "phone"]
    assert got.select("id", "name").exceptAll(base).count() == 0
    again = generate.gen_append(base.repartition(7), {"phone": "s:10:500:z:20"}, "id", seed=1)
    assert got.exceptAll(again).count() == 0


def test_bag_of_strings_and_numbers(spark):
    df = generate.gen_table(spark, {"a": "bs:5:40:u:0", "b": "bd:1:9:z:50"}, 500, seed=3, parts=2)
    row = df.agg(
        F.max(F.size("a")).alias("most"),
        F.count_if(F.col("b").isNull()).alias("nulls"),
    ).first()
    assert row.most == 9
    assert 180 < row.nulls < 320
    assert df.select(F.explode("a").alias("v")).distinct().count() == 40


def test_preparation(spark):
    root = scratch_path(spark, "test-prep")
    paths = prep.prep_page_view_tables(spark, root, rows=1500, seed=1, parts=4)
    tables = {n: spark.read.parquet(p) for n, p in paths.items()}
    users = tables["users"]
    assert [(f.name, f.dataType) for f in users.schema] == [(f.name, f.dataType) for f in USERS]
    views = tables["page_views"]
    assert users.count() == views.select("user").distinct().count()
    assert users.filter("name is null").count() == 1
    power = tables["power_users"]
    assert power.count() == 500
    first = sorted(r[0] or "" for r in users.select("name").collect())[:500]
    assert sorted(r[0] or "" for r in power.select("name").collect()) == first
    assert power.exceptAll(users).count() == 0
    samples = tables["power_users_samples"]
    assert samples.exceptAll(power).count() == 0
    assert 180 < samples.count() < 320
    assert len(tables["widerow"].columns) == 501
    assert tables["widerow"].count() == tables["page_views_sorted"].count() == 1500
    assert len(tables["widegroupbydata"].columns) == 27
    names = [r[0] or "" for r in tables["users_sorted"].orderBy(F.input_file_name()).collect()]
    assert sorted(names) == sorted(r[0] or "" for r in users.select("name").collect())


def test_colspec_of_partition_cannot_have_nulls():
    with pytest.raises(ValueError, match="cannot have nulls"):
        TableSpec("t", "db", (("a", ColSpec("int")),), (("p", ColSpec("int", percent_null=1)),))


def test_map_file_gives_the_same_values_as_the_inline_domain(spark):
    specs = {"a": "i:1:2:u:0", "t": "s:6:300:z:10", "d": "d:1:50:u:0"}
    mapped = {"a": specs["a"]}
    for column, name in ((1, "t"), (2, "d")):
        path = scratch_path(spark, "test-map-file")
        generate.write_value_domain(spark, specs[name], path, seed=5, column=column)
        mapped[name] = f"{specs[name]}:{path}"
    plain = generate.gen_table(spark, specs, 3000, seed=5, parts=3)
    looked_up = generate.gen_table(spark, mapped, 3000, seed=5, parts=3)
    assert looked_up.columns == plain.columns
    assert looked_up.schema == plain.schema
    assert looked_up.exceptAll(plain).count() == 0


def test_map_file_without_a_value_is_an_error(spark):
    path = scratch_path(spark, "test-short-map")
    spark.createDataFrame([("0\tzero",)], "line string").write.text(path)
    drawn = generate.gen_table(spark, {"t": f"s:4:5:u:0:{path}"}, 100, seed=1)
    with pytest.raises(Exception, match="has no value for number"):
        drawn.collect()


def test_maps_of_a_small_file_are_drawn_by_many_tasks(spark, tmp_path, monkeypatch):
    """A file of keys alone is read by one task, which drew the maps of all its rows."""
    path = str(tmp_path / "keys")
    keys = [*range(5000), 7, 7, None, None]
    spark.createDataFrame([(k,) for k in keys], "id bigint").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    monkeypatch.setattr(generate, "DRAWN_ROWS", 600)
    parts = generate.parts_to_draw(rows)
    assert parts == 9 and generate.parts_to_draw(rows.limit(0)) == 1
    spec = {"value": "m:10:1:z:0"}
    spread = generate.gen_append(rows, spec, "id", 3, parts).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in spread.groupBy("task").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 700
    plain = generate.gen_append(rows, spec, "id", 3)
    text = [F.coalesce(F.col("id"), F.lit(-1)).alias("id"), encode_map(F.col("value")).alias("value")]
    assert sorted(map(tuple, spread.select(*text).collect())) == sorted(map(tuple, plain.select(*text).collect()))


@pytest.mark.parametrize("name", ["gen_map", "gen_bag"])
def test_generated_collections_deal_their_rows_out(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(generate, "DRAWN_ROWS", 100)
    spark.range(1000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    drawn = QUERIES[name](spark, str(tmp_path))
    assert drawn.select(F.spark_partition_id()).distinct().count() == 10
    assert drawn.count() == 1000
