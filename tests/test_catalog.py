from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from viewlog.plans import load_store, reports
from viewlog.schema import ColSpec, TableSpec
from viewlog.session import scratch_path
from viewlog.sources import catalog, delimited, specs


@pytest.fixture
def spec():
    return TableSpec(
        name="visits",
        database="default",
        columns=(
            ("who", ColSpec("string", 8, 300, "uniform", 10)),
            ("spent", ColSpec("int", 1, 50, "zipf", 10)),
        ),
        partitions=(("act", ColSpec("int", 1, 3)), ("test", ColSpec("string", 5, 4))),
        rows=2500,
    )


@pytest.fixture
def root(spark, spec):
    path = scratch_path(spark, "test-catalog")
    yield path
    catalog.clean_up(spark, spec)


def column(name, kind="string", length=5, nulls=None):
    parts = [f"<name>{name}</name><type>{kind}</type>"]
    if length is not None:
        parts.append(f"<avgLength>{length}</avgLength>")
    parts.append("<distribution>uniform</distribution><cardinality>6</cardinality>")
    if nulls is not None:
        parts.append(f"<percentageNull>{nulls}</percentageNull>")
    return "".join(parts)


def spec_file(spark, body):
    path = scratch_path(spark, "test-spec")
    spark.createDataFrame([(f"<database><tables>{body}</tables></database>",)], "x string").coalesce(
        1
    ).write.text(path)
    return path


def table_xml(prefix="visits", columns="", partitions="", instances=((10, 1),), db="default"):
    sizes = "".join(
        f"<instance><size>{s}</size><count>{c}</count></instance>" for s, c in instances
    )
    return (
        f"<table><namePrefix>{prefix}</namePrefix><dbName>{db}</dbName>"
        f"<columns>{columns}</columns>{partitions}<instances>{sizes}</instances></table>"
    )


def test_read_table_specs(spark):
    first = table_xml(
        "views",
        f"<column>{column('who', nulls=7)}</column><column>{column('spent', 'INT', None, 9)}</column>",
        f"<partitions><partition>{column('act', 'string', 99)}</partition>"
        f"<partition>{column('age', 'int', None)}</partition></partitions>",
        ((200, 1), (50, 0)),
    )
    second = table_xml("people", f"<column>{column('id', nulls=0)}</column>", "", ((5, 1), (9, 2)), "db1")
    tables = specs.read_table_specs(spark, spec_file(spark, first + second))
    assert [(t.qualified, t.rows) for t in tables] == [
        ("default.views_200_0", 200),
        ("db1.people_5_0", 5),
        ("db1.people_9_0", 9),
        ("db1.people_9_1", 9),
    ]
    views = tables[0]
    assert views.columns == (
        ("who", ColSpec("string", 5, 6, "uniform", 7)),
        ("spent", ColSpec("int", 0, 6, "uniform", 9)),
    )
    assert [n for n, _ in views.partitions] == ["act", "age"]
    assert tables[1].partitions == ()


@pytest.mark.parametrize(
    "columns, partitions, message",
    [
        (f"<column>{column('a', 'string', None, 1)}</column>", "", "avgLength"),
        (f"<column>{column('a')}</column>", "", "percentageNull"),
        (
            f"<column>{column('a', nulls=1)}</column>",
            f"<partitions><partition>{column('p', nulls=1)}</partition></partitions>",
            "cannot have percentageNull",
        ),
        (
            f"<column>{column('a', nulls=1)}</column><partition>{column('p')}</partition>",
            "",
            "inside <columns>",
        ),
        (
            f"<column>{column('uri', nulls=1)}</column>",
            f"<partitions><partition>{column('uri')}</partition></partitions>",
            "appear twice",
        ),
        (f"<column>{column('a', 'date', None, 1)}</column>", "", "unknown data type"),
    ],
)
def test_bad_specs_are_refused(spark, columns, partitions, message):
    path = spec_file(spark, table_xml("t", columns, partitions))
    with pytest.raises(ValueError, match=message):
        specs.read_table_specs(spark, path)


def test_four_load_store_jobs(spark, spec, root):
    data = catalog.set_up(spark, spec, root, seed=3, parts=4)
    source = delimited.read_delimited(spark, data, spec.struct, catalog.TEXT_SEP)
    assert source.count() == spec.rows
    catalog.text_to_text(spark, spec, data, f"{root}/text")
    catalog.text_to_catalog(spark, spec, data)
    catalog.catalog_to_text(spark, spec, f"{root}/from-table")
    catalog.catalog_to_catalog(spark, spec)
    for result in (
        delimited.read_delimited(spark, f"{root}/text", spec.struct, "\t"),
        catalog.load_catalog(spark, spec.qualified),
        delimited.read_delimited(spark, f"{root}/from-table", spec.struct, "\t"),
        catalog.load_catalog(spark, spec.qualified + "_copy"),
    ):
        assert result.columns == ["who", "spent", "act", "test"]
        assert result.exceptAll(source).count() == 0
        assert result.count() == spec.rows
    sizes = catalog.partition_sizes(spark, spec.qualified)
    assert sizes.count() == catalog.list_partitions(spark, spec.qualified).count() == 12
    assert sizes.agg(F.sum("n_rows")).first()[0] == spec.rows


def test_storing_twice_appends(spark, spec, root):
    data = catalog.set_up(spark, spec, root, seed=3, parts=2)
    catalog.text_to_catalog(spark, spec, data)
    catalog.text_to_catalog(spark, spec, data)
    assert catalog.load_catalog(spark, spec.qualified).count() == 2 * spec.rows
    with pytest.raises(catalog.RowCountError):
        catalog.catalog_to_text(spark, spec, f"{root}/twice")


def test_benchmark_runs(spark, spec, root):
    runs = load_store.run_load_store(spark, spec, "visits.xml", root, runs=2, seed=3, parts=2)
    got = runs.groupBy("file", "tag").count().collect()
    assert {(r.file, r.tag, r["count"]) for r in got} == {
        ("visits.xml", tag, 2) for tag in load_store.JOBS
    }
    assert runs.filter("elapsed_ms <= 0").count() == 0
    document = reports.load_store_report(runs).first()["document"]
    assert set(json.loads(document)["visits.xml"]) == set(load_store.JOBS)
    assert not spark.catalog.tableExists(spec.qualified)


def test_managed_table_loses_its_files_when_dropped(spark, spec, root):
    data = catalog.set_up(spark, spec, root, seed=3, parts=2)
    catalog.text_to_catalog(spark, spec, data)
    catalog.clean_up(spark, spec)
    catalog.create_table(spark, spec)
    assert catalog.load_catalog(spark, spec.qualified).count() == 0


def test_existing_output_is_not_generated_again(spark, spec, root):
    catalog.generate_if_missing(spark, spec, f"{root}/data", seed=1, parts=1)
    before = sorted(r[0] for r in delimited.read_lines(spark, f"{root}/data").collect())
    catalog.generate_if_missing(spark, spec, f"{root}/data", seed=2, parts=1)
    assert sorted(r[0] for r in delimited.read_lines(spark, f"{root}/data").collect()) == before


def test_partition_pruning(spark, spec, root, plan):
    data = catalog.set_up(spark, spec, root, seed=3, parts=2)
    catalog.text_to_catalog(spark, spec, data)
    scan = catalog.load_catalog(spark, spec.qualified).filter("act = 1").select("who")
    text = plan(scan)
    assert "PartitionFilters: [isnotnull(act" in text
    assert "ReadSchema: struct<who:string>" in text
    assert len({f.split("act=")[1][0] for f in scan.inputFiles()}) == 1


def test_add_partition_twice(spark, spec, root):
    catalog.create_table(spark, spec, f"{root}/table")
    for _ in range(2):
        catalog.add_partition(spark, spec.qualified, {"act": 7, "test": "it's"})
    assert [r[0] for r in catalog.list_partitions(spark, spec.qualified).collect()] == [
        "act=7/test=it%27s"
    ]


def test_describe_and_drop(spark, spec, root):
    catalog.create_table(spark, spec, f"{root}/table")
    described = catalog.describe_table(spark, spec.qualified)
    assert {"who", "spent", "act", "test"} <= {r.col_name for r in described.collect()}
    assert catalog.drop_table(spark, spec.qualified)
    assert catalog.drop_table(spark, spec.qualified)
    assert not spark.catalog.tableExists(spec.qualified)
    assert not catalog.drop_table(spark, "no.such.catalog.table")


def test_row_count_check(spark, root):
    df = spark.range(50)
    assert catalog.check_row_count(df, 50, lambda d: d.write.parquet(f"{root}/a")) == 50
    with pytest.raises(catalog.RowCountError, match="expected 51"):
        catalog.check_row_count(df, 51, lambda d: d.write.parquet(f"{root}/b"))
    half = lambda d: d.limit(25).write.parquet(f"{root}/half")
    with pytest.raises(catalog.RowCountError, match="got 25"):
        catalog.check_row_count(df, 50, half, lambda: spark.read.parquet(f"{root}/half").count())
    stored = lambda: spark.read.parquet(f"{root}/c").count()
    doubled = df.union(df)
    assert catalog.check_row_count(doubled, 50, lambda d: d.distinct().write.parquet(f"{root}/c"), stored) == 50


def test_pipelines_count_what_is_stored(spark, root, monkeypatch):
    """A write that loses rows fails, also where rows are appended to others."""
    lossy = TableSpec("lossy", "default", (("a", ColSpec("long")),), rows=100)
    spark.range(100).selectExpr("id AS a").write.option("sep", "\t").csv(f"{root}/lossy")
    catalog.create_table(spark, lossy, f"{root}/lossy_table")
    catalog.text_to_catalog(spark, lossy, f"{root}/lossy")
    catalog.text_to_catalog(spark, lossy, f"{root}/lossy")  # another hundred
    write = catalog.store_catalog
    monkeypatch.setattr(catalog, "store_catalog", lambda df, name: write(df.filter("a < 50"), name))
    with pytest.raises(catalog.RowCountError, match="got 50"):
        catalog.text_to_catalog(spark, lossy, f"{root}/lossy")
    text = catalog.write_delimited
    monkeypatch.setattr(catalog, "write_delimited", lambda df, path, **kw: text(df.filter("a < 50"), path, **kw))
    with pytest.raises(catalog.RowCountError, match="got 50"):
        catalog.text_to_text(spark, lossy, f"{root}/lossy", f"{root}/lossy_out")
    catalog.drop_table(spark, lossy.qualified)


def test_unfinished_data_is_generated_anew(spark, root):
    made = TableSpec("made", "default", (("a", ColSpec("long", cardinality=5)),), rows=20)
    path = f"{root}/unfinished"
    spark.range(3).selectExpr("CAST(id AS STRING) AS v").write.text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    marker = hadoop(path, "_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).delete(marker, False)
    catalog.generate_if_missing(spark, made, path)
    assert spark.read.text(path).count() == 20
    catalog.generate_if_missing(spark, replace_rows(made, 30), path)  # finished: left alone
    assert spark.read.text(path).count() == 20


def replace_rows(spec, rows):
    return TableSpec(spec.name, spec.database, spec.columns, spec.partitions, rows)
