"""The load/store benchmark: the four jobs between text and catalog tables, timed."""

from __future__ import annotations

import time
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from viewlog.schema import TableSpec
from viewlog.sources import catalog
from viewlog.sources.specs import read_table_specs

RUN_SCHEMA = "file string, tag string, elapsed_ms double"

# In the order they run: the later ones read the table the first one fills.
JOBS = {
    "text_to_catalog": lambda spark, spec, data, out: catalog.text_to_catalog(spark, spec, data),
    "catalog_to_text": lambda spark, spec, data, out: catalog.catalog_to_text(
        spark, spec, f"{out}/from_catalog", mode="overwrite"
    ),
    "text_to_text": lambda spark, spec, data, out: catalog.text_to_text(
        spark, spec, data, f"{out}/from_text", mode="overwrite"
    ),
    "catalog_to_catalog": lambda spark, spec, data, out: catalog.catalog_to_catalog(spark, spec),
}


def run_load_store(
    spark: SparkSession,
    spec: TableSpec,
    file: str,
    root: str,
    runs: int = 3,
    seed: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """Time each job ``runs`` times on fresh tables; rows are (file, tag, elapsed_ms).

    Input data is generated once, below ``root``. Every job must write as many rows as the
    spec says. Tables are dropped after each run, whether it failed or not.
    """
    timings = []
    for _ in range(runs):
        try:
            data = catalog.set_up(spark, spec, root, seed, parts)
            for tag, job in JOBS.items():
                start = time.perf_counter()
                job(spark, spec, data, f"{root}/output/{spec.name}")
                timings.append((file, tag, (time.perf_counter() - start) * 1000))
        finally:
            catalog.clean_up(spark, spec)
    return spark.createDataFrame(timings, RUN_SCHEMA)


def run_spec_file(
    spark: SparkSession,
    path: str,
    root: str,
    runs: int = 3,
    seed: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """:func:`run_load_store` for every table of a spec file.

    With one table the rows carry the file's name, with several ``file/table``.
    """
    specs, file = read_table_specs(spark, path), path.rsplit("/", 1)[-1]
    found = [
        run_load_store(
            spark, spec, file if len(specs) == 1 else f"{file}/{spec.name}", root, runs, seed, parts
        )
        for spec in specs
    ]
    if not found:
        return spark.createDataFrame([], RUN_SCHEMA)
    return reduce(DataFrame.unionByName, found)


def run_spec_files(
    spark: SparkSession,
    paths: Mapping[str, int],
    root: str,
    seed: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """:func:`run_spec_file` for several files, each with its number of runs."""
    found = [run_spec_file(spark, path, root, runs, seed, parts) for path, runs in paths.items()]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], RUN_SCHEMA))
