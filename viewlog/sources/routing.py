"""One result to several directories, in one pass over it."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlog.sources.delimited import as_line

ROUTE = "__route"
MODES = ("errorifexists", "overwrite", "append")


def routed_lines(df: DataFrame, routes: Mapping[str, tuple[Column, list[str]]], sep: str = "\t") -> DataFrame:
    """(line, number of the route): a line for each route a row meets, in the route's own columns."""
    met = F.array(
        *[
            F.when(predicate, F.struct(as_line(df, names, sep).alias("line"), F.lit(number).alias(ROUTE)))
            for number, (predicate, names) in enumerate(routes.values())
        ]
    )
    one = df.select(F.explode(F.filter(met, lambda line: line.isNotNull())).alias("r"))
    return one.select("r.line", f"r.{ROUTE}")


def route_write(
    df: DataFrame,
    routes: Mapping[str, tuple[Column, list[str]]],
    sep: str = "\t",
    mode: str = "errorifexists",
) -> None:
    """Write the rows that satisfy each predicate to its directory, with the named columns only.

    ``routes`` maps a directory to (predicate, columns to store); routes may overlap. The source
    is read once, whatever the number of routes, and nothing of it is kept: each row becomes a
    line per route it meets, and one write deals the lines to a folder per route beside the
    targets. When all lines are there, the folders become the targets, a rename each; a write
    that fails before leaves every target as it was. All targets lie in one file system. A route
    without rows gets an empty directory. Unless ``mode`` says otherwise, an existing directory
    fails the call before any row is written.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if not routes:
        return
    spark, targets = df.sparkSession, list(routes)
    taken = [path for path in targets if mode == "errorifexists" and _exists(spark, path)]
    if taken:
        raise FileExistsError(f"output directories exist: {taken}")
    if len({_files(spark, path).getUri().toString() for path in targets}) > 1:
        raise ValueError("routes must lie in one file system")
    staging = f"{targets[0].rstrip('/').rpartition('/')[0]}/_routes-{uuid.uuid4().hex[:12]}"
    lines = routed_lines(df, routes, sep)
    # A task writes one file per route, so a route of most rows is as many files as tasks.
    lines.write.partitionBy(ROUTE).text(staging)
    for number, target in enumerate(targets):
        _attach(spark, f"{staging}/{ROUTE}={number}", target, mode)
    _files(spark, staging).delete(_path(spark, staging), True)


def _attach(spark: SparkSession, folder: str, target: str, mode: str) -> None:
    """Make a written folder the target, or add its files to it, and mark it as finished."""
    files, source, goal = _files(spark, target), _path(spark, folder), _path(spark, target)
    if mode == "overwrite":
        files.delete(goal, True)
    if files.exists(source):
        if files.exists(goal):  # file names hold the id of their write, so none is taken
            for file in files.listStatus(source):
                _moved(files, file.getPath(), _path(spark, f"{target}/{file.getPath().getName()}"))
        else:
            files.mkdirs(goal.getParent())
            _moved(files, source, goal)
    else:
        files.mkdirs(goal)
    files.create(_path(spark, f"{target}/_SUCCESS"), True).close()


def _moved(files, source, goal) -> None:
    if not files.rename(source, goal):
        raise OSError(f"could not move {source} to {goal}")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def route_by_value(df: DataFrame, key: str, path: str) -> None:
    """Write each value of ``key`` to its own ``key=value`` directory in a single pass.

    For routes that do not overlap: nothing is kept in between, and the routing column is
    not stored in the files. The rebalance cuts a route that holds most rows into several files.
    """
    df.hint("rebalance", key).write.partitionBy(key).mode("errorifexists").parquet(path)
