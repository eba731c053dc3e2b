"""Equi-joins. Null keys never match; hot keys and null keys are spread over tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlog.operators.key_filter import drop_unmatched
from viewlog.operators.table_sizes import OVERHEAD, known_size

# A side is broadcast only if its measured size stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more rows than this is cut into parts of that size; fewer fit one task.
HOT_ROWS = 5_000_000
# The row limit rises with the input so that no more keys than this can be hot. The list of
# them is broadcast: a few megabytes at most.
HOT_LIST_LIMIT = 200_000
# Keys that a sketch of frequent ones keeps, about 1.5 MB; the sketches of all tasks meet in this
# many groups first. A key with more than 3 / SKETCH_KEYS of the rows is never missed.
SKETCH_KEYS = 65_536
SKETCH_GROUPS = 64
HOT_SCHEMA = "__hash bigint, __parts int"
# Rows without a key match nothing; they are dealt over this many parts.
NULL_PARTS = 1_000_003
SALT = "__salt"


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of a side's size in memory, from its actual values in one aggregate.

    Columns of fixed width count by their type and are not read.
    """
    per_row = F.lit(OVERHEAD).cast("bigint")
    for field in df.schema:
        if isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            per_row += 2 * OVERHEAD
        else:
            value = F.col(f"`{field.name}`")
            value = value if isinstance(field.dataType, (T.StringType, T.BinaryType)) else value.cast("string")
            per_row += OVERHEAD + F.coalesce(F.octet_length(value), F.lit(0))
    return df.agg(F.sum(per_row).alias("n")).first()["n"] or 0


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a side stays below the limit: from the catalog where that is enough, else measured."""
    known = known_size(df).bytes
    return (known is not None and known <= limit) or measured_bytes(df) <= limit


def join_inner(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join; Spark picks the strategy from sizes it sees at run time."""
    return left.join(right, left[left_key] == right[right_key], "inner")


def join_replicated(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    spread_by: Column | None = None,
) -> DataFrame:
    """Join with the right side in the memory of every task, if it measures small enough.

    The left side then needs no shuffle and its hot keys do no harm. A right side beyond
    the limit is joined by :func:`join_skewed_key`, which cuts hot keys; an inner join then drops
    left rows without a partner before they are shuffled.
    """
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), left[left_key] == right[right_key], how)
    return join_skewed_key(left, right, left_key, right_key, how, spread_by=spread_by, prefilter=how == "inner")


def semi_join_set(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows whose key is a member of the right side; its duplicates do not multiply.

    Members are reduced to a row per key, on the map side first: Spark splits a hot key of the
    left side of such a join when it runs, but never one of the right side.
    """
    members = right.select(F.col(right_key).alias("__member")).filter("__member IS NOT NULL").distinct()
    return left.join(members, left[left_key] == F.col("__member"), "left_semi")


def join_left_outer(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    spread_by: Column | None = None,
) -> DataFrame:
    """All left rows, with the right side's columns or nulls."""
    return join_replicated(left, right, left_key, right_key, "left", spread_by=spread_by)


def join_merge(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    spread_by: Column | None = None,
    bucketed: bool = False,
) -> DataFrame:
    """Inner sort-merge join.

    With ``bucketed`` both sides are tables bucketed and sorted by the key
    (:func:`viewlog.operators.ordering.write_bucketed`) and join as they lie, without a shuffle,
    hot keys or not. Other inputs are shuffled, with hot keys cut.
    """
    if bucketed:
        return left.join(right.hint("merge"), left[left_key] == right[right_key], "inner")
    return join_skewed_key(
        left, right, left_key, right_key, "inner", merge=True, spread_by=spread_by
    )


def key_profile(df: DataFrame, key: str, hot_rows: int, list_limit: int = HOT_LIST_LIMIT) -> tuple[int, list]:
    """Row count, and (hash, parts) of the keys with more than ``hot_rows`` rows, in one pass.

    A sketch of frequent hashes is made where rows are read; only sketches are shuffled. It counts
    a key too high by at most 1.4 / ``SKETCH_KEYS`` of the rows, so the row limit rises with the input to
    where it misses none, and to where no more than ``list_limit`` keys can be hot. Parts only say
    how rows are dealt, so counts need not be exact. Keys that share a hash are dealt alike on both
    sides of a join, which changes nothing in what they match.
    """
    hashed = F.when(F.col(key).isNotNull(), F.xxhash64(key))
    seen = df.select(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("__group"), hashed.alias("__hash"))
    counted = F.expr(f"approx_top_k_accumulate(__hash, {SKETCH_KEYS}) FILTER (WHERE __hash IS NOT NULL)")
    some = seen.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), counted.alias("sketch"))
    # By a constant key, as an empty task of an aggregate without keys has no sketch to give.
    whole = some.groupBy(F.lit("all")).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {SKETCH_KEYS})").alias("sketch"))
    items = F.expr(f"approx_top_k_estimate(sketch, {SKETCH_KEYS})")
    limit = F.greatest(F.lit(hot_rows), F.col("n") / list_limit, F.col("n") * 3 / SKETCH_KEYS)
    hot = F.filter(items, lambda item: item["item"].isNotNull() & (item["count"] > limit))
    listed = F.transform(
        hot,
        lambda item: F.struct(
            item["item"].alias("__hash"),
            F.least(F.ceil(item["count"] / hot_rows), F.lit(NULL_PARTS)).cast("int").alias("__parts"),
        ),
    )
    found = whole.select("n", F.when(F.col("n") > hot_rows, listed).alias("listed")).collect()
    return (found[0]["n"], found[0]["listed"] or []) if found else (0, [])


def join_skewed_key(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    merge: bool = False,
    spread_by: Column | None = None,
    list_limit: int = HOT_LIST_LIMIT,
    prefilter: bool = False,
) -> DataFrame:
    """Inner or left outer join in which no key, and not null either, lands in one task whole.

    Rows of a hot left key get a part number and the right rows of that key are repeated once
    per part; all other keys keep part 0. Keys hot on the right are joined apart, with parts on
    both sides: every left row of such a key has a partner, so that join is inner for either
    kind. A null key can match nothing, so its rows are spread freely. Inputs of at most
    ``hot_rows`` rows have no hot key and are joined directly, as are larger ones in which none
    is found (for a left join, null keys are spread all the same).
    ``spread_by`` is what parts are dealt by: by default a hash of the left row's columns; give
    an id where many rows agree in all of them. Key columns of both sides are kept.

    Each side is read once more to find its hot keys (:func:`key_profile`), and not at all if the
    catalog says that it is small. ``prefilter`` drops left rows of an inner join that have no
    partner before they are shuffled (:func:`viewlog.operators.key_filter.drop_unmatched`).
    """
    if how not in ("inner", "left"):
        raise ValueError(f"cannot spread a {how} join")
    right_rows, right_listed = _profile(right, right_key, hot_rows, list_limit)
    if prefilter and how == "inner":
        left = drop_unmatched(left, right, left_key, right_key, right_rows)
    rows, listed = _profile(left, left_key, hot_rows, list_limit)
    if right_listed:
        return _join_hot_right(
            left, right, left_key, right_key, how, listed, right_listed, merge, spread_by
        )
    if not listed and (how == "inner" or rows <= hot_rows):
        right = right.hint("merge") if merge else right
        return left.join(right, left[left_key] == right[right_key], how)
    return _join_hot_left(left, right, left_key, right_key, how, listed, merge, spread_by)


def _profile(df: DataFrame, key: str, hot_rows: int, list_limit: int) -> tuple[int, list]:
    """Rows (or a bound of them) and hot keys; a side the catalog knows to be small has none."""
    known = known_size(df).rows
    return (known, []) if known is not None and known <= hot_rows else key_profile(df, key, hot_rows, list_limit)


def _join_hot_right(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str,
    listed: list,
    right_listed: list,
    merge: bool,
    spread_by: Column | None,
) -> DataFrame:
    """Keys hot on the right in parts of both sides; all others as if the right had no hot key."""
    left_parts = {r["__hash"]: r["__parts"] for r in listed}
    grid = [(r["__hash"], left_parts.get(r["__hash"], 1), r["__parts"]) for r in right_listed]
    hot = left.sparkSession.createDataFrame(grid, "__hash bigint, __lefts int, __rights int")
    hot = F.broadcast(hot)

    def bits(df: DataFrame, by: Column | None) -> Column:
        return F.shiftrightunsigned(F.xxhash64(by) if by is not None else row_hash(df), 1)

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    a = left.join(hot, F.xxhash64(left[left_key]) == hot["__hash"])
    a = a.withColumn("__a", (bits(left, spread_by) % F.col("__lefts")).cast("int"))
    a = a.withColumn("__b", every("__rights")).drop("__hash", "__lefts", "__rights")
    b = right.join(hot, F.xxhash64(right[right_key]) == hot["__hash"])
    b = b.withColumn("__d", (bits(right, None) % F.col("__rights")).cast("int"))
    b = b.withColumn("__c", every("__lefts")).drop("__hash", "__lefts", "__rights")
    together = a.join(
        b.hint("merge") if merge else b,
        (a[left_key] == b[right_key]) & (a["__a"] == b["__c"]) & (a["__b"] == b["__d"]),
    ).drop("__a", "__b", "__c", "__d")
    # A key that only shares its hash with a hot one has no partner there; a left join keeps it.
    missed = None
    if how == "left":
        partners = right.join(hot, F.xxhash64(right[right_key]) == hot["__hash"], "left_semi")
        known = partners.select(F.col(right_key).alias("__known")).distinct()
        hot_left = left.join(hot, F.xxhash64(left[left_key]) == hot["__hash"], "left_semi")
        alone = hot_left.join(known, hot_left[left_key] == F.col("__known"), "left_anti")
        missed = alone.join(right.limit(0), F.lit(False), "left")
    rest_left = left.join(hot, F.xxhash64(left[left_key]) == hot["__hash"], "left_anti")
    rest_right = right.join(hot, F.xxhash64(right[right_key]) == hot["__hash"], "left_anti")
    kept = [r for r in listed if r["__hash"] not in {h for h, _, _ in grid}]
    rest = _join_hot_left(rest_left, rest_right, left_key, right_key, how, kept, merge, spread_by)
    parts = [together, rest, *([missed] if missed is not None else [])]
    return reduce(DataFrame.union, parts)


def _join_hot_left(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str,
    listed: list,
    merge: bool,
    spread_by: Column | None,
) -> DataFrame:
    hot = F.broadcast(left.sparkSession.createDataFrame(listed, HOT_SCHEMA)) if listed else None
    bits = F.shiftrightunsigned(F.xxhash64(spread_by) if spread_by is not None else row_hash(left), 1)
    salted_left = _salt_left(left, left_key, hot, bits)
    salted_right = _salt_right(right, right_key, hot)
    salted_right = salted_right.hint("merge") if merge else salted_right
    joined = salted_left.join(
        salted_right,
        (salted_left[left_key] == salted_right[right_key])
        & (salted_left[SALT] == salted_right["__part"]),
        how,
    )
    return joined.drop(SALT, "__part")


def _salt_left(df: DataFrame, key: str, hot: DataFrame | None, bits: Column) -> DataFrame:
    """Rows with a part number that depends on the row's content and nothing else.

    Being a function of the row, it comes out the same when a lost task is run again.
    """
    part = F.lit(0)
    marked = df
    if hot is not None:
        marked = df.join(hot, F.xxhash64(df[key]) == hot["__hash"], "left")
        part = F.coalesce((bits % F.col("__parts")).cast("int"), part)
    salt = F.when(df[key].isNull(), (bits % F.lit(NULL_PARTS)).cast("int")).otherwise(part)
    return marked.withColumn(SALT, salt).drop("__hash", "__parts")


def row_hash(df: DataFrame) -> Column:
    """Hash over all columns that can be hashed (maps cannot)."""
    return F.xxhash64(*[f"`{f.name}`" for f in df.schema if "map" not in f.dataType.simpleString()])


def _salt_right(df: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Rows of hot keys once per part, all others once."""
    if hot is None:
        return df.withColumn("__part", F.lit(0))
    marked = df.join(hot, F.xxhash64(df[key]) == hot["__hash"], "left")
    parts = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    return marked.withColumn("__part", F.explode(parts)).drop("__hash", "__parts")


def join_then_sum(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, measure: str, alias: str
) -> DataFrame:
    """Inner join on a key, then the sum of a left column by that key.

    Both sides are reduced to one row per key before they meet, so a hot key reaches the
    join as a single row, and one shuffle by key serves the aggregate and the join. A key
    that comes n times on the right counts n times.
    """
    sums = (
        left.filter(F.col(left_key).isNotNull())
        .groupBy(F.col(left_key).alias("__left"))
        .agg(F.sum(measure).alias("__sum"))
    )
    copies = (
        right.filter(F.col(right_key).isNotNull())
        .groupBy(F.col(right_key).alias("__right"))
        .agg(F.count(F.lit(1)).alias("__copies"))
    )
    return sums.join(copies, F.col("__left") == F.col("__right")).select(
        F.col("__left").alias(left_key), (F.col("__sum") * F.col("__copies")).alias(alias)
    )


def anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct left keys that have no partner on the right.

    The null key groups of both sides stay apart: a null left key has no partner, and a
    null right key is a group whose key counts as absent, so each gives one null row.
    """
    keys = left.select(F.col(left_key)).distinct()
    partners = right.select(F.col(right_key).alias("__partner")).filter("__partner is not null")
    alone = keys.join(partners.distinct(), keys[left_key] == F.col("__partner"), "left_anti")
    null_groups = right.filter(F.col(right_key).isNull()).select(F.col(right_key).alias(left_key))
    return alone.unionByName(null_groups.distinct())


def cogroup(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_aggs: list[Column],
    right_aggs: list[Column],
    alias: str = "key",
) -> DataFrame:
    """Both inputs grouped by key side by side, each already reduced to its aggregates.

    Every key of either side gives one row; a side without the key gives nulls. The null
    keys of the two sides do not meet.
    """
    a = left.groupBy(F.col(left_key).alias("__left")).agg(*left_aggs)
    b = right.groupBy(F.col(right_key).alias("__right")).agg(*right_aggs)
    joined = a.join(b, F.col("__left") == F.col("__right"), "full")
    return joined.withColumn(alias, F.coalesce("__left", "__right")).drop("__left", "__right")
