"""Ranges measured once from quantile sketches, kept beside a table and used by later sorts.

An order key is written as digits, bigints whose order is that of the key: six bytes of a text
and their number, or the high and low bits of an integer. A sketch of the first digit gives the
bounds; a digit that holds more than a quarter of a range is looked at one digit deeper, and a
key that is hot as a whole is cut by a hash of the row. Nulls come first.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlog.operators.joins import row_hash

BLOCK = 6
TEXT_BYTES = 30
SKETCH_K = 4096
LOWEST = -(2**62)
HEAVY = 0.25
# Points of a sketch that are looked at for each range.
GRID = 16


def key_digits(df: DataFrame, *keys: str, text_bytes: int = TEXT_BYTES) -> list[Column]:
    """The digits of each row; the last one cuts equal keys.

    Texts that agree in their first ``text_bytes`` bytes and go on stay together: their later
    digits are 0, so an order by these digits never contradicts that of the keys.
    """
    whole, digits = F.lit(True), []
    for key in keys:
        kind, value = df.schema[key].dataType, F.col(f"`{key}`")
        if isinstance(kind, T.IntegralType):
            number = value.cast("bigint")
            own = [F.shiftright(number, 8), number.bitwiseAND(F.lit(255).cast("bigint"))]
            ended = F.lit(True)
        elif isinstance(kind, T.StringType):
            raw = F.encode(value, "utf-8")
            own = []
            for start in range(0, text_bytes, BLOCK):
                part = F.hex(F.substring(raw, start + 1, BLOCK))
                count = F.lpad(F.hex(F.length(part) / 2), 2, "0")
                own.append(F.conv(F.concat(F.rpad(part, 2 * BLOCK, "0"), count), 16, 10).cast("bigint"))
            ended = F.coalesce(F.octet_length(value) <= text_bytes, F.lit(True))
        else:
            raise TypeError(f"{key}: no digits for {kind.simpleString()}")
        digits += [F.when(whole, F.coalesce(d, F.lit(LOWEST))).otherwise(0) for d in own]
        whole = whole & ended
    return [*digits, F.when(whole, row_hash(df)).otherwise(0)]


def measure_bounds(df: DataFrame, parts: int, *keys: str, k: int = SKETCH_K) -> list[tuple[int, ...]]:
    """The first digits of every range but the first: one pass, and one more for each depth of heavy
    digits. At most ``4 * parts`` heavy digits of a depth and the bounds are on the driver.
    """
    digits = key_digits(df, *keys)
    names = [f"d{i}" for i in range(len(digits))]
    rows = df.select(*[d.alias(n) for d, n in zip(digits, names, strict=True)])
    spark, last = df.sparkSession, len(names) - 1
    total: int | None = None
    heavy: dict[tuple[int, ...], tuple[float, list[float]]] = {}
    found: list[tuple[int, ...]] = []
    for depth in range(last):
        before = names[:depth]
        if depth:
            schema = ", ".join(f"{n} bigint" for n in before)
            rows = rows.join(F.broadcast(spark.createDataFrame(list(heavy), schema)), before)
        sketches = rows.groupBy(*before).agg(
            F.kll_sketch_agg_bigint(names[depth], F.lit(k)).alias("s"), F.count(F.lit(1)).alias("n")
        )
        largest = max((n for n, _ in heavy.values()), default=1) if total else 1
        grid = math.ceil(GRID * parts * largest / (total or 1))
        at = F.array(*[F.lit((j + 0.5) / grid) for j in range(grid)])
        values = F.call_function("kll_sketch_get_quantile_bigint", "s", at)
        sketches = sketches.filter("n > 0").withColumn("q", values)
        deeper: dict[tuple[int, ...], tuple[float, list[float]]] = {}
        for row in sketches.drop("s").collect():
            if total is None:
                total = row["n"]
                heavy = {(): (total, [i * total / parts for i in range(1, parts)])}
            prefix = tuple(row[n] for n in before)
            (_, ranks), n, q = heavy[prefix], row["n"], row["q"]
            for rank in ranks:
                value = q[max(0, min(grid - 1, int(rank / n * grid)))]
                low, upto = (side(q, value) / grid for side in (bisect_left, bisect_right))
                share = (upto - low) * n
                if share * parts > HEAVY * total:
                    deeper.setdefault((*prefix, value), (share, []))[1].append(rank - low * n)
                else:
                    found.append((*prefix, value))
        if total is None:
            return []
        heavy = deeper
        if not heavy:
            break
    for prefix, (n, ranks) in heavy.items():
        found += [(*prefix, int((min(1.0, max(0.0, r / n)) - 0.5) * (2**64 - 2**12))) for r in ranks]
    lowest = -(2**63)
    return sorted({b + (lowest,) * (last + 1 - len(b)) for b in found})


def store_bounds(spark: SparkSession, bounds: list[tuple[int, ...]], path: str) -> None:
    spark.createDataFrame([(list(b),) for b in bounds], "digits array<bigint>").coalesce(1).write.parquet(path)


def load_bounds(spark: SparkSession, path: str) -> list[tuple[int, ...]]:
    return sorted(tuple(row["digits"]) for row in spark.read.parquet(path).collect())


def order_by_bounds(df: DataFrame, bounds: list[tuple[int, ...]], *keys: str) -> DataFrame:
    """Total order by stored bounds: the input is read once. Right for any rows and bounds; ranges
    are even for rows like those measured. A row finds its range by halving.
    """
    if not bounds:
        return df.coalesce(1).sortWithinPartitions(*[F.col(f"`{k}`").asc_nulls_first() for k in keys])
    text = "[" + ",".join(str(list(b)) for b in bounds) + "]"
    table = F.from_json(F.lit(text), "array<array<bigint>>")
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
    own = F.array(*key_digits(df, *keys))

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.get(table, at + step - 1) <= F.col("__own"), at + step).otherwise(at)

    placed = df.withColumn("__own", own).withColumn("__range", F.aggregate(steps, F.lit(0), halve))
    ranges = placed.repartitionById(len(bounds) + 1, F.col("__range")).drop("__own", "__range")
    return ranges.sortWithinPartitions(*[F.col(f"`{k}`").asc_nulls_first() for k in keys])
