"""Sums of doubles that are the same bit for bit in any order: exact, and rounded once.

A double is a 53-bit integer times a power of two. Integers are shifted to the next lower power
that is a multiple of ``BITS`` (their bin), cut into limbs, and added up as longs by key and bin:
integer sums do not depend on their order or grouping, so neither does any partial sum. A key has
as many bins as its values span multiples of 2^24, 92 at most. The bins of a key are then added
with carries into digits of one long number, which is rounded to the nearest double, ties to even.

Limbs hold 25 bits, so a key may have 2^38 rows in one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24
LIMB, HALF = 25, 27  # bits of a limb; bits of the lower half of the integer
# Digits beyond the highest bin that carries of 2^63 rows can reach.
MORE_DIGITS = 6
WIDE = "decimal(38,0)"


def _parts(value: Column) -> tuple[Column, Column, Column]:
    """Sign, integer below 2^53, and the power of its last bit, of a finite double other than 0."""
    size = F.abs(value)
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1074)), F.lit(1023)).cast("int")
    scaled = size / F.pow(F.lit(2.0), guess)
    # The logarithm may be off by one next to a power of two.
    power = guess + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
    scaled = F.when(scaled >= 2, scaled / 2).when(scaled < 1, scaled * 2).otherwise(scaled)
    return F.signum(value).cast("bigint"), (scaled * float(2**52)).cast("bigint"), power - 52


def exact_sum(df: DataFrame, by: list[str], value: str, alias: str) -> DataFrame:
    """One row per key with the exact sum of ``value``, rounded once; null without values.

    Infinities and NaN give what any addition gives. Rows are reduced on the map side to one per
    key and bin.
    """
    x = F.col(f"`{value}`").cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sign, whole, last = _parts(F.when(finite & (x != 0), x))
    rows = df.select(*by, x.alias("__x"), finite.alias("__finite"), sign.alias("__sign"), whole.alias("__whole"), last.alias("__last"))
    rows = rows.withColumn("__bin", F.floor(F.col("__last") / BITS).cast("int"))
    up = F.col("__last") - F.col("__bin") * BITS
    # Both halves are shifted apart, as the whole would not fit a long.
    low = F.expr(f"shiftleft(__whole & {2**HALF - 1}L, __up)")
    high = F.expr(f"shiftleft(shiftright(__whole, {HALF}), __up)")
    mask = F.lit(2**LIMB - 1).cast("bigint")
    rows = rows.withColumn("__up", up).withColumns({"__low": low, "__high": high})
    limbs = {
        "__a": F.col("__low").bitwiseAND(mask),
        "__b": F.shiftright("__low", LIMB),
        "__c": F.col("__high").bitwiseAND(mask),
        "__d": F.shiftright("__high", LIMB),
    }
    binned = rows.groupBy(*by, "__bin").agg(
        *[F.sum(F.col("__sign") * limb).alias(name) for name, limb in limbs.items()],
        F.sum(F.when(~F.col("__finite"), F.col("__x"))).alias("__odd"),
        F.count("__x").alias("__n"),
    )
    weights = {"__a": 1, "__b": 2**LIMB, "__c": 2**HALF, "__d": 2 ** (HALF + LIMB)}
    total = F.lit(0).cast(WIDE)
    for name, weight in weights.items():
        total = (total + (F.col(name).cast("decimal(19,0)") * F.lit(str(weight)).cast("decimal(16,0)")).cast("decimal(37,0)")).cast(WIDE)
    entry = F.when(F.col("__bin").isNotNull(), F.struct("__bin", total.alias("total")))
    grouped = binned.groupBy(*by).agg(
        F.collect_list(entry).alias("__bins"), F.sum("__odd").alias("__odd"), F.sum("__n").alias("__n")
    )
    result = F.when(F.col("__n") == 0, F.lit(None)).when(F.col("__odd").isNotNull(), F.col("__odd"))
    result = result.when(F.size("__bins") == 0, F.lit(0.0)).otherwise(F.col("__rounded"))
    return _rounded(grouped).select(*by, result.cast("double").alias(alias))


def _rounded(grouped: DataFrame) -> DataFrame:
    """The bins of each key as one double, in ``__rounded``."""
    grouped = grouped.withColumns(
        {
            "__limbs": F.map_from_entries("__bins"),
            "__first": F.array_min(F.col("__bins.__bin")),
            "__last": F.array_max(F.col("__bins.__bin")),
        }
    )
    base = 1 << BITS

    def digits(limbs: str) -> Column:
        total = f"(acc.carry + coalesce({limbs}[c], cast(0 as {WIDE})))"
        digit = f"pmod({total}, cast({base} as {WIDE}))"
        return F.expr(
            f"""aggregate(sequence(__first, __last + {MORE_DIGITS}),
              named_struct('carry', cast(0 as {WIDE}), 'digits', cast(array() as array<bigint>)),
              (acc, c) -> named_struct('carry', cast(({total} - {digit}) / {base} as {WIDE}),
                'digits', array_append(acc.digits, cast({digit} as bigint))))"""
        )

    # A negative sum borrows without end: its last carry is -1. Its digits are those of its negative.
    there = F.size("__bins") > 0
    found = grouped.withColumn("__sum", F.when(there, digits("__limbs")))
    found = found.withColumn("__negative", F.col("__sum.carry") < 0)
    flipped = F.expr("transform_values(__limbs, (k, v) -> cast(-v as decimal(38,0)))")
    found = found.withColumn("__flipped", F.when(F.col("__negative"), flipped))
    found = found.withColumn("__digits", F.when(F.col("__negative"), digits("__flipped")["digits"]).otherwise(F.col("__sum.digits")))
    # The four highest digits decide, and whether anything is below them.
    top = F.expr("array_max(transform(__digits, (d, i) -> if(d > 0, i, -1)))")
    found = found.withColumn("__top", top)
    lead = " + ".join(
        f"cast(coalesce(get(__digits, __top - {i}), 0L) as decimal(9,0)) * cast('{base ** (3 - i)}' as decimal(23,0))" for i in range(4)
    )
    found = found.withColumns(
        {
            "__lead": F.expr(f"cast({lead} as {WIDE})"),
            "__below": F.expr("exists(slice(__digits, 1, greatest(__top - 3, 0)), d -> d > 0)"),
            "__cut": F.expr(f"length(bin(get(__digits, __top))) + {3 * BITS} - 53"),
        }
    )
    found = found.withColumn("__unit", F.expr(f"cast(shiftleft(1L, __cut) as {WIDE})"))
    found = found.withColumn("__rest", F.expr("cast(pmod(__lead, __unit) as bigint)"))
    found = found.withColumn("__kept", F.expr(f"cast(cast((__lead - __rest) / __unit as {WIDE}) as bigint)"))
    half = F.expr("shiftleft(1L, __cut - 1)")
    up = (F.col("__rest") > half) | ((F.col("__rest") == half) & (F.col("__below") | (F.col("__kept") % 2 == 1)))
    kept = (F.col("__kept") + F.when(up, 1).otherwise(0)).cast("double")
    power = F.col("__cut") + BITS * (F.col("__first") + F.col("__top") - 3)
    # Powers below the normal range are reached in two steps, each exact.
    tiny = kept * F.pow(F.lit(2.0), power + 200) * float(2.0**-200)
    value = F.when(power < -900, tiny).otherwise(kept * F.pow(F.lit(2.0), power))
    signed = F.when(F.col("__negative"), -value).otherwise(value)
    return found.withColumn("__rounded", F.when(F.col("__top") < 0, F.lit(0.0)).otherwise(signed))


def exact_sum_sql(value: str) -> str:
    """SQL of the same sum for values between 2^-28 and 2^40: integers of 2^-80, rounded once."""
    total = f"sum(CAST({value} * 1208925819614629174706176.0::DOUBLE AS HUGEINT))"
    return f"""(SELECT CASE WHEN n = 0 THEN 0.0 WHEN cut <= 0 THEN CAST(n AS DOUBLE)
        ELSE sign(n) * CAST(kept + CASE WHEN rest * 2 > unit OR (rest * 2 = unit AND kept % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE)
          * pow(2.0, cut) END / 1208925819614629174706176.0::DOUBLE
      FROM (SELECT *, abs(n) // unit AS kept, abs(n) % unit AS rest
        FROM (SELECT *, CAST(pow(2.0, greatest(cut, 0)) AS HUGEINT) AS unit
          FROM (SELECT n, length(bin(abs(n))) - 53 AS cut FROM (SELECT {total} AS n)))))"""
