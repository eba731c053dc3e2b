"""Left rows without a partner, dropped before the shuffle of a large join.

The keys of the right side set bits of one bitmap by their hash; it is broadcast, and left rows whose
bit is not set cannot match. Its size is fixed by ``bits`` (16 MiB at most), whatever the sides
hold; a few rows without a partner pass, one in 16 with as many bits as 16 times the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BITS = 1 << 27
LEAST_BITS = 1 << 15
BITS_PER_KEY = 16
# Beyond as many keys as a quarter of the bits, most rows would pass: the filter is left out.
LEAST_SPARE = 4
# Types whose equal values always have equal hashes.
SAFE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType, T.DecimalType)


def bits_for(keys: int) -> int | None:
    """A power of two of bits for so many keys, or None where a filter would not pay."""
    if keys * LEAST_SPARE > MOST_BITS:
        return None
    return max(LEAST_BITS, min(MOST_BITS, 1 << (keys * BITS_PER_KEY - 1).bit_length() if keys else LEAST_BITS))


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def key_bits(right: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, seen): 4 KB of bits per bucket, ``bits`` / 32,768 buckets at most."""
    place = _place(right[key], bits)
    known = right.filter(right[key].isNotNull())
    return known.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__seen")
    )


def can_filter(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> bool:
    kind = left.schema[left_key].dataType
    return kind == right.schema[right_key].dataType and isinstance(kind, SAFE)


def drop_unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str, keys: int) -> DataFrame:
    """Left rows that may have a partner, without a shuffle of the left side.

    ``keys`` is an upper bound of the right side's rows. For joins that keep no left row without
    a partner; null keys go too. Sides with keys of unlike types are left as they are.
    """
    bits = bits_for(keys)
    if bits is None or not can_filter(left, right, left_key, right_key):
        return left
    seen = key_bits(right, right_key, bits)
    place = _place(left[left_key], bits)
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__seen", (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = F.expr("shiftright(__byte, __bit) & 1") == 1
    joined = left.join(F.broadcast(seen), F.bitmap_bucket_number(place) == F.col("__bucket"))
    marked = joined.withColumns({"__byte": byte, "__bit": (position % 8).cast("int")})
    return marked.filter(met & left[left_key].isNotNull()).select(*[left[f"`{c}`"] for c in left.columns])
