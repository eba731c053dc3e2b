"""Repeatable random draws as column expressions.

Every draw is a hash of (row key, seed, stream), so a value depends on its row alone:
the same seed gives the same data for any number of partitions, retries of a lost
task included, and nothing has to be shuffled or kept on the driver.

A cell needs intermediate results more than once (an index, a place, a code). A cell is
therefore written as a generator that yields each of them and gets back a reference:
:func:`add_columns` turns the yields of all columns into a few projections, and
:func:`inline` binds them inside the lambda of an array element.
"""

from __future__ import annotations

import math
from collections.abc import Generator
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlog.schema import ColSpec

# ---- fixed values: letters of random strings, sizes of maps and bags ----
FIRST_CHAR = 65  # 'A'
CHARS = 57  # 'A'..'y'
LENGTH_SPREAD = 0.3
MAP_KEYS = "abcdefghijklmnopqrstuvwxyz"
MAP_SIZE = (6, 25)
BAG_SIZE = (5, 9)
RANDOM_NUMBER_LIMIT = 2.0**31
# ---- end of fixed values ----

Cell = Generator[Column, Column, Column]

EULER_GAMMA = 0.57721566490153286
# All texts of two characters by their number; the first character is the lower digit.
TWO_CHARS = [
    chr(FIRST_CHAR + first) + chr(FIRST_CHAR + second)
    for second in range(CHARS)
    for first in range(CHARS)
]
CODE_CHARS = 10  # 57^10 is the largest power of 57 below 2^63
FLOAT_DOMAIN_LIMIT = 2**22


def salt(seed: int, column: int, purpose: int) -> int:
    """The stream number of one use of randomness in one column."""
    return (seed * 1_000_003 + column * 1_009 + purpose) % 2**62


# Purposes: one stream each, so that for example nulls do not depend on values.
NULLS, INDEX, SIZE, TEXT = 1, 2, 3, 4
# Elements of a bag draw from a column number no real column has.
ELEMENT_COLUMN = 500_000


def bits(key: Column, stream: int) -> Column:
    """63 random bits as a non-negative bigint."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(stream).cast("bigint")), 1)


def below(key: Column, stream: int, n: int) -> Column:
    """A uniform integer in [0, n)."""
    return bits(key, stream) % F.lit(n).cast("bigint")


def unit(key: Column, stream: int) -> Column:
    """A uniform double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(stream).cast("bigint")), 11) * F.lit(2.0**-53)


def harmonic(n: int) -> float:
    """1 + 1/2 + ... + 1/n."""
    if n < 200:
        return math.fsum(1 / k for k in range(1, n + 1))
    return math.log(n) + EULER_GAMMA + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)


def zipf_index(u: Column, cardinality: int) -> Cell:
    """Zipf rank with exponent 1, less one, from a uniform draw.

    The rank is the smallest k whose harmonic number reaches ``u`` times that of the
    cardinality. Small k are compared one by one; beyond them the harmonic number is
    inverted by its asymptotic series, whose error there is below 1e-8.
    """
    if cardinality == 1:
        return F.lit(0).cast("bigint")
    target = yield u * F.lit(harmonic(cardinality))
    y = yield F.exp(target - EULER_GAMMA)
    z = y * F.exp(-1 / (24 * y * y) + (7 / 960 - 1 / 288) / (y * y * y * y))
    rank = F.least(F.ceil(z - 0.5).cast("bigint"), F.lit(cardinality).cast("bigint")) - 1
    choice = F.when(target <= 1.0, F.lit(0).cast("bigint"))
    for k in range(2, min(cardinality, 12) + 1):
        choice = choice.when(target <= harmonic(k), F.lit(k - 1).cast("bigint"))
    return choice.otherwise(rank)


def index(spec: ColSpec, key: Column, stream: int) -> Cell:
    """Which of its ``cardinality`` values a cell takes."""
    if spec.distribution == "uniform":
        return below(key, stream, spec.cardinality)
    return (yield from zipf_index(unit(key, stream), spec.cardinality))


def string_lengths(avg: int) -> range:
    """Possible lengths of a random string with a given mean; the upper end is open."""
    if avg < 1:
        raise ValueError(f"a string column needs a mean length of at least 1, got {avg}")
    spread = max(1, int(avg * LENGTH_SPREAD))
    return range(avg - spread, avg + spread)


def length_shares(spec: ColSpec) -> list[tuple[int, int]]:
    """How many values of a string domain have which length.

    Lengths get equal shares, but never more than there are strings of that length;
    what a short length cannot take goes to the longer ones. A domain that does not
    fit is refused here instead of being searched for without end.
    """
    lengths = string_lengths(spec.avg_length)
    left, shares = spec.cardinality, []
    for position, length in enumerate(lengths):
        fair = -(-left // (len(lengths) - position))
        share = min(fair, CHARS**length)
        shares.append((length, share))
        left -= share
    if left:
        raise ValueError(
            f"{spec.to_string()}: only {spec.cardinality - left} different strings have such lengths"
        )
    return [(length, share) for length, share in shares if share]


def _coprime(start: int, modulus: int) -> int:
    value = max(1, start)
    while gcd(value, modulus) != 1:
        value += 1
    return value


def shuffled(idx: Column, n: int, stream: int) -> Column:
    """A fixed permutation of [0, n), so that a value says nothing about its rank."""
    factor, shift = shuffle_constants(n, stream)
    return (idx * F.lit(factor).cast("bigint") + F.lit(shift).cast("bigint")) % F.lit(n).cast(
        "bigint"
    )


def shuffle_constants(n: int, stream: int) -> tuple[int, int]:
    return _coprime(int(n * 0.6180339887) + stream % 97, n), stream % n


def code_constants(spec: ColSpec, stream: int) -> tuple[int, int]:
    """Factor and shift that spread string numbers; the factor shares no divisor with 57."""
    return _coprime(2**62 // spec.cardinality - stream % 100_003, CHARS), stream % 10**9


def domain_string(spec: ColSpec, idx: Column, stream: int) -> Cell:
    """The string of a domain index; different indexes always give different strings.

    Each index owns a length and a number among the strings of that length. Numbers are
    spread by an affine map modulo a power of 57 and written in base 57, so they stay
    distinct; positions past the tenth are free and filled from a hash.
    """
    shares = length_shares(spec)
    factor, shift = code_constants(spec, stream)
    place = yield shuffled(idx, spec.cardinality, stream)
    length = first = space = None
    start = 0
    for size, share in shares:
        here = F.lit(size), _long(start), _long(CHARS ** min(size, CODE_CHARS))
        start += share
        if length is None:
            length, first, space = (F.when(place < start, v) for v in here)
        else:
            length, first, space = (
                c.when(place < start, v) for c, v in zip((length, first, space), here, strict=True)
            )
    code = yield ((place - first) * _long(factor) + _long(shift)) % space
    longest = max(size for size, _ in shares)
    chars = _digits(code, min(longest, CODE_CHARS))
    for block in range(CODE_CHARS, longest, CODE_CHARS):
        more = yield bits(place, stream + block)
        chars += _digits(more, min(CODE_CHARS, longest - block))
    return F.substring(F.concat(*chars), F.lit(1), length)


def _long(number: int) -> Column:
    return F.lit(number).cast("bigint")


def _digits(number: Column, count: int) -> list[Column]:
    """The lowest ``count`` base-57 digits of a number as text, lowest first, two at a time."""
    table = F.split(F.lit(" ".join(TWO_CHARS)), " ")  # folded to a constant array by the optimizer
    pairs = [
        F.get(table, (_div(number, CHARS**k) % len(TWO_CHARS)).cast("int"))
        for k in range(0, count, 2)
    ]
    if count % 2:
        pairs[-1] = F.substring(pairs[-1], 1, 1)
    return pairs


def _div(number: Column, by: int) -> Column:
    return number if by == 1 else F.call_function("div", number, F.lit(by).cast("bigint"))


def free_string(key: Column, avg: int, stream: int) -> Cell:
    """A random string that belongs to no domain (map values)."""
    lengths = string_lengths(avg)
    longest, chars = lengths[-1], []
    for block in range(0, longest, CODE_CHARS):
        more = yield bits(key, stream + 1 + block)
        chars += _digits(more, min(CODE_CHARS, longest - block))
    length = below(key, stream, len(lengths)).cast("int") + lengths[0]
    return F.substring(F.concat(*chars), F.lit(1), length)


def domain_number(spec: ColSpec, idx: Column, stream: int) -> Column:
    """The float or double of a domain index, within +-2^31, distinct for each index.

    The range is cut into one stratum per index; the value lies in the middle half of
    its stratum, so neighbours cannot meet even after rounding to a float.
    """
    if spec.dtype == "float" and spec.cardinality > FLOAT_DOMAIN_LIMIT:
        raise ValueError(f"{spec.to_string()}: floats cannot hold that many different values")
    place = shuffled(idx, spec.cardinality, stream)
    inside = 0.25 + 0.5 * unit(idx, stream + 1)
    number = ((place + inside) * F.lit(2.0 / spec.cardinality) - 1.0) * F.lit(RANDOM_NUMBER_LIMIT)
    return number.cast(spec.dtype)


def value(spec: ColSpec, key: Column, seed: int, column: int) -> Cell:
    """A cell of a generated column, before nulls."""
    size_stream, text_stream = salt(seed, column, SIZE), salt(seed, column, TEXT)
    if spec.dtype == "map":
        low, high = MAP_SIZE
        size = yield below(key, size_stream, high - low + 1).cast("int") + low
        return F.map_from_arrays(
            F.slice(F.array(*[F.lit(k) for k in MAP_KEYS]), F.lit(1), size),
            F.transform(
                F.sequence(F.lit(1), size),
                lambda i: inline(free_string(_part(key, i), spec.avg_length, text_stream)),
            ),
        )
    if spec.dtype == "bag":
        low, high = BAG_SIZE
        size = below(key, size_stream, high - low + 1).cast("int") + low
        return F.transform(
            F.sequence(F.lit(1), size),
            lambda i: inline(value(spec.element, _part(key, i), seed, column + ELEMENT_COLUMN)),
        )
    idx = yield (yield from index(spec, key, salt(seed, column, INDEX)))
    if spec.dtype == "string":
        return (yield from domain_string(spec, idx, text_stream))
    if spec.dtype in ("float", "double"):
        return domain_number(spec, idx, text_stream)
    return idx.cast("int") if spec.dtype == "int" else idx


def _part(key: Column, number: Column) -> Column:
    """The key of one entry or element of a row."""
    return F.xxhash64(key, number.cast("bigint"))


def nullable_value(spec: ColSpec, key: Column, seed: int, column: int) -> Cell:
    """A cell of a generated column, null with the spec's share."""
    cell = yield from value(spec, key, seed, column)
    if spec.percent_null == 0:
        return cell
    return F.when(below(key, salt(seed, column, NULLS), 100) >= spec.percent_null, cell)


def nullable_index(spec: ColSpec, key: Column, seed: int, column: int) -> Cell:
    """The domain index of a cell whose value is looked up elsewhere, null with the spec's share."""
    idx = yield (yield from index(spec, key, salt(seed, column, INDEX)))
    return F.when(below(key, salt(seed, column, NULLS), 100) >= spec.percent_null, idx)


def add_columns(df: DataFrame, cells: dict[str, Cell]) -> DataFrame:
    """Add generated columns: one projection per round of intermediate results."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    waiting: dict[str, Column | None] = dict.fromkeys(cells)
    done: dict[str, Column] = {}
    step = 0
    while waiting:
        bound = {}
        for name, reference in waiting.items():
            try:
                bound[name] = cells[name].send(reference)
            except StopIteration as end:
                done[name] = end.value
        if bound:
            df = df.select("*", *[e.alias(f"__{step}_{n}") for n, e in bound.items()])
        waiting = {n: F.col(f"`__{step}_{n}`") for n in bound}
        step += 1
    return df.select(*kept, *[done[n].alias(n) for n in cells])


def inline(cell: Cell, reference: Column | None = None) -> Column:
    """A cell as one expression, intermediate results bound by one-element arrays."""
    try:
        bound = cell.send(reference)
    except StopIteration as end:
        return end.value
    return F.transform(F.array(bound), lambda v: inline(cell, v))[0]


def keep_percent(key: Column, percent: int, seed: int = 0) -> Column:
    """Bernoulli choice by key: the same keys are kept in every run."""
    return below(key, salt(seed, 0, INDEX), 100) < percent
