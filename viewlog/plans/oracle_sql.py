"""SQL building blocks for the checks: text layouts and the hash draws in plain arithmetic.

The checks must not call Spark's code, so the 64-bit xxHash of a bigint, its draws and the
generated values are written here a second time, as integer arithmetic in SQL.
"""

from __future__ import annotations

from viewlog.functions import draw
from viewlog.functions.text import BAG_SEP, FIELD_SEP, KEY_SEP, PAIR_SEP
from viewlog.plans.driver_views import SAMPLE_SEED
from viewlog.schema import POWER_USER_SAMPLE_PERCENT, ColSpec, parse_colspec


def char(c: str) -> str:
    return f"chr({ord(c)})"


FIELD, BAG, PAIR, KEY = (char(c) for c in (FIELD_SEP, BAG_SEP, PAIR_SEP, KEY_SEP))

INFO_TEXT_SQL = (
    f"CASE WHEN info_a IS NULL THEN '' ELSE 'a' || {KEY} || info_a || {PAIR} END"
    f" || 'c' || {KEY} || info_c"
)
LINKS_TEXT_SQL = (
    "array_to_string(list_transform(range(1, n_links + 1), lambda i:"
    f" 'ma' || {KEY} || 'x' || CAST(i AS VARCHAR) || {PAIR} || 'b' || {KEY}"
    f" || 'l' || CAST((event_id + i) % 13 AS VARCHAR)), {BAG})"
)

# ---- fixed values: constants of the published 64-bit xxHash, and Spark's seed for it ----
PRIME_1 = 11400714785074694791
PRIME_2 = 14029467366897019727
PRIME_3 = 1609587929392839161
PRIME_4 = 9650029242287828579
PRIME_5 = 2870177450012600261
SPARK_SEED = 42
# ---- end of fixed values ----


def _u(number: int) -> str:
    return f"{number}::UHUGEINT"


def _wrap(expression: str) -> str:
    return f"(({expression}) % {_u(2**64)})"


def _rotate(name: str, by: int) -> str:
    return f"(({name} * {_u(2**by)}) % {_u(2**64)} + {name} // {_u(2 ** (64 - by))})"


def let(name: str, value: str, body: str) -> str:
    """Bind a value to a name inside an expression."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def unsigned(expression: str) -> str:
    """A bigint's two's complement bits as an unsigned number."""
    return f"((({expression})::HUGEINT + {2**64}) % {2**64})::UHUGEINT"


def xxhash(value: str, seed: str) -> str:
    """xxHash64 of one 8-byte value (unsigned in, unsigned out)."""
    start = _wrap(f"{seed} + {_u(PRIME_5 + 8)}")
    return let(
        "h0",
        _wrap(f"{value} * {_u(PRIME_2)}"),
        let(
            "h1",
            _wrap(f"{_rotate('h0', 31)} * {_u(PRIME_1)}"),
            let(
                "h2",
                f"xor({start}, h1)",
                let(
                    "h3",
                    _wrap(f"{_rotate('h2', 27)} * {_u(PRIME_1)} + {_u(PRIME_4)}"),
                    let(
                        "h4",
                        _wrap(f"xor(h3, h3 // {_u(2**33)}) * {_u(PRIME_2)}"),
                        let(
                            "h5",
                            _wrap(f"xor(h4, h4 // {_u(2**29)}) * {_u(PRIME_3)}"),
                            f"xor(h5, h5 // {_u(2**32)})",
                        ),
                    ),
                ),
            ),
        ),
    )


def text_hash(text: str) -> str:
    """xxHash64 of a text of ASCII letters with fewer than 32 of them (unsigned out).

    Blocks of eight letters, then one of four, then single ones; each is folded into the hash in
    turn. The width of a block stands above its 64 bits.
    """

    def block(first: str, width: int) -> str:
        letters = [
            f"ascii(substr({text}, CAST({first} + {j + 1} AS BIGINT), 1))::UHUGEINT * {_u(256**j)}"
            for j in range(width)
        ]
        return f"{' + '.join(letters)} + {_u(width * 2**64)}"

    size = f"length({text})"
    four = f"({size} % 8) // 4"
    blocks = (
        f"list_concat(list_concat(list_transform(range(0, {size} // 8), lambda i: {block('8 * i', 8)}),"
        f" list_transform(range(0, {four}), lambda i: {block(f'{size} // 8 * 8', 4)})),"
        f" list_transform(range({size} // 4 * 4, {size}), lambda i: {block('i', 1)}))"
    )
    value = f"(b % {_u(2**64)})"
    mixed = let("m1", _wrap(f"{value} * {_u(PRIME_2)}"), _wrap(f"{_rotate('m1', 31)} * {_u(PRIME_1)}"))
    eight = let("x1", f"xor(h, {mixed})", _wrap(f"{_rotate('x1', 27)} * {_u(PRIME_1)} + {_u(PRIME_4)}"))
    half = let(
        "x1",
        f"xor(h, {_wrap(f'{value} * {_u(PRIME_1)}')})",
        _wrap(f"{_rotate('x1', 23)} * {_u(PRIME_2)} + {_u(PRIME_3)}"),
    )
    single = let(
        "x1",
        f"xor(h, {_wrap(f'{value} * {_u(PRIME_5)}')})",
        _wrap(f"{_rotate('x1', 11)} * {_u(PRIME_1)}"),
    )
    width = f"b // {_u(2**64)}"
    folded = (
        f"list_reduce(list_prepend({_wrap(f'{_u(SPARK_SEED + PRIME_5)} + {size}::UHUGEINT')}, {blocks}),"
        f" lambda h, b: CASE {width} WHEN 8 THEN {eight} WHEN 4 THEN {half} ELSE {single} END)"
    )
    return let(
        "h3",
        folded,
        let(
            "h4",
            _wrap(f"xor(h3, h3 // {_u(2**33)}) * {_u(PRIME_2)}"),
            let("h5", _wrap(f"xor(h4, h4 // {_u(2**29)}) * {_u(PRIME_3)}"), f"xor(h5, h5 // {_u(2**32)})"),
        ),
    )


def signed(number: str) -> str:
    """An unsigned 64-bit hash as the bigint with the same bits."""
    return f"CAST(({number})::HUGEINT - CASE WHEN {number} >= {2**63} THEN {2**64} ELSE 0 END AS BIGINT)"


def key_hash(key: str) -> str:
    return xxhash(unsigned(key), _u(SPARK_SEED))


def hashed(key: str, stream: int) -> str:
    """The draw of (key, stream) as an unsigned 64-bit number."""
    return let("k", key_hash(key), xxhash(_u(stream), "k"))


def bits(key: str, stream: int) -> str:
    return f"CAST({hashed(key, stream)} // {_u(2)} AS BIGINT)"


def below(key: str, stream: int, n: int) -> str:
    return f"({bits(key, stream)} % {n})"


def unit(key: str, stream: int) -> str:
    return f"(CAST({hashed(key, stream)} // {_u(2**11)} AS DOUBLE) / {float(2**53)!r})"


def keep_percent(key: str, percent: int, seed: int) -> str:
    return f"{below(key, draw.salt(seed, 0, draw.INDEX), 100)} < {percent}"


HASH_SAMPLE_SQL = keep_percent(
    "n_nationkey::BIGINT", POWER_USER_SAMPLE_PERCENT, SAMPLE_SEED
)


def zipf_table(cardinality: int, name: str = "zipf") -> str:
    """Ranks with their cumulative harmonic numbers, the definition of the law."""
    return (
        f"{name} AS (SELECT r, sum(1.0::DOUBLE / r) OVER (ORDER BY r) AS upto"
        f" FROM range(1, {cardinality + 1}) t(r))"
    )


def not_null(spec: ColSpec, key: str, seed: int, column: int) -> str:
    return f"{below(key, draw.salt(seed, column, draw.NULLS), 100)} >= {spec.percent_null}"


def index_stream(seed: int, column: int) -> int:
    return draw.salt(seed, column, draw.INDEX)


def domain_string(spec_text: str, idx: str, seed: int, column: int) -> str:
    """The string of a domain index, from the documented construction."""
    spec = parse_colspec(spec_text)
    stream = draw.salt(seed, column, draw.TEXT)
    factor, shift = draw.shuffle_constants(spec.cardinality, stream)
    code_factor, code_shift = draw.code_constants(spec, stream)
    lengths, starts, rooms, start = [], [], [], 0
    for length, share in draw.length_shares(spec):
        lengths.append(length)
        starts.append(start)
        rooms.append(draw.CHARS ** min(length, draw.CODE_CHARS))
        start += share

    def pick(numbers: list[int]) -> str:
        return f"(({numbers})::HUGEINT[])[slot]::BIGINT"

    slot = f"len(list_filter({starts}::BIGINT[], lambda s: s <= place))"
    longest = max(lengths)
    blocks = ", ".join(
        bits("place", stream + b) for b in range(draw.CODE_CHARS, longest, draw.CODE_CHARS)
    )
    number = (
        f"CAST((((place - {pick(starts)})::HUGEINT * {code_factor} + {code_shift})"
        f" % {pick(rooms)}) AS BIGINT)"
    )
    one_char = (
        f"chr(CAST({draw.FIRST_CHAR} + (words[i // {draw.CODE_CHARS} + 1]"
        f" // CAST(power({draw.CHARS}::HUGEINT, i % {draw.CODE_CHARS}) AS BIGINT)) % {draw.CHARS} AS INTEGER))"
    )
    text = (
        f"array_to_string(list_transform(range(0, {pick(lengths)}),"
        f" lambda i: {one_char}), '')"
    )
    return let(
        "place",
        f"(({idx})::BIGINT * {factor} + {shift}) % {spec.cardinality}",
        let("slot", slot, let("words", f"[{number}{', ' + blocks if blocks else ''}]::BIGINT[]", text)),
    )
