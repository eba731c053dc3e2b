"""Text layouts of fields, maps, bags and tuples as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewlog.schema import TYPE_LETTERS

# ---- fixed values: separators of the text layout ----
FIELD_SEP = "\u0001"
BAG_SEP = "\u0002"
PAIR_SEP = "\u0003"
KEY_SEP = "\u0004"
# ---- end of fixed values ----


def empty_to_null(col: Column) -> Column:
    """An empty text field is a null."""
    return F.nullif(col, F.lit(""))


def split_raw(line: Column, sep: str = FIELD_SEP, limit: int = -1) -> Column:
    """Fields of a line in order, trailing empty ones kept; the last of ``limit`` takes the rest."""
    return F.split(line, _literal(sep), limit)


def split_fields(line: Column, sep: str = FIELD_SEP) -> Column:
    """All fields of a line in order, empty ones as null."""
    return F.transform(split_raw(line, sep), lambda field: empty_to_null(field))


def _literal(sep: str) -> str:
    """A separator as a regular expression that matches just itself."""
    return "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}" else c for c in sep)


def decode_map(col: Column, duplicates: str = "last") -> Column:
    """``key ^D value ^C key ^D value`` to a map; a null text stays null.

    A key that comes twice keeps its last value. ``duplicates="error"`` skips that
    check and lets Spark fail on such a text, which is cheaper for trusted files.
    """
    if duplicates == "error":
        parsed = F.str_to_map(col, F.lit(PAIR_SEP), F.lit(KEY_SEP))
    elif duplicates == "last":
        pairs = F.split(col, PAIR_SEP, -1)
        keys = F.transform(pairs, lambda p: F.substring_index(p, KEY_SEP, 1))
        kept = F.filter(
            pairs,
            lambda p, i: ~F.array_contains(
                F.slice(keys, i + F.lit(2), F.size(keys)), F.substring_index(p, KEY_SEP, 1)
            ),
        )
        repeated = F.size(F.array_distinct(keys)) < F.size(keys)
        plain = F.str_to_map(col, F.lit(PAIR_SEP), F.lit(KEY_SEP))
        parsed = F.when(
            repeated, F.str_to_map(F.array_join(kept, PAIR_SEP), F.lit(PAIR_SEP), F.lit(KEY_SEP))
        ).otherwise(plain)
    else:
        raise ValueError(f"duplicates must be 'last' or 'error', got {duplicates!r}")
    return F.when(col == "", F.create_map().cast("map<string,string>")).otherwise(parsed)


def encode_map(col: Column) -> Column:
    """The text that :func:`decode_map` reads."""
    return F.array_join(
        F.transform(
            F.map_entries(col),
            lambda e: F.concat(e["key"], F.lit(KEY_SEP), F.coalesce(e["value"], F.lit(""))),
        ),
        PAIR_SEP,
    )


def decode_bag(col: Column, element: str = "m", duplicates: str = "last") -> Column:
    """Elements separated by ``^B``, each with a leading type letter, to an array.

    ``element`` is the letter the array is typed by. A letter outside the known set
    is an error, as is one that cannot be held by the array's type; a scalar whose
    text does not parse becomes null. ``duplicates`` is that of :func:`decode_map`.
    """
    if element not in TYPE_LETTERS or element == "b":
        raise ValueError(f"cannot build an array of type letter [{element}]")
    known = list(TYPE_LETTERS)

    def parse(item: Column) -> Column:
        letter, body = F.substring(item, 1, 1), F.substring(item, 2, 2**31 - 1)
        if element == "m":
            value, accepted = decode_map(body, duplicates), letter == "m"
        elif element == "s":
            value, accepted = body, letter.isin([k for k in known if k not in "mb"])
        else:
            kind = {"i": "int", "l": "bigint", "f": "float", "d": "double"}[element]
            value, accepted = body.try_cast(kind), letter.isin(list("ilfd"))
        problem = F.when(
            letter.isin(known), F.concat(F.lit(f"a bag of [{element}] cannot hold type "), letter)
        ).otherwise(F.concat(F.lit("unknown type "), letter))
        return F.when(accepted, value).otherwise(F.raise_error(problem))

    items = F.split(col, BAG_SEP, -1)
    parsed = F.transform(items, parse)
    if element == "m":
        # The usual bag has nothing but maps: one test for the bag, none for its elements.
        maps = F.forall(items, lambda item: item.startswith("m"))
        bodies = F.transform(items, lambda item: decode_map(F.substring(item, 2, 2**31 - 1), duplicates))
        parsed = F.when(maps, bodies).otherwise(parsed)
    return F.when(F.length(col) == 0, F.array().cast(_array_type(element))).otherwise(parsed)


def _array_type(element: str) -> str:
    inner = {"i": "int", "l": "bigint", "f": "float", "d": "double", "s": "string"}
    return f"array<{inner.get(element, 'map<string,string>')}>"


def encode_bag(col: Column, element: str = "m") -> Column:
    """The text that :func:`decode_bag` reads."""
    body = encode_map if element == "m" else (lambda x: F.coalesce(x.cast("string"), F.lit("")))
    return F.array_join(F.transform(col, lambda x: F.concat(F.lit(element), body(x))), BAG_SEP)


def tuple_text(*cols: Column) -> Column:
    """``(a,b,c)``, a null as nothing between the commas."""
    fields = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")"))


def tuple_fields(line: Column) -> Column:
    """The trimmed fields of a ``(a, b, c)`` line; null where the line has no such form."""
    inside = F.when(line.rlike(r"^\(.*\)$"), F.substring(line, F.lit(2), F.length(line) - 2))
    return F.transform(F.split(inside, ",", -1), lambda field: F.trim(field))
