"""Column and table specifications, and the schemas of the page-view tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# ---- fixed values: the type and distribution letters of a column spec ----
TYPE_LETTERS = {
    "i": "int",
    "l": "long",
    "f": "float",
    "d": "double",
    "s": "string",
    "m": "map",
    "b": "bag",
}
DISTRIBUTION_LETTERS = {"u": "uniform", "z": "zipf"}
# ---- end of fixed values ----

SPARK_TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "map": T.MapType(T.StringType(), T.StringType()),
}


def type_name(text: str) -> str:
    """The type named by a letter or, in any case, by its word."""
    if text in TYPE_LETTERS:
        return TYPE_LETTERS[text]
    word = text.lower()
    if word in TYPE_LETTERS.values():
        return word
    raise ValueError(f"unknown data type [{text}]")


def distribution_name(text: str) -> str:
    if text in DISTRIBUTION_LETTERS:
        return DISTRIBUTION_LETTERS[text]
    if text in DISTRIBUTION_LETTERS.values():
        return text
    raise ValueError(f"unknown distribution [{text}]")


@dataclass(frozen=True)
class ColSpec:
    """One generated column: type, mean length, number of values, law and null share."""

    dtype: str
    avg_length: int = 0
    cardinality: int = 1
    distribution: str = "uniform"
    percent_null: int = 0
    map_file: str | None = None
    element: ColSpec | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.percent_null <= 100:
            raise ValueError(f"null share must be within 0-100, got {self.percent_null}")
        if self.dtype == "bag":
            if self.element is None:
                raise ValueError("a bag needs an element spec")
        elif not 1 <= self.cardinality < 2**31:
            raise ValueError(f"cardinality must be within 1 and 2^31-1, got {self.cardinality}")

    @property
    def spark_type(self) -> T.DataType:
        if self.dtype == "bag":
            return T.ArrayType(self.element.spark_type)
        return SPARK_TYPES[self.dtype]

    def to_string(self) -> str:
        letter = next(k for k, v in TYPE_LETTERS.items() if v == self.dtype)
        if self.dtype == "bag":
            return letter + self.element.to_string()
        parts = [
            letter,
            str(self.avg_length),
            str(self.cardinality),
            next(k for k, v in DISTRIBUTION_LETTERS.items() if v == self.distribution),
            str(self.percent_null),
        ]
        if self.map_file:
            parts.append(self.map_file)
        return ":".join(parts)


def parse_colspec(text: str) -> ColSpec:
    """``type:length:cardinality:distribution:%null[:file]``; a bag is ``b`` + its element spec.

    The null share of a bag is that of its element spec and applies to the whole bag.
    """
    parts = text.split(":")
    if len(parts) not in (5, 6):
        raise ValueError(f"column spec [{text}] needs 5 or 6 parts")
    kind = type_name(parts[0][:1])
    if kind == "bag":
        element = parse_colspec(text[1:])
        return ColSpec("bag", percent_null=element.percent_null, element=element)
    return ColSpec(
        dtype=kind,
        avg_length=int(parts[1]),
        cardinality=int(parts[2]),
        distribution=distribution_name(parts[3][:1]),
        percent_null=int(parts[4]),
        map_file=parts[5] if len(parts) == 6 else None,
    )


@dataclass(frozen=True)
class TableSpec:
    """A catalog table: columns, partition keys, and how many rows to generate."""

    name: str
    database: str
    columns: tuple[tuple[str, ColSpec], ...]
    partitions: tuple[tuple[str, ColSpec], ...] = ()
    rows: int = 0

    def __post_init__(self) -> None:
        names = [n.lower() for n, _ in self.columns + self.partitions]
        repeated = sorted({n for n in names if names.count(n) > 1})
        if repeated:
            raise ValueError(f"table {self.name}: column names appear twice: {repeated}")
        for name, spec in self.partitions:
            if spec.percent_null:
                raise ValueError(f"partition key {name} cannot have nulls")

    @property
    def qualified(self) -> str:
        return f"{self.database}.{self.name}"

    def renamed(self, name: str) -> TableSpec:
        return replace(self, name=name)

    @property
    def struct(self) -> T.StructType:
        """All columns, partition keys last: the layout of its text file and of the table."""
        return T.StructType(
            [T.StructField(n, s.spark_type) for n, s in self.columns + self.partitions]
        )


PAGE_LINK = T.MapType(T.StringType(), T.StringType())

PAGE_VIEWS = T.StructType(
    [
        T.StructField("user", T.StringType()),
        T.StructField("action", T.IntegerType()),
        T.StructField("timespent", T.IntegerType()),
        T.StructField("query_term", T.StringType()),
        T.StructField("ip_addr", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("estimated_revenue", T.DoubleType()),
        T.StructField("page_info", PAGE_LINK),
        T.StructField("page_links", T.ArrayType(PAGE_LINK)),
    ]
)

USERS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("zip", T.IntegerType()),
    ]
)

# ---- fixed values: column specs of the page-view data set ----
PAGE_VIEW_SPECS = {
    "user": "s:20:160000:z:7",
    "action": "i:1:2:u:0",
    "timespent": "i:1:20:z:0",
    "query_term": "s:10:180000:z:20",
    "ip_addr": "l:1:100000:z:0",
    "timestamp": "l:1:86400:z:0",
    "estimated_revenue": "d:1:100000:z:5",
    "page_info": "m:10:1:z:0",
    "page_links": "bm:10:1:z:20",
}
USER_DETAIL_SPECS = {
    "phone": "s:10:160000:z:20",
    "address": "s:20:160000:z:20",
    "city": "s:10:160000:z:20",
    "state": "s:2:1600:z:20",
    "zip": "i:2:1600:z:20",
}
WIDE_ROW_USER_SPEC = "s:20:10000:z:0"
WIDE_ROW_INT_SPEC = "i:1:10000:u:0"
WIDE_ROW_INTS = 500
POWER_USERS = 500
POWER_USER_SAMPLE_PERCENT = 50
NOON_SECOND = 43200
# ---- end of fixed values ----
