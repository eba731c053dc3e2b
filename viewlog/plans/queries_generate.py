"""Generated columns for the rows of the given tables.

The SQL computes the same draws a second time, as integer arithmetic on the row's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlog import generate
from viewlog.functions import draw
from viewlog.functions.text import encode_bag, encode_map
from viewlog.generate import gen_append, gen_from_spec, gen_table, parts_to_draw
from viewlog.operators import range_bounds
from viewlog.operators.joins import join_replicated
from viewlog.operators.ordering import read_positions, sorted_write
from viewlog.plans import driver_views as views
from viewlog.plans import oracle_sql as sql
from viewlog.plans import prep
from viewlog.plans.driver_views import PAGE_VIEWS_SQL, table
from viewlog.plans.oracle_sql import INFO_TEXT_SQL, LINKS_TEXT_SQL
from viewlog.plans.registry import placed, query
from viewlog.schema import (
    PAGE_VIEWS,
    POWER_USER_SAMPLE_PERCENT,
    POWER_USERS,
    USER_DETAIL_SPECS,
    TableSpec,
    parse_colspec,
)
from viewlog.session import scratch_path
from viewlog.sources import catalog, delimited

SEED = 11


def generated(spark: SparkSession, sf_dir: str, **specs: str) -> DataFrame:
    """Columns for every event, drawn from its id."""
    return gen_append(table(spark, sf_dir, "events").select("event_id"), specs, "event_id", SEED)


def uniform(spec: str, column: int, key: str = "event_id") -> str:
    stream = sql.index_stream(SEED, column)
    return sql.below(key, stream, parse_colspec(spec).cardinality)


def with_nulls(value: str, spec: str, column: int, key: str = "event_id") -> str:
    present = sql.not_null(parse_colspec(spec), key, SEED, column)
    return f"CASE WHEN {present} THEN {value} END"


def zipf_ctes(spec: str, column: int) -> tuple[str, str]:
    """The rank of each event: the first whose cumulative weight reaches the draw."""
    u = sql.unit("event_id", sql.index_stream(SEED, column))
    return (
        sql.zipf_table(parse_colspec(spec).cardinality),
        f"""ranked AS (SELECT event_id, r - 1 AS idx FROM
      (SELECT event_id, {u} * (SELECT max(upto) FROM zipf) AS t FROM events)
      ASOF JOIN zipf ON t <= upto)""",
    )


ROW_NUMBERS = "(SELECT row_number() OVER () - 1 AS n FROM orders)"


@query(
    "gen_table",
    f"""SELECT CAST({with_nulls(uniform('i:1:40:u:25', 0, 'n'), 'i:1:40:u:25', 0, 'n')} AS INTEGER) AS a,
      {uniform('l:1:90000:u:0', 1, 'n')} AS b FROM {ROW_NUMBERS}""",
)
def gen_table_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated table with as many rows as there are orders."""
    rows = table(spark, sf_dir, "orders").count()
    return gen_table(spark, {"a": "i:1:40:u:25", "b": "l:1:90000:u:0"}, rows, SEED)


SPENT, LANE, DAY = "i:1:600:u:10", "i:1:4:u:0", "s:3:12:u:0"


def order_table(spark: SparkSession, sf_dir: str, name: str) -> TableSpec:
    """A table spec with two partition keys, sized like the orders."""
    return TableSpec(
        name=name,
        database="default",
        columns=(("spent", parse_colspec(SPENT)),),
        partitions=(("lane", parse_colspec(LANE)), ("day", parse_colspec(DAY))),
        rows=table(spark, sf_dir, "orders").count(),
    )


ORDER_TABLE_SQL = f"""SELECT
      CAST({with_nulls(uniform(SPENT, 0, 'n'), SPENT, 0, 'n')} AS INTEGER) AS spent,
      CAST({uniform(LANE, 1, 'n')} AS INTEGER) AS lane,
      {sql.domain_string(DAY, uniform(DAY, 2, 'n'), SEED, 2)} AS day
    FROM {ROW_NUMBERS}"""


@query("gen_from_spec", ORDER_TABLE_SQL)
def gen_from_spec_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows of a spec, stored by partition and read back."""
    path = scratch_path(spark, "from-spec")
    spec = order_table(spark, sf_dir, "from_spec")
    keys = [name for name, _ in spec.partitions]
    rows = gen_from_spec(spark, spec, SEED)
    rows.hint("rebalance", *keys).write.partitionBy(*keys).parquet(path)
    return spark.read.schema(spec.struct).parquet(path)


@query("generate_if_missing", ORDER_TABLE_SQL)
def generate_if_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second request finds the output in place and leaves it, whatever its seed."""
    path = scratch_path(spark, "missing")
    spec = order_table(spark, sf_dir, "missing")
    for seed in (SEED, SEED + 1):
        catalog.generate_if_missing(spark, spec, path, seed)
    return delimited.read_delimited(spark, path, spec.struct, catalog.TEXT_SEP)


UNIFORM_INT, UNIFORM_LONG = "i:1:1000:u:10", "l:1:100000:u:0"


@query(
    "gen_append",
    f"""SELECT event_id, event_type,
      CAST({with_nulls(uniform(UNIFORM_INT, 0), UNIFORM_INT, 0)} AS INTEGER) AS a,
      {uniform(UNIFORM_LONG, 1)} AS b FROM events""",
)
def gen_append_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return gen_append(rows, {"a": UNIFORM_INT, "b": UNIFORM_LONG}, "event_id", SEED)


@query(
    "dist_uniform",
    f"""SELECT value, count(*) AS n_rows FROM (SELECT {uniform("i:1:50:u:0", 0)} AS value FROM events)
    GROUP BY value""",
)
def dist_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = generated(spark, sf_dir, value="l:1:50:u:0")
    return drawn.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))


@query("dist_zipf", "SELECT event_id, idx AS value FROM ranked", zipf_ctes("l:1:20:z:0", 0))
def dist_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, value="l:1:20:z:0")


@query(
    "gen_int",
    f"SELECT event_id, CAST({uniform('i:1:100000:u:0', 0)} AS INTEGER) AS value FROM events",
)
def gen_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, value="i:1:100000:u:0")


@query("gen_long", "SELECT event_id, idx AS value FROM ranked", zipf_ctes("l:1:5000:z:0", 0))
def gen_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, value="l:1:5000:z:0")


def number_of(index: str, spec: str, column: int) -> str:
    """The stratified number of a domain index."""
    parsed = parse_colspec(spec)
    stream = draw.salt(SEED, column, draw.TEXT)
    factor, shift = draw.shuffle_constants(parsed.cardinality, stream)
    place = f"(({index})::BIGINT * {factor} + {shift}) % {parsed.cardinality}"
    inside = f"(0.25::DOUBLE + 0.5::DOUBLE * {sql.unit(f'({index})', stream + 1)})"
    scale = f"{2.0 / parsed.cardinality!r}::DOUBLE"
    return f"((({place}) + {inside}) * {scale} - 1.0::DOUBLE) * 2147483648.0::DOUBLE"


DOUBLE, FLOAT = "d:1:700:u:5", "f:1:700:u:0"


@query(
    "gen_double",
    f"""SELECT event_id, {with_nulls(number_of('idx', DOUBLE, 0), DOUBLE, 0)} AS value
    FROM (SELECT event_id, {uniform(DOUBLE, 0)} AS idx FROM events)""",
)
def gen_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, value=DOUBLE)


@query(
    "gen_float",
    f"""SELECT event_id, CAST({number_of('idx', FLOAT, 0)} AS FLOAT) AS value
    FROM (SELECT event_id, {uniform(FLOAT, 0)} AS idx FROM events)""",
)
def gen_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, value=FLOAT)


SHORT, LONG = "s:2:1600:u:20", "s:20:160000:u:7"


@query(
    "gen_string",
    f"""SELECT event_id, {with_nulls(sql.domain_string(SHORT, 'i', SEED, 0), SHORT, 0)} AS short,
      {with_nulls(sql.domain_string(LONG, 'j', SEED, 1), LONG, 1)} AS long
    FROM (SELECT event_id, {uniform(SHORT, 0)} AS i, {uniform(LONG, 1)} AS j FROM events)""",
)
def gen_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, short=SHORT, long=LONG)


@query(
    "value_domain",
    f"""SELECT c_custkey, {sql.domain_string(SHORT, 'i', SEED, 0)} AS value
    FROM (SELECT c_custkey, c_custkey % {parse_colspec(SHORT).cardinality} AS i FROM customer)""",
)
def value_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value each customer's number has in a stored domain, looked up by index."""
    path = scratch_path(spark, "domain")
    generate.write_value_domain(spark, SHORT, path, SEED)
    domain = delimited.read_delimited(spark, path, "at bigint, value string", generate.DOMAIN_SEP)
    numbered = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % parse_colspec(SHORT).cardinality).alias("index")
    )
    return join_replicated(numbered, domain, "index", "at").select("c_custkey", "value")


def free_text(key: str, avg: int, stream: int) -> str:
    """A random map value of an element key, from its documented construction."""
    lengths = draw.string_lengths(avg)
    blocks = ", ".join(
        sql.bits(key, stream + 1 + b) for b in range(0, lengths[-1], draw.CODE_CHARS)
    )
    length = f"{sql.below(key, stream, len(lengths))} + {lengths[0]}"
    one_char = (
        f"chr(CAST({draw.FIRST_CHAR} + (words[i // {draw.CODE_CHARS} + 1]"
        f" // CAST(power({draw.CHARS}::HUGEINT, i % {draw.CODE_CHARS}) AS BIGINT)) % {draw.CHARS}"
        " AS INTEGER))"
    )
    text = f"array_to_string(list_transform(range(0, {length}), lambda i: {one_char}), '')"
    return sql.let("words", f"[{blocks}]", text)


MAP = "m:10:1:z:0"


def map_text(entry_key: str, size: str, stream: int) -> str:
    """Letters with their random texts, for a row or element whose keyed hash is ``base``."""
    element = sql.let("raw", sql.xxhash("n::UHUGEINT", entry_key), sql.signed("raw"))
    entry = sql.let("ek", element, free_text("ek", 10, stream))
    return (
        f"array_to_string(list_transform(range(1, {size} + 1), lambda n:"
        f" substr('{draw.MAP_KEYS}', n, 1) || {sql.KEY} || {entry}), {sql.PAIR})"
    )


def sized(stream: int, bounds: tuple[int, int], key: str = "c_custkey") -> str:
    low, high = bounds
    return f"({sql.below(key, stream, high - low + 1)} + {low})"


@query(
    "gen_map",
    f"""SELECT c_custkey, {map_text('base', 'size', draw.salt(SEED, 0, draw.TEXT))} AS value
    FROM (SELECT c_custkey, {sql.key_hash('c_custkey')} AS base,
            {sized(draw.salt(SEED, 0, draw.SIZE), draw.MAP_SIZE)} AS size FROM customer)""",
)
def gen_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    drawn = gen_append(customers, {"value": MAP}, "c_custkey", SEED, parts_to_draw(customers))
    return drawn.select("c_custkey", encode_map(F.col("value")).alias("value"))


BAG = "bi:1:30:u:20"

BAG_ITEM = sql.let(
    "ek",
    sql.let("raw", sql.xxhash("n::UHUGEINT", "base"), sql.signed("raw")),
    sql.below("ek", draw.salt(SEED, draw.ELEMENT_COLUMN, draw.INDEX), 30),
)


@query(
    "gen_bag",
    f"""SELECT c_custkey, CASE WHEN present THEN size END AS size,
      CASE WHEN present THEN array_to_string(list_transform(range(1, size + 1),
        lambda n: 'i' || CAST({BAG_ITEM} AS VARCHAR)), {sql.BAG}) END AS value
    FROM (SELECT c_custkey, {sql.key_hash('c_custkey')} AS base,
            {sized(draw.salt(SEED, 0, draw.SIZE), draw.BAG_SIZE)} AS size,
            {sql.not_null(parse_colspec(BAG), 'c_custkey', SEED, 0)} AS present FROM customer)""",
)
def gen_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    drawn = gen_append(customers, {"value": BAG}, "c_custkey", SEED, parts_to_draw(customers))
    return drawn.select(
        "c_custkey",
        F.when(F.col("value").isNotNull(), F.size("value")).cast("bigint").alias("size"),
        encode_bag(F.col("value"), "i").alias("value"),
    )


@query(
    "inject_nulls",
    "SELECT "
    + ", ".join(
        f"count(CASE WHEN {sql.not_null(parse_colspec(f'i:1:9:u:{p}'), 'event_id', SEED, i)}"
        f" THEN 1 END) AS kept_{100 - p}"
        for i, p in enumerate((0, 7, 50, 100))
    )
    + " FROM events",
)
def inject_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-null cells at null shares of 0, 7, 50 and 100 percent."""
    shares = {f"kept_{100 - p}": f"i:1:9:u:{p}" for p in (0, 7, 50, 100)}
    drawn = generated(spark, sf_dir, **shares)
    return drawn.agg(*[F.count(c).alias(c) for c in shares])


# ---- data preparation ----


USER_NAMES_SQL = """names AS (SELECT DISTINCT "user" AS name FROM page_views)"""
POWER_NAMES_SQL = f"""names AS (SELECT DISTINCT "user" AS name FROM page_views
    ORDER BY name NULLS FIRST LIMIT {POWER_USERS})"""


def ranked_by_zipf(column: str, source: str, key: str, spec: str, position: int) -> str:
    """The rank of each row in one column, by the row's key."""
    zipf = f"zipf_{parse_colspec(spec).cardinality}"
    u = sql.unit(key, sql.index_stream(SEED, position))
    return f"""rank_{column} AS (SELECT {key}, r - 1 AS idx FROM
      (SELECT {key}, {u} * (SELECT max(upto) FROM {zipf}) AS t FROM {source})
      ASOF JOIN {zipf} ON t <= upto)"""


def detail_ctes(names: str) -> tuple[str, ...]:
    """The users of ``names`` with the details drawn from the hash of their name, as ``details``."""
    hashed = sql.let("raw", sql.text_hash("coalesce(name, '')"), sql.signed("raw"))
    columns, joins = [], []
    for i, (name, text) in enumerate(USER_DETAIL_SPECS.items()):
        spec, idx = parse_colspec(text), f"rank_{name}.idx"
        value = sql.domain_string(text, idx, SEED, i) if spec.dtype == "string" else f"CAST({idx} AS INTEGER)"
        columns.append(f"CASE WHEN {sql.not_null(spec, 'keyed.k', SEED, i)} THEN {value} END AS {name}")
        joins.append(f"JOIN rank_{name} ON keyed.k = rank_{name}.k")
    sizes = sorted({parse_colspec(text).cardinality for text in USER_DETAIL_SPECS.values()})
    return (
        PAGE_VIEWS_SQL,
        names,
        f"keyed AS (SELECT name, {hashed} AS k FROM names)",
        *[sql.zipf_table(n, f"zipf_{n}") for n in sizes],
        *[ranked_by_zipf(n, "keyed", "k", text, i) for i, (n, text) in enumerate(USER_DETAIL_SPECS.items())],
        f"details AS (SELECT name, keyed.k AS k, {', '.join(columns)} FROM keyed {' '.join(joins)})",
    )


DETAILS = ", ".join(["name", *USER_DETAIL_SPECS])


@query("prep_users", f"SELECT {DETAILS} FROM details", detail_ctes(USER_NAMES_SQL))
def prep_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.make_users(views.page_views(spark, sf_dir), SEED)


@query("prep_power_users", f"SELECT {DETAILS} FROM details", detail_ctes(POWER_NAMES_SQL))
def prep_power_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.make_power_users(views.page_views(spark, sf_dir), seed=SEED)


@query(
    "prep_power_user_samples",
    f"SELECT {DETAILS} FROM details WHERE {sql.keep_percent('k', POWER_USER_SAMPLE_PERCENT, SEED)}",
    detail_ctes(POWER_NAMES_SQL),
)
def prep_power_user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the power users, chosen by the hash of their name."""
    everyone = prep.make_power_users(views.page_views(spark, sf_dir), seed=SEED)
    return prep.make_power_user_samples(everyone, SEED)


@query(
    "prep_users_sorted",
    f"SELECT {DETAILS}, row_number() OVER (ORDER BY name NULLS FIRST) AS position FROM details",
    detail_ctes(USER_NAMES_SQL),
)
def prep_users_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored users in order of name, read back with the place of each."""
    path = scratch_path(spark, "users-sorted")
    users = prep.make_users(views.page_views(spark, sf_dir), SEED)
    sorted_write(users, path, F.col("name").asc_nulls_first())
    return read_positions(spark, path)


@query(
    "prep_page_views_sorted",
    """SELECT "user", event_id, rank() OVER (ORDER BY "user" NULLS FIRST) AS place FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def prep_page_views_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored page views in order of user, each with the place where its user begins."""
    path = scratch_path(spark, "page-views-sorted")
    sorted_write(views.page_views(spark, sf_dir), path, F.col("user").asc_nulls_first())
    return placed(read_positions(spark, path), "user").select("user", "event_id", "place")


@query(
    "order_stored_bounds",
    """SELECT "user", action, event_id,
      rank() OVER (ORDER BY "user" NULLS FIRST, action) AS place FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def order_stored_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views in order of user and action, in ranges stored from sketches of an earlier pass."""
    page_views, root = views.page_views(spark, sf_dir), scratch_path(spark, "stored-bounds")
    keys = ("user", "action")
    range_bounds.store_bounds(spark, range_bounds.measure_bounds(page_views, 8, *keys), f"{root}/bounds")
    bounds = range_bounds.load_bounds(spark, f"{root}/bounds")
    range_bounds.order_by_bounds(page_views, bounds, *keys).write.parquet(f"{root}/rows")
    return placed(read_positions(spark, f"{root}/rows"), *keys).select(*keys, "event_id", "place")


WIDE = generate.wide_row_specs()
WIDE_USER, WIDE_INT = parse_colspec(WIDE["user"]), parse_colspec(WIDE["int_1"])
WIDE_ROWS = (
    f"rows AS MATERIALIZED (SELECT n, {sql.key_hash('n')} AS k"
    " FROM (SELECT row_number() OVER () - 1 AS n FROM customer))"
)
# All numbers of a row by one expression over the column's number, then laid side by side.
WIDE_HASH = sql.xxhash(
    f"({sql.index_stream(SEED, 0)} + i * {sql.index_stream(0, 1) - draw.INDEX})::UHUGEINT", "k"
)
WIDE_NUMBERS = f"""numbers AS (SELECT n, list(v ORDER BY i) AS vs FROM
      (SELECT n, i, CAST({WIDE_HASH} // 2 % {WIDE_INT.cardinality} AS INTEGER) AS v
       FROM rows, range(1, {len(WIDE)}) c(i)) GROUP BY n)"""


@query(
    "prep_wide_rows",
    f"""SELECT {sql.domain_string(WIDE["user"], "rank_user.idx", SEED, 0)} AS "user", """
    + ", ".join(f"vs[{i}] AS {name}" for i, name in enumerate(WIDE) if name != "user")
    + " FROM numbers JOIN rank_user ON numbers.n = rank_user.n",
    (
        WIDE_ROWS,
        WIDE_NUMBERS,
        sql.zipf_table(WIDE_USER.cardinality, f"zipf_{WIDE_USER.cardinality}"),
        ranked_by_zipf("user", "rows", "n", WIDE["user"], 0),
    ),
)
def prep_wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of a user and 500 numbers per customer."""
    return generate.gen_wide_rows(spark, table(spark, sf_dir, "customer").count(), SEED)


SCALARS = [n for n in PAGE_VIEWS.names if n not in ("page_info", "page_links")]


@query(
    "prep_wide_group_by_data",
    f"""SELECT {", ".join(f'"{c}", "{c}" AS {c}_1, "{c}" AS {c}_2' for c in SCALARS)},
      {INFO_TEXT_SQL} AS page_info, {INFO_TEXT_SQL} AS page_info_1, {INFO_TEXT_SQL} AS page_info_2,
      {LINKS_TEXT_SQL} AS page_links, {LINKS_TEXT_SQL} AS page_links_1,
      {LINKS_TEXT_SQL} AS page_links_2 FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def prep_wide_group_by_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 27 columns, maps and bags as text."""
    wide = prep.make_wide_group_by_data(views.page_views(spark, sf_dir))
    texts = {"page_info": encode_map, "page_links": encode_bag}
    return wide.withColumns({f"{c}{n}": f(F.col(f"{c}{n}")) for c, f in texts.items() for n in ("", "_1", "_2")})
