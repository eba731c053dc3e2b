"""Text and catalog round trips over the given tables.

Each query writes rows derived from the tables to a fresh place in the shared folder, reads
them back through the operator under test, and returns what was read.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlog.functions import text
from viewlog.functions.scalars import COPY_SUFFIX, map_lookup
from viewlog.operators import joins, ordering, sets
from viewlog.plans import driver_views as views
from viewlog.plans import page_views as plans
from viewlog.plans.driver_views import PAGE_VIEWS_SQL, USERS_SQL, table
from viewlog.plans.oracle_sql import INFO_TEXT_SQL, LINKS_TEXT_SQL
from viewlog.plans.queries_page_views import stored
from viewlog.plans.registry import ORACLES, placed, query
from viewlog.schema import PAGE_VIEWS, ColSpec, TableSpec
from viewlog.session import scratch_path
from viewlog.sources import catalog, delimited, routing, specs

# ---- text ----

FLAT_COLUMNS = ["user", "action", "timespent", "query_term", "ip_addr", "timestamp"]


@query(
    "read_delimited",
    """SELECT "user", action, timespent, query_term, ip_addr, "timestamp", estimated_revenue
    FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def read_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "delimited")
    pv = views.page_views(spark, sf_dir).select(*FLAT_COLUMNS, "estimated_revenue")
    delimited.write_delimited(pv, path, text.FIELD_SEP)
    return delimited.read_delimited(spark, path, pv.schema)


@query(
    "write_delimited",
    """SELECT coalesce("user", '') || chr(9) || CAST(action AS VARCHAR) || chr(9)
      || coalesce(CAST(timespent AS VARCHAR), '') AS line FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def write_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tabbed")
    pv = views.page_views(spark, sf_dir).select("user", "action", "timespent")
    delimited.write_delimited(pv, path)
    return delimited.read_lines(spark, path)


def stored_page_views(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = scratch_path(spark, name)
    delimited.write_page_views(views.page_views(spark, sf_dir), path)
    return path


@query(
    "read_page_views",
    f"""SELECT "user", action, timespent, query_term, ip_addr, "timestamp", estimated_revenue,
      {INFO_TEXT_SQL} AS page_info, nullif({LINKS_TEXT_SQL}, '') AS page_links
    FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def read_page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back; maps and bags are printed again for the comparison.

    The text layout has one form for an empty and a null bag: an empty field, read as null.
    """
    path = stored_page_views(spark, sf_dir, "page-views")
    return stored(delimited.read_page_views(spark, path))


@query(
    "L1_text",
    """SELECT "user", CASE WHEN "user" IS NULL THEN 0 ELSE sum(greatest(coalesce(n_links, 1), 1)) END::BIGINT
      AS cnt FROM page_views GROUP BY "user" """,
    (PAGE_VIEWS_SQL,),
)
def l1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 from page views stored as text, which has one form for an empty and a null bag."""
    path = stored_page_views(spark, sf_dir, "l1-views")
    return plans.l1_links_per_user(delimited.read_page_views(spark, path, ["user", "action", "page_links"]))


@query("L12_text", ORACLES["L12"])
def l12_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L12 from page views stored as text."""
    path = stored_page_views(spark, sf_dir, "l12-views")
    columns = ["user", "action", "timespent", "query_term", "estimated_revenue"]
    return plans.l12_three_outputs(delimited.read_page_views(spark, path, columns))


@query(
    "decode_map",
    "SELECT info_a, info_c, CASE WHEN info_a IS NULL THEN 1 ELSE 2 END AS n_entries FROM page_views",
    (PAGE_VIEWS_SQL,),
)
def decode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_page_views(spark, sf_dir, "maps")
    lines = delimited.split_lines(delimited.read_lines(spark, path), PAGE_VIEWS.names)
    info = lines.select(text.decode_map(F.col("page_info")).alias("m"))
    return info.select(
        map_lookup(F.col("m"), "a").alias("info_a"),
        map_lookup(F.col("m"), "c").alias("info_c"),
        F.size("m").alias("n_entries"),
    )


@query(
    "decode_bag",
    """SELECT event_id % 13 AS lane, CAST(nullif(n_links, 0) AS INTEGER) AS n_links,
      CASE WHEN n_links > 0 THEN 'l' || CAST((event_id + n_links) % 13 AS VARCHAR) END AS last_b
    FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def decode_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bags")
    pv = views.page_views(spark, sf_dir)
    encoded = pv.select((F.col("event_id") % 13).alias("lane"), text.encode_bag(F.col("page_links")))
    delimited.write_delimited(encoded.toDF("lane", "links"), path, text.FIELD_SEP)
    read = delimited.read_delimited(spark, path, "lane bigint, links string")
    bags = read.select("lane", text.decode_bag(F.col("links")).alias("bag"))
    last = F.try_element_at("bag", F.lit(-1))
    return bags.select(
        "lane",
        F.when(F.col("bag").isNotNull(), F.size("bag")).alias("n_links"),
        map_lookup(last, "b").alias("last_b"),
    )


@query(
    "drop_malformed",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events
    WHERE event_type NOT IN ('error', 'view')""",
)
def drop_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are written a field short and views a field long; both must go."""
    return delimited.split_lines(
        delimited.drop_malformed(uneven_lines(spark, sf_dir), 3), ["event_id", "event_type"]
    )


@query(
    "count_malformed",
    """SELECT count(*) FILTER (event_type NOT IN ('error', 'view')) AS kept,
      count(*) FILTER (event_type IN ('error', 'view')) AS rejected FROM events""",
)
def count_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.count_malformed(uneven_lines(spark, sf_dir), 3)


def uneven_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, sep = F.col("event_type"), F.lit(text.FIELD_SEP)
    tail = (
        F.when(kind == "error", F.lit(""))
        .when(kind == "view", F.concat(sep, F.lit("x"), sep, F.lit("y")))
        .otherwise(F.concat(sep, F.lit("x")))
    )
    line = F.concat(F.col("event_id").cast("string"), sep, kind, tail)
    path = scratch_path(spark, "uneven")
    table(spark, sf_dir, "events").select(line.alias("line")).write.text(path)
    return delimited.read_lines(spark, path)


TUPLE_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer"""


@query("read_tuple_text", TUPLE_SQL)
def read_tuple_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tuples")
    names = ["c_custkey", "c_name", "c_mktsegment"]
    delimited.write_tuple_text(table(spark, sf_dir, "customer").select(*names), path)
    return delimited.read_tuple_text(spark, path, names)


@query(
    "write_tuple_text",
    """SELECT '(' || coalesce("user", '') || ',' || coalesce(query_term, '') || ')' AS line
    FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def write_tuple_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tuple-lines")
    pv = views.page_views(spark, sf_dir).select("user", "query_term")
    delimited.write_tuple_text(pv, path)
    return delimited.read_lines(spark, path)


@query(
    "read_lines",
    """SELECT unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents""",
)
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return delimited.read_lines(spark, path)


@query(
    "colocated_scan",
    """SELECT "user", count(*) AS n_rows, 1 AS n_splits FROM page_views GROUP BY "user" """,
    (PAGE_VIEWS_SQL,),
)
def colocated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per user and in how many tasks they were seen: one, by the promise."""
    scan = ordering.colocated_scan(views.page_views(spark, sf_dir).select("user"), "user")
    seen = scan.withColumn("split", F.spark_partition_id())
    per_split = seen.groupBy("user", "split").agg(F.count(F.lit(1)).alias("n_rows"))
    return per_split.groupBy("user").agg(
        F.sum("n_rows").alias("n_rows"), F.count("split").cast("int").alias("n_splits")
    )


@query(
    "route_write",
    """SELECT 'highest_value_page_per_user' AS route, "user" AS key,
      max(estimated_revenue) AS value FROM page_views
    WHERE "user" IS NOT NULL AND query_term IS NOT NULL GROUP BY "user"
    UNION ALL
    SELECT 'total_timespent_per_term', query_term, CAST(sum(timespent) AS DOUBLE)
    FROM page_views WHERE "user" IS NULL GROUP BY query_term
    UNION ALL
    SELECT 'queries_per_action', CAST(action AS VARCHAR), CAST(count(*) AS DOUBLE)
    FROM page_views WHERE "user" IS NOT NULL AND query_term IS NULL GROUP BY action""",
    (PAGE_VIEWS_SQL,),
)
def route_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three outputs of L12 in three directories, from one scan."""
    outputs = plans.l12_three_outputs(views.page_views(spark, sf_dir))
    root = scratch_path(spark, "routes")
    names = list(plans.l12_branches())
    routing.route_write(
        outputs, {f"{root}/{n}": (F.col("branch") == n, ["group", n]) for n in names}
    )
    read = [
        delimited.read_delimited(spark, f"{root}/{n}", "key string, value double", "\t").select(
            F.lit(n).alias("route"), "key", "value"
        )
        for n in names
    ]
    return sets.union_all(*read)


@query("route_by_value", "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders")
def route_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "by-status")
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    routing.route_by_value(orders, "o_orderstatus", path)
    return spark.read.parquet(path)


@query(
    "sorted_write",
    """SELECT "user", estimated_revenue, event_id, rank() OVER (ORDER BY "user" NULLS FIRST) AS place
    FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def sorted_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sorted")
    pv = views.page_views(spark, sf_dir).select("user", "estimated_revenue", "event_id")
    ordering.sorted_write(pv, path, F.col("user").asc_nulls_first())
    return placed(ordering.read_positions(spark, path), "user")


@query(
    "join_merge_bucketed",
    """SELECT "user", estimated_revenue, name, zip FROM page_views JOIN users ON "user" = name""",
    (PAGE_VIEWS_SQL, USERS_SQL),
)
def join_merge_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge join of two stored tables bucketed and sorted by the key: no shuffle of either."""
    root = scratch_path(spark, "bucketed")
    suffix = root.rsplit("-", 1)[1]
    pv = views.page_views(spark, sf_dir).select("user", "estimated_revenue")
    people = views.users(spark, sf_dir).select("name", "zip")
    buckets = ordering.parts_for(pv)
    for df, kind, key in ((pv, "views", "user"), (people, "users", "name")):
        ordering.write_bucketed(df, f"bucketed_{kind}_{suffix}", key, buckets, f"{root}/{kind}", False)
    left, right = spark.table(f"bucketed_views_{suffix}"), spark.table(f"bucketed_users_{suffix}")
    return joins.join_merge(left, right, "user", "name", bucketed=True)


# ---- catalog tables ----

ORDER_SQL = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders"


def order_spec(name: str) -> TableSpec:
    """Orders as a catalog table with one partition per status."""
    return TableSpec(
        name=name,
        database="default",
        columns=(
            ("o_orderkey", ColSpec("long")),
            ("o_custkey", ColSpec("long")),
            ("o_totalprice", ColSpec("double")),
        ),
        partitions=(("o_orderstatus", ColSpec("string", avg_length=1)),),
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"
    )


def fresh_table(spark: SparkSession, kind: str) -> tuple[TableSpec, str]:
    """An empty catalog table and the folder around it, both new for each call."""
    root = scratch_path(spark, kind)
    spec = order_spec(f"{kind}_{root.rsplit('-', 1)[1]}".replace("-", "_"))
    catalog.create_table(spark, spec, f"{root}/table")
    return spec, root


def loaded_table(spark: SparkSession, sf_dir: str, kind: str) -> tuple[TableSpec, str]:
    spec, root = fresh_table(spark, kind)
    catalog.store_catalog(order_rows(spark, sf_dir), spec.qualified)
    return spec, root


@query("create_table", "SELECT count(*) - count(*) AS n_rows, 4 AS n_columns FROM orders")
def create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creating a table again leaves it and its rows alone; a dropped one starts empty."""
    spec, root = loaded_table(spark, sf_dir, "created")
    catalog.create_table(spark, spec, f"{root}/table")
    again = catalog.load_catalog(spark, spec.qualified).count()
    if again != order_rows(spark, sf_dir).count():
        raise AssertionError(f"creating the table again left {again} rows")
    catalog.drop_table(spark, spec.qualified)
    catalog.create_table(spark, spec, f"{root}/other")
    empty = catalog.load_catalog(spark, spec.qualified)
    return empty.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(empty.columns))
    )


@query("store_catalog", ORDER_SQL)
def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _ = loaded_table(spark, sf_dir, "stored")
    return catalog.load_catalog(spark, spec.qualified)


@query("load_catalog", ORDER_SQL)
def load_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table under its catalog schema."""
    spec, _ = loaded_table(spark, sf_dir, "scanned")
    return catalog.load_catalog(spark, spec.qualified)


@query(
    "list_partitions",
    "SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS partition FROM orders",
)
def list_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _ = loaded_table(spark, sf_dir, "listed")
    return catalog.list_partitions(spark, spec.qualified)


@query(
    "partition_sizes",
    "SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY o_orderstatus",
)
def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _ = loaded_table(spark, sf_dir, "sized")
    return catalog.partition_sizes(spark, spec.qualified)


@query("add_partition", ORDER_SQL)
def add_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written next to the catalog become rows once their partitions are registered."""
    spec, root = fresh_table(spark, "added")
    routing.route_by_value(order_rows(spark, sf_dir), "o_orderstatus", f"{root}/table")
    statuses = order_rows(spark, sf_dir).select("o_orderstatus").distinct().collect()
    for row in statuses * 2:  # the second time it is there already
        catalog.add_partition(spark, spec.qualified, {"o_orderstatus": row["o_orderstatus"]})
    return catalog.load_catalog(spark, spec.qualified)


@query(
    "add_partitions",
    "SELECT o_custkey % 600 AS part, count(*) AS n_rows FROM orders GROUP BY ALL",
)
def add_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 600 partitions registered by one statement, then their rows by their statistics."""
    root, name = scratch_path(spark, "many"), f"many_{uuid.uuid4().hex[:12]}"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 600).cast("int").alias("part"))
    rows.hint("rebalance", "part").write.partitionBy("part").parquet(root)
    spark.sql(f"CREATE TABLE {name} (o_orderkey BIGINT, part INT) USING parquet PARTITIONED BY (part) LOCATION '{root}'")
    parts = [r["part"] for r in rows.select("part").distinct().collect()]  # 600 at most
    catalog.add_partitions(spark, name, [{"part": p} for p in parts])
    catalog.analyze_table(spark, name)
    return catalog.partition_sizes(spark, name).select(F.col("part").cast("bigint").alias("part"), "n_rows")


@query("check_row_count", "SELECT count(*) AS written FROM orders")
def check_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check counts the lines that the files hold."""
    path = scratch_path(spark, "counted")
    rows = order_rows(spark, sf_dir)
    catalog.check_row_count(
        rows,
        rows.count(),
        lambda df: delimited.write_delimited(df, path, catalog.TEXT_SEP),
        lambda: delimited.read_lines(spark, path).count(),
    )
    return delimited.read_lines(spark, path).agg(F.count(F.lit(1)).alias("written"))


def counted(spec: TableSpec, spark: SparkSession, sf_dir: str) -> TableSpec:
    """The spec with the number of rows its table must have."""
    return replace(spec, rows=order_rows(spark, sf_dir).count())


def text_orders(spark: SparkSession, sf_dir: str, root: str) -> str:
    path = f"{root}/input"
    delimited.write_delimited(order_rows(spark, sf_dir), path, catalog.TEXT_SEP)
    return path


@query("text_to_text", ORDER_SQL)
def text_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "text-text")
    spec = counted(order_spec("unused"), spark, sf_dir)
    catalog.text_to_text(spark, spec, text_orders(spark, sf_dir, root), f"{root}/output")
    return delimited.read_delimited(spark, f"{root}/output", spec.struct, "\t")


@query("text_to_catalog", ORDER_SQL)
def text_to_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, root = fresh_table(spark, "text_catalog")
    spec = counted(spec, spark, sf_dir)
    catalog.text_to_catalog(spark, spec, text_orders(spark, sf_dir, root))
    return catalog.load_catalog(spark, spec.qualified)


@query("catalog_to_text", ORDER_SQL)
def catalog_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, root = loaded_table(spark, sf_dir, "catalog_text")
    catalog.catalog_to_text(spark, counted(spec, spark, sf_dir), f"{root}/output")
    return delimited.read_delimited(spark, f"{root}/output", spec.struct, "\t")


@query("catalog_to_catalog", ORDER_SQL)
def catalog_to_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, root = loaded_table(spark, sf_dir, "catalog_catalog")
    catalog.copy_table(spark, spec, f"{root}/copy")
    catalog.catalog_to_catalog(spark, counted(spec, spark, sf_dir))
    return catalog.load_catalog(spark, spec.qualified + COPY_SUFFIX)


@query("drop_table", "SELECT count(*) AS n_before, 0 AS n_tables FROM orders")
def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before the drop, tables of that name after it; a second drop does nothing."""
    spec, _ = loaded_table(spark, sf_dir, "dropped")
    before = catalog.load_catalog(spark, spec.qualified).count()
    for _ in range(2):
        catalog.drop_table(spark, spec.qualified)
    left = int(spark.catalog.tableExists(spec.qualified))
    orders = order_rows(spark, sf_dir)
    return orders.agg(F.max(F.lit(before)).cast("bigint").alias("n_before")).withColumn(
        "n_tables", F.lit(left)
    )


@query(
    "describe_table",
    """SELECT lower(column_name) AS col_name,
      CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS data_type
    FROM (DESCRIBE SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders)""",
)
def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _ = loaded_table(spark, sf_dir, "described")
    described = catalog.describe_table(spark, spec.qualified).select("col_name", "data_type")
    return described.filter(F.col("col_name").isin(spec.struct.names)).distinct()


# ---- table specs ----


def spec_files(spark: SparkSession, sf_dir: str) -> str:
    """Spec files with a table per customer, in none to two copies; 500 customers to a file."""
    element = F.format_string(
        "<table><namePrefix>%s</namePrefix><dbName>db%d</dbName><columns>"
        "<column><name>balance</name><type>int</type><distribution>uniform</distribution>"
        "<cardinality>%d</cardinality><percentageNull>%d</percentageNull></column>"
        "</columns><instances><instance><size>%d</size><count>%d</count></instance>"
        "<instance><size>7</size><count>0</count></instance></instances></table>",
        F.col("c_name"),
        F.col("c_nationkey"),
        F.col("c_custkey") + 1,
        F.col("c_nationkey"),
        F.col("c_custkey"),
        F.col("c_nationkey") % 3,
    )
    path = scratch_path(spark, "specs")
    numbered = table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 500).alias("file"), element.alias("table")
    )
    documents = numbered.groupBy("file").agg(
        F.concat(
            F.lit("<database><tables>"),
            F.array_join(F.collect_list("table"), ""),
            F.lit("</tables></database>"),
        ).alias("line")
    )
    documents.write.partitionBy("file").text(path)
    return path


@query(
    "read_table_specs",
    """SELECT c_name || '_' || c_custkey || '_' || i AS name, 'db' || c_nationkey AS database,
      c_custkey AS rows, 'balance' AS column_name, false AS is_partition, 'int' AS dtype,
      CAST(c_custkey + 1 AS BIGINT) AS cardinality, 'uniform' AS distribution,
      c_nationkey AS percent_null, CAST(NULL AS VARCHAR) AS problem
    FROM (SELECT c_name, c_custkey, c_nationkey, unnest(range(c_nationkey % 3)) AS i FROM customer)""",
)
def read_table_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of which ``specs.read_table_specs`` makes its tables, rules applied."""
    tables = specs.expand_instances(specs.read_spec_rows(spark, spec_files(spark, sf_dir)))
    return specs.spec_columns(tables).select(
        "name", "database", "rows", "column_name", "is_partition", "dtype", "cardinality",
        "distribution", "percent_null", "problem",
    )


@query(
    "expand_instances",
    """SELECT c_name || '_' || c_custkey || '_' || i AS name, c_custkey AS rows, dbName
    FROM (SELECT c_name, c_custkey, 'db' || c_nationkey AS dbName,
            unnest(range(c_nationkey % 3)) AS i FROM customer)""",
)
def expand_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = specs.expand_instances(specs.read_spec_rows(spark, spec_files(spark, sf_dir)))
    return tables.select("name", "rows", "dbName")
