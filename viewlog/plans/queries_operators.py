"""One query per relational operator over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewlog.functions import scalars, text
from viewlog.operators import aggregates, bitmaps, joins, ordering, sets, shaping
from viewlog.operators.exact_sum import exact_sum, exact_sum_sql
from viewlog.plans import driver_views as views
from viewlog.plans.driver_views import (
    FLAT_LINKS_SQL,
    PAGE_VIEWS_SQL,
    POWER_USERS_SQL,
    SAMPLES_SQL,
    USERS_SQL,
    table,
)
from viewlog.plans.oracle_sql import keep_percent
from viewlog.plans.page_views import flattened_headers
from viewlog.plans.registry import placed, query, rounded
from viewlog.session import scratch_path
from viewlog.streaming.intervals import minute_of

# ---- projections, casts, filters ----


@query("project", "SELECT c_custkey, c_name FROM customer")
def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.project(table(spark, sf_dir, "customer"), "c_custkey", "c_name")


@query("project_positional", "SELECT s_suppkey, s_acctbal FROM supplier")
def project_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.project_positional(table(spark, sf_dir, "supplier"), 0, 3)


@query("rename", "SELECT p_partkey AS part, p_brand AS brand, p_size FROM part")
def rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return shaping.rename(parts, {"p_partkey": "part", "p_brand": "brand"})


@query(
    "cast",
    """SELECT event_id, CAST(trunc(value) AS INTEGER) AS whole, TRY_CAST(event_type AS INTEGER) AS bad,
      CAST(trunc(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS INTEGER) AS from_text,
      TRY_CAST(CAST(user_id AS VARCHAR) AS DOUBLE) AS as_double
    FROM events""",
)
def cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        scalars.to_int(F.col("value")).alias("whole"),
        scalars.to_int(F.col("event_type")).alias("bad"),
        scalars.text_to_int(F.col("value").cast("string")).alias("from_text"),
        F.col("user_id").cast("string").try_cast("double").alias("as_double"),
    )


@query(
    "bincond",
    """SELECT event_id, CASE WHEN timespent IS NULL THEN NULL WHEN timespent > 10 THEN 'long'
      ELSE 'short' END AS stay FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def bincond(spark: SparkSession, sf_dir: str) -> DataFrame:
    stay = scalars.bincond(F.col("timespent") > 10, F.lit("long"), F.lit("short"))
    return views.page_views(spark, sf_dir).select("event_id", stay.alias("stay"))


@query(
    "map_lookup",
    "SELECT event_id, info_a, info_c, CAST(NULL AS VARCHAR) AS info_z FROM page_views",
    (PAGE_VIEWS_SQL,),
)
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.col("page_info")
    return views.page_views(spark, sf_dir).select(
        "event_id", *[scalars.map_lookup(info, k).alias(f"info_{k}") for k in "acz"]
    )


@query(
    "flatten_bag",
    'SELECT "user", CASE WHEN action = 1 THEN info_a ELSE link_b END AS header FROM flat',
    (PAGE_VIEWS_SQL, FLAT_LINKS_SQL),
)
def flatten_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flattened_headers(views.page_views(spark, sf_dir))


@query(
    "flatten_tuple",
    """SELECT action, query_term, count(*) AS n_views FROM page_views GROUP BY action, query_term""",
    (PAGE_VIEWS_SQL,),
)
def flatten_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = views.page_views(spark, sf_dir)
    return pv.groupBy("action", "query_term").agg(F.count(F.lit(1)).alias("n_views"))


@query(
    "filter_null",
    """SELECT event_id, 'no user' AS kind FROM page_views WHERE "user" IS NULL
    UNION ALL
    SELECT event_id, 'both known' FROM page_views
    WHERE "user" IS NOT NULL AND query_term IS NOT NULL""",
    (PAGE_VIEWS_SQL,),
)
def filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = views.page_views(spark, sf_dir).select("event_id", "user", "query_term")
    unknown = shaping.filter_null(pv, "user").select("event_id", F.lit("no user").alias("kind"))
    known = shaping.filter_not_null(pv, "user", "query_term")
    return sets.union_all(unknown, known.select("event_id", F.lit("both known").alias("kind")))


@query(
    "filter_compare",
    """SELECT event_id, timespent FROM page_views WHERE "timestamp" < 43200 AND timespent >= 5""",
    (PAGE_VIEWS_SQL,),
)
def filter_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = views.page_views(spark, sf_dir)
    return pv.filter((F.col("timestamp") < 43200) & (F.col("timespent") >= 5)).select(
        "event_id", "timespent"
    )


@query(
    "split",
    """SELECT 'cheap' AS branch, count(*) AS n_rows FROM page_views WHERE estimated_revenue < 50
    UNION ALL
    SELECT 'short', count(*) FROM page_views WHERE timespent < 10""",
    (PAGE_VIEWS_SQL,),
)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = shaping.split(
        views.page_views(spark, sf_dir),
        {"cheap": F.col("estimated_revenue") < 50, "short": F.col("timespent") < 10},
    )
    counts = [
        rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("branch"), "n_rows")
        for name, rows in branches.items()
    ]
    return sets.union_all(*counts)


@query(
    "widen",
    """SELECT c_custkey, c_name, c_custkey AS c_custkey_1, c_name AS c_name_1,
      c_custkey AS c_custkey_2, c_name AS c_name_2 FROM customer""",
)
def widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.widen(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 3)


# ---- joins ----


@query(
    "join_replicated",
    """SELECT c_custkey, c_nationkey, n_nationkey, n_name FROM customer
    JOIN nation ON c_nationkey = n_nationkey""",
)
def join_replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return joins.join_replicated(customers, nations, "c_nationkey", "n_nationkey")


@query(
    "semi_join_set",
    "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)",
)
def semi_join_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem")
    return joins.semi_join_set(suppliers, lines, "s_suppkey", "l_suppkey")


@query(
    "join_inner",
    """SELECT l_orderkey, l_linenumber, o_orderkey, o_custkey FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey""",
)
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.join_inner(lines, orders, "l_orderkey", "o_orderkey")


@query(
    "join_then_group_same_key",
    """SELECT l_orderkey, round(sum(l_extendedprice), 4) AS price FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""",
)
def join_then_group_same_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    summed = joins.join_then_sum(
        lines, orders, "l_orderkey", "o_orderkey", "l_extendedprice", "price"
    )
    return rounded(summed, 4, "price")


@query(
    "cogroup",
    """SELECT coalesce(v.k, u.k) AS name, n_views, longest, n_users
    FROM (SELECT "user" AS k, count(*) AS n_views, max(timespent) AS longest
          FROM page_views GROUP BY "user") v
    FULL JOIN (SELECT name AS k, count(*) AS n_users FROM users GROUP BY name) u ON v.k = u.k""",
    (PAGE_VIEWS_SQL, USERS_SQL),
)
def cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.cogroup(
        views.page_views(spark, sf_dir),
        views.users(spark, sf_dir),
        "user",
        "name",
        [F.count(F.lit(1)).alias("n_views"), F.max("timespent").alias("longest")],
        [F.count(F.lit(1)).alias("n_users")],
        alias="name",
    )


@query(
    "anti_join",
    """SELECT c_custkey FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""",
)
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, events = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    return joins.anti_join(customers, events, "c_custkey", "user_id")


@query(
    "join_left_outer",
    """SELECT event_id, "user", name, zip FROM page_views LEFT JOIN users ON "user" = name""",
    (PAGE_VIEWS_SQL, USERS_SQL),
)
def join_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = views.page_views(spark, sf_dir).select("event_id", "user")
    return joins.join_left_outer(
        left, views.users(spark, sf_dir).select("name", "zip"), "user", "name"
    )


@query(
    "join_merge",
    """SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment FROM orders
    JOIN customer ON o_custkey = c_custkey""",
)
def join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return joins.join_merge(orders, customers, "o_custkey", "c_custkey")


@query(
    "join_skewed_key",
    """SELECT event_id, "user", query_term, term, n_views FROM page_views
    LEFT JOIN (SELECT query_term AS term, count(*) AS n_views FROM page_views GROUP BY query_term) t
      ON query_term = term""",
    (PAGE_VIEWS_SQL,),
)
def join_skewed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six terms and a large null share: every key is hot at this limit and is cut."""
    pv = views.page_views(spark, sf_dir).select("event_id", "user", "query_term")
    terms = pv.groupBy(F.col("query_term").alias("term")).agg(F.count(F.lit(1)).alias("n_views"))
    return joins.join_skewed_key(pv, terms, "query_term", "term", "left", hot_rows=500)


@query(
    "join_prefiltered",
    """SELECT l_orderkey, l_linenumber, p_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE p_size = 7""",
)
def join_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A right side that is not broadcast (limit 0): lines of other parts go before the shuffle."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").filter("p_size = 7").select("p_partkey", "p_size")
    joined = joins.join_replicated(lines, parts, "l_partkey", "p_partkey", limit=0, spread_by=F.col("l_orderkey"))
    return joined.drop("l_partkey")


# ---- aggregates ----


@query(
    "group_by",
    'SELECT "user", count(*) AS n_rows FROM page_views GROUP BY "user"',
    (PAGE_VIEWS_SQL,),
)
def group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page_views(spark, sf_dir).groupBy("user").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "group_all",
    """SELECT count(*) AS n_rows, min(l_shipdate) AS first_ship, max(l_quantity) AS most
    FROM lineitem""",
)
def group_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_quantity").alias("most"),
    )


@query(
    "count_bag",
    """SELECT query_term, count("user") AS n_views FROM page_views GROUP BY query_term""",
    (PAGE_VIEWS_SQL,),
)
def count_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = views.page_views(spark, sf_dir)
    return pv.groupBy("query_term").agg(aggregates.count_bag("user").alias("n_views"))


@query(
    "sum",
    """SELECT l_partkey, sum(l_quantity) AS quantity, CAST(sum(l_linenumber) AS BIGINT) AS numbers
    FROM lineitem GROUP BY l_partkey""",
)
def sum_(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_linenumber").alias("numbers")
    )


@query(
    "avg",
    """SELECT action, round(avg(estimated_revenue), 6) AS mean_revenue FROM page_views
    GROUP BY action""",
    (PAGE_VIEWS_SQL,),
)
def avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = views.page_views(spark, sf_dir)
    means = pv.groupBy("action").agg(F.avg("estimated_revenue").alias("mean_revenue"))
    return rounded(means, 6, "mean_revenue")


@query(
    "max",
    "SELECT o_custkey, max(o_totalprice) AS highest FROM orders GROUP BY o_custkey",
)
def max_(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("highest"))


@query(
    "count_distinct",
    """SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey""",
)
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_distinct(
        table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "n_parts"
    )


@query(
    "multi_distinct",
    """SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts,
      sum(DISTINCT l_quantity) AS quantities,
      CAST(trunc(avg(DISTINCT l_linenumber)) AS INTEGER) AS mean_number
    FROM lineitem GROUP BY l_suppkey""",
)
def multi_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.count_distinct("l_partkey").alias("n_parts"),
            F.sum_distinct("l_quantity").alias("quantities"),
            aggregates.int_mean_distinct(F.col("l_linenumber")).alias("mean_number"),
        )
    )


@query(
    "conditional_count",
    """SELECT o_custkey, count(CASE WHEN o_totalprice < 100000 THEN 1 END) AS small,
      count(CASE WHEN o_totalprice >= 100000 THEN 1 END) AS large
    FROM orders GROUP BY o_custkey""",
)
def conditional_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_custkey")
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            aggregates.conditional_count(price < 100000, key).alias("small"),
            aggregates.conditional_count(price >= 100000, key).alias("large"),
        )
    )


@query(
    "ordered_sum",
    f"""SELECT c_nationkey, {exact_sum_sql("c_acctbal")} AS balance FROM customer GROUP BY c_nationkey""",
)
def ordered_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bits in any order, so no order has to be made; compared without rounding."""
    return exact_sum(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "balance")


@query(
    "bitmap_distinct",
    """SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_linenumber) AS n_numbers
    FROM lineitem GROUP BY l_suppkey""",
)
def bitmap_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts and line numbers per supplier, from bitmaps stored by return flag."""
    path = scratch_path(spark, "bitmaps")
    lines = table(spark, sf_dir, "lineitem")
    bitmaps.append_bitmaps(
        lines, path, ["l_suppkey"], ["l_partkey", "l_linenumber"], F.col("l_returnflag"), "l_returnflag"
    )
    return bitmaps.stored_counts(
        spark, path, ["l_suppkey"], {"l_partkey": "n_parts", "l_linenumber": "n_numbers"}
    )


@query(
    "wide_key_group",
    """SELECT l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
      count(*) AS n_lines FROM lineitem
    GROUP BY l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus""",
)
def wide_key_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = "l_suppkey l_linenumber l_quantity l_discount l_tax l_returnflag l_linestatus".split()
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "partial_final",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n_lines
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def partial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six groups hold all rows; each task sends six partial rows to the shuffle."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n_lines")
    )


@query(
    "timing_stats",
    """SELECT tag, round(avg(elapsed_ms), 6) AS mean, min(elapsed_ms) AS min,
      max(elapsed_ms) AS max, round(stddev_pop(elapsed_ms), 6) AS stddev,
      count(elapsed_ms) AS count
    FROM samples GROUP BY tag""",
    (SAMPLES_SQL,),
)
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.timing_samples(spark, sf_dir)
    stats = aggregates.timing_stats(samples, ["tag"], F.col("elapsed_ms"))
    return rounded(stats, 6, "mean", "stddev")


# ---- orders, samples, partitions ----


@query(
    "order_single",
    """SELECT event_id, "user", query_term, rank() OVER (ORDER BY "user" NULLS FIRST) AS place
    FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def order_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = views.page_views(spark, sf_dir).select("event_id", "user", "query_term")
    ordered = ordering.order_total(pv, F.col("user").asc_nulls_first(), tie=F.col("event_id"))
    return stored_order(ordered, "user")


@query(
    "order_multi",
    """SELECT o_orderkey, o_orderpriority, o_totalprice, o_custkey,
      rank() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_custkey) AS place FROM orders""",
)
def order_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey"
    )
    ordered = ordering.order_total(
        orders,
        F.col("o_orderpriority").asc_nulls_first(),
        F.col("o_totalprice").desc_nulls_last(),
        F.col("o_custkey").asc_nulls_first(),
        tie=F.col("o_orderkey"),
    )
    return stored_order(ordered, "o_orderpriority", "o_totalprice", "o_custkey")


@query(
    "range_partition_skewed",
    """SELECT count(*) AS n_rows, sum(event_id)::BIGINT AS ids, 8 AS n_parts, true AS in_order,
      true AS even FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def range_partition_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parts hold: ranges that do not overlap, none with twice its share of the rows."""
    pv = views.page_views(spark, sf_dir).select("event_id", "query_term")
    cut = ordering.range_partition_skewed(pv, 8, F.col("query_term").asc_nulls_first())
    # A null sorts before any text; one sign before each text tells them apart.
    key = F.coalesce(F.concat(F.lit("+"), "query_term"), F.lit(""))
    parts = cut.groupBy(F.spark_partition_id().alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.min(key).alias("low"), F.max(key).alias("high")
    )
    before = Window.orderBy("part")  # over one row per part
    parts = parts.withColumn("last", F.lag("high").over(before))
    return parts.agg(
        F.sum("n").alias("n_rows"),
        F.sum("ids").alias("ids"),
        F.count(F.lit(1)).cast("int").alias("n_parts"),
        F.bool_and(F.coalesce(F.col("last") <= F.col("low"), F.lit(True))).alias("in_order"),
        (F.max("n") <= 2 * F.sum("n") / F.count(F.lit(1))).alias("even"),
    )


@query(
    "nested_order",
    """SELECT "user", estimated_revenue, event_id,
      rank() OVER (ORDER BY "user" NULLS FIRST, estimated_revenue NULLS FIRST) AS place
    FROM page_views""",
    (PAGE_VIEWS_SQL,),
)
def nested_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = views.page_views(spark, sf_dir).select("user", "estimated_revenue", "event_id")
    ordered = ordering.nested_order(pv, "user", F.col("estimated_revenue").asc_nulls_first())
    return stored_order(ordered, "user", "estimated_revenue")


@query(
    "top_k",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""",
)
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordering.top_k(orders, 500, F.col("o_totalprice").desc(), "o_orderkey")


@query("sample", f"SELECT c_custkey, c_name FROM customer WHERE {keep_percent('c_custkey', 50, 3)}")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return ordering.sample_by_key(customers, "c_custkey", 50, seed=3)


@query(
    "parallelism",
    "SELECT count(*) AS n_rows, sum(o_orderkey)::BIGINT AS keys, 16 AS n_parts, true AS even FROM orders",
)
def parallelism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parts hold: sixteen, none with a tenth more than its share and a few rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = (
        ordering.parallelism(orders, 16)
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    )
    return parts.agg(
        F.sum("n").alias("n_rows"),
        F.sum("keys").alias("keys"),
        F.count(F.lit(1)).cast("int").alias("n_parts"),
        (F.max("n") <= 1.1 * F.sum("n") / 16 + 16).alias("even"),
    )


def stored_order(ordered: DataFrame, *keys: str) -> DataFrame:
    """An order written to files and read back, each row with the place of its key."""
    path = scratch_path(ordered.sparkSession, "ordered")
    ordered.write.parquet(path)
    return placed(ordering.read_positions(ordered.sparkSession, path), *keys)


# ---- set operations ----


@query(
    "distinct",
    'SELECT DISTINCT "user", query_term FROM page_views',
    (PAGE_VIEWS_SQL,),
)
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.distinct(views.page_views(spark, sf_dir).select("user", "query_term"))


@query(
    "union_all",
    """SELECT "user" AS name FROM page_views UNION ALL SELECT name FROM users
    UNION ALL SELECT name FROM power_users""",
    (PAGE_VIEWS_SQL, USERS_SQL, POWER_USERS_SQL),
)
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_all(
        views.page_views(spark, sf_dir).select(F.col("user").alias("name")),
        views.users(spark, sf_dir).select("name"),
        views.power_users(spark, sf_dir).select("name"),
    )


@query(
    "union_distinct",
    """SELECT "user" AS name FROM page_views UNION SELECT name FROM users""",
    (PAGE_VIEWS_SQL, USERS_SQL),
)
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_distinct(
        views.page_views(spark, sf_dir).select(F.col("user").alias("name")),
        views.users(spark, sf_dir).select("name"),
    )


# ---- scalar functions ----


@query(
    "split_fields",
    """SELECT event_id, nullif(split_part(line, '|', 1), '') AS a,
      nullif(split_part(line, '|', 2), '') AS b, nullif(split_part(line, '|', 3), '') AS c,
      len(string_split(line, '|')) AS n_fields
    FROM (SELECT event_id, coalesce("user", '') || '|' || coalesce(query_term, '') || '|' AS line
          FROM page_views)""",
    (PAGE_VIEWS_SQL,),
)
def split_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.lit("")
    line = F.concat(F.coalesce("user", empty), F.lit("|"), F.coalesce("query_term", empty), F.lit("|"))
    fields = views.page_views(spark, sf_dir).select("event_id", text.split_fields(line, "|").alias("f"))
    named = [F.col("f")[i].alias(n) for i, n in enumerate("abc")]
    return fields.select("event_id", *named, F.size("f").cast("bigint").alias("n_fields"))


@query(
    "replace_separator",
    """SELECT event_id, coalesce("user", '') || chr(9) || event_type AS line
    FROM page_views JOIN (SELECT event_id, event_type FROM events) USING (event_id)""",
    (PAGE_VIEWS_SQL,),
)
def replace_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = views.page_views(spark, sf_dir)
    line = F.concat_ws(text.FIELD_SEP, F.coalesce("user", F.lit("")), F.col("page_info")["c"])
    return pv.select("event_id", F.translate(line, text.FIELD_SEP, "\t").alias("line"))


@query(
    "table_names",
    """SELECT s_suppkey, 'db' || CAST(s_nationkey AS VARCHAR) || '.' || s_name AS qualified,
      s_name || '_copy' AS copy, s_name AS original, '/data/' || s_name || '/' AS dir,
      'nation=' || CAST(s_nationkey AS VARCHAR) AS partition_dir
    FROM supplier""",
)
def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    database = F.concat(F.lit("db"), F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        scalars.qualified_name(database, name).alias("qualified"),
        scalars.copy_name(name).alias("copy"),
        scalars.original_name(scalars.copy_name(name)).alias("original"),
        scalars.with_slash(F.concat(F.lit("/data/"), name)).alias("dir"),
        scalars.partition_dir("nation", F.col("s_nationkey")).alias("partition_dir"),
    )


@query(
    "format_duration",
    """SELECT event_id, CASE WHEN ms IS NULL THEN '-' ELSE
        CASE WHEN ms >= 3600000 THEN CAST(ms // 3600000 AS VARCHAR) || 'h' ELSE '' END
        || CASE WHEN ms // 60000 % 60 > 0 THEN CAST(ms // 60000 % 60 AS VARCHAR) || 'm' ELSE '' END
        || CASE WHEN ms % 60000 > 0 OR ms = 0 THEN CAST(ms % 60000 // 1000 AS VARCHAR) || '.'
          || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 's' ELSE '' END END AS printed,
      coalesce(CAST(timespent AS VARCHAR), '0') AS counted
    FROM (SELECT event_id, timespent,
            CASE WHEN timespent IS NULL THEN NULL ELSE event_id * 500 * timespent END AS ms
          FROM page_views)""",
    (PAGE_VIEWS_SQL,),
)
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.col("event_id") * 500 * F.col("timespent")
    return views.page_views(spark, sf_dir).select(
        "event_id",
        scalars.format_duration(millis).alias("printed"),
        scalars.format_count(F.col("timespent")).alias("counted"),
    )


@query(
    "floor_to_checkpoint",
    """SELECT start_minute AS minute, start_minute - start_minute % 15 AS checkpoint, count(*) AS n
    FROM samples GROUP BY start_minute""",
    (SAMPLES_SQL,),
)
def floor_to_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = views.timing_samples(spark, sf_dir).groupBy(minute_of(F.col("start")).alias("minute"))
    return minutes.agg(F.count(F.lit(1)).alias("n")).select(
        "minute", scalars.floor_to(F.col("minute"), 15).alias("checkpoint"), "n"
    )
