"""Removal of lines that many sites share.

A line (white space around it cut off) is boilerplate if documents of at least ``min_sites``
distinct sites hold it. The sites of each line are counted by HyperLogLog sketches, which merge
on the map side; lines whose estimate is near the limit get an exact distinct count. A
boilerplate line stays where it occurs first (smallest doc_id, then position) and goes
everywhere else, so no text vanishes from the corpus.

Only DataFrame functions are used. A hot line is one sketch per map task; the table of
boilerplate lines is broadcast only after its rows were counted.

Defined results: lines without a word are never removed; a null text has no lines and stays
null; a null site counts as no site; a null doc_id comes last; rows that share a doc_id are
treated alike; an empty table gives an empty one. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlog.session import scratch_path

MIN_SITES = 10
SKETCH_LG_K = 10  # standard error about 3 %
NEAR_LOW, NEAR_HIGH = 0.8, 1.25
BROADCAST_ROWS = 200_000

_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _keys(line: Column) -> list[Column]:
    plain = F.regexp_replace(line, _TRIM, "")
    return [F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(17), plain).alias("h2")]


def line_table(docs: DataFrame, site: str) -> DataFrame:
    """(h1, h2, site, doc_id, pos) of every line that has a word."""
    rows = docs.select("doc_id", F.col(f"`{site}`").cast("string").alias("site"), "text")
    rows = rows.select("doc_id", "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*_keys(F.col("line")), "site", "doc_id", "pos")


def _by_count(df: DataFrame, path: str) -> DataFrame:
    """Store a small side; broadcast it if it has few rows."""
    df.write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def boilerplate_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first): the shared lines and where each stays."""
    spark = docs.sparkSession
    lines = line_table(docs, site)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(SKETCH_LG_K)).alias("sketch"), F.min(place).alias("first")
    )
    estimate = F.hll_sketch_estimate("sketch")
    path = scratch_path(spark, "spread-lines")
    sketched.withColumn("sites", estimate).filter(
        F.col("sites") >= int(min_sites * NEAR_LOW)
    ).drop("sketch").write.parquet(path)
    spread = spark.read.parquet(path)
    sure = spread.filter(F.col("sites") > min_sites * NEAR_HIGH).select("h1", "h2", "first")
    near = spread.filter(F.col("sites") <= min_sites * NEAR_HIGH)
    small = near.count() <= BROADCAST_ROWS
    wanted = near.select("h1", "h2")
    exact = (
        lines.join(F.broadcast(wanted) if small else wanted, ["h1", "h2"])
        .filter(F.col("site").isNotNull())
        .groupBy("h1", "h2", "site")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("exact_sites"))
        .filter(F.col("exact_sites") >= min_sites)
    )
    return sure.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def removed_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, removed): positions of the lines that go, for documents that lose any."""
    spark = docs.sparkSession
    shared = _by_count(
        boilerplate_lines(docs, site, min_sites), scratch_path(spark, "boilerplate-lines")
    )
    lost = line_table(docs, site).join(shared, ["h1", "h2"])
    elsewhere = ~(
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))
    )
    return (
        lost.filter(elsewhere)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    )


def mark_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """All rows as (doc, kept_text, n_lines, n_removed); doc holds the columns as they came."""
    spark = docs.sparkSession
    removed = _by_count(
        removed_lines(docs, site, min_sites).withColumnRenamed("doc_id", "lost_id"),
        scratch_path(spark, "removed-lines"),
    )
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.col("doc_id").alias("own_id"),
        _lines(F.col("text")).alias("lines"),
    ).join(removed, F.col("own_id").eqNullSafe(F.col("lost_id")), "left")
    # By positions, as a look into the removed ones for each line would be lines x removed.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    kept = F.transform(stay, lambda i: F.get("lines", i))
    text = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(
        "doc",
        text.alias("kept_text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents without shared lines, with their own columns.

    A document that keeps no word is dropped: all it held stands in earlier documents. n_chars,
    if there is one, follows the text.
    """
    marked = mark_lines(docs, site, min_sites)
    marked = marked.filter(
        (F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    )
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_removed") == 0, F.col("doc.n_chars")).otherwise(
            F.length("kept_text").cast(kind)
        )
    return marked.select(
        *(changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns)
    )


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, source, pos - 1 AS pos, line,
    regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS plain
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    unnest(ls) WITH ORDINALITY AS u(line, pos)),
b AS (SELECT plain, min((doc_id, pos)) AS first FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY plain HAVING count(DISTINCT source) >= {MIN_SITES}),
r AS (SELECT l.*, coalesce(b.first <> (l.doc_id, l.pos), false) AS gone FROM l LEFT JOIN b USING (plain)),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)"""
