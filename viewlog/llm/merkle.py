"""A Merkle tree over a data set, kept as a postorder append log.

A row is a leaf. Each source has a tree of its leaves in the order of their ids: every 16
neighbouring nodes (the last run: fewer, even one) have one parent, until one node is left. The
roots of the sources, in the order of their names, are the leaves of one more such tree.

Aligned builders take 256 neighbouring nodes, so two levels of whole subtrees, and append each
node when it is complete: leaf, ..., parent, ..., grandparent. What they write is a segment of
the log, one row of a stored table; the last nodes of the segments are the leaves of the next
height, a 256th as many. The place of a node in the log follows from the sizes of the subtrees
before it (:func:`position`), so siblings are looked up by computed places and nothing but
digests is stored. Proofs come down the heights: the path of a segment's last node is found in
the segment above, and each of its 256 leaves adds its two runs of siblings.

No task holds more than 256 nodes of a tree and a path. A source with most of the rows is many
segments. The only number on the driver is that of the heights, one more for 256 times the rows.

Defined results: a null field is ``-``, an empty text ``0:``. Null ids come first, then ids
ascend; rows of one id are ordered by their leaf, and equal rows are leaves of their own. A null
source is the first tree. An empty table has no tree and no row. A lone leaf is its own subroot,
a lone subroot the root; an empty list of siblings has the digest of the empty text. Columns
other than the five fields take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlog.llm import text_arrays as ta
from viewlog.llm.ranks import ranked
from viewlog.session import scratch_path

FAN = 16
LEVELS = 2  # of one segment
SEGMENT = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before: string, after: string>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(total: int) -> int:
    """Levels above the leaves in a segment of a height with ``total`` nodes."""
    return 0 if total == 1 else 1 if total <= FAN else LEVELS


def position(level: int, number: int, leaves: int, levels: int) -> int:
    """Place in the log of a node: all nodes complete when it is, less one.

    The nodes of its own and lower levels up to its last leaf are complete, and of higher levels
    those that end before its first leaf.
    """
    first, last = number * FAN**level, min((number + 1) * FAN**level, leaves)
    below = sum(-(-last // FAN**m) for m in range(level + 1))
    return below + sum(first // FAN**m for m in range(level + 1, levels + 1)) - 1


def segment(leaves: list[str], levels: int) -> list[str]:
    """The nodes above and with ``leaves``, in the order of their completion."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(levels + 1)]

    def add(node: str, level: int, end: bool) -> None:
        if not end:
            log.append(node)
            waiting[level].append(node)
        if level < levels and (len(waiting[level]) == FAN or (end and waiting[level])):
            parent = digest(waiting[level])
            waiting[level].clear()
            add(parent, level + 1, False)

    for leaf in leaves:
        add(leaf, 0, False)
    for level in range(levels):
        add("", level, True)
    return log


def sibling_runs(log: list[str], leaves: int, levels: int) -> list[list[list[str]]]:
    """For each level the runs of siblings, read from the log by their places."""
    runs = []
    for level in range(levels):
        nodes = -(-leaves // FAN**level)
        at = [log[position(level, i, leaves, levels)] for i in range(nodes)]
        runs.append([at[i : i + FAN] for i in range(0, nodes, FAN)])
    return runs


def local_paths(log: list[str], leaves: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each leaf of a segment, the siblings before and after it at each level."""
    sides = [
        [("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))]
        for runs in sibling_runs(log, leaves, levels)
    ]
    return [[sides[level][i // FAN**level] for level in range(levels)] for i in range(leaves)]


def leaf_of(doc: Column, text: Column) -> Column:
    """SHA-256 of the fields, each as its length in bytes and its value."""
    values = [text if name == "text" else doc[name].cast("string") for name in FIELDS]
    said = [
        F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values
    ]
    return F.sha2(F.concat(*said), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): the tree is the source as a text that sorts null first.

    ``tampered`` is the leaf of the changed row, null where nothing changes: texts of ids with
    crc32 divisible by 5 are written in small letters (A-Z only).
    """
    rows = docs.select(F.struct(*FIELDS).alias("doc"))
    doc, text = F.col("doc"), F.col("doc.text")
    chosen = F.crc32(F.col("doc.doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(chosen & text.rlike("[A-Z]"), leaf_of(doc, F.translate(text, UPPER, LOWER)))
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("doc.source")), F.lit("-")).alias("tree"),
        F.col("doc.doc_id").cast("bigint").alias("doc_id"),
        leaf_of(doc, text).alias("leaf"),
        changed.alias("tampered"),
    )


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=schema)


def write_log(rows: DataFrame, log: str) -> tuple[list[DataFrame], DataFrame]:
    """Trees of (tree, index, total, digest, item) as segments stored below ``log``.

    Gives the segments (tree, segment, total, nodes, items) of each height, and (tree, subroot).
    Items are kept with the leaves of the lowest height only.
    """
    spark, heights = rows.sparkSession, []
    while True:
        entry = F.struct("index", "digest", *(["item"] if not heights else []))
        by_segment = rows.groupBy("tree", F.floor(F.col("index") / SEGMENT).alias("segment"), "total").agg(
            F.sort_array(F.collect_list(entry)).alias("entries")
        )
        by_segment = by_segment.select(
            "tree",
            "segment",
            "total",
            F.col("entries.digest").alias("nodes"),
            (F.lit(None) if heights else F.col("entries.item")).alias("items"),
        )

        def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs = zip(b.column("nodes").to_pylist(), b.column("total").to_pylist(), strict=True)
                nodes = [segment(own, levels_of(total)) for own, total in pairs]
                at = b.schema.get_field_index("nodes")
                yield b.set_column(at, b.schema.field(at), pa.array(nodes, b.schema.field(at).type))

        heights.append(_stored(by_segment.mapInArrow(built, by_segment.schema), f"{log}/height-{len(heights)}"))
        last = heights[-1].select(
            "tree",
            F.col("segment").alias("index"),
            F.ceil(F.col("total") / SEGMENT).alias("total"),
            F.element_at("nodes", -1).alias("digest"),
        )
        rows = last.filter("total > 1")
        if rows.isEmpty():
            break
    ends = [h.filter(F.col("total") <= SEGMENT).select("tree", F.element_at("nodes", -1).alias("subroot")) for h in heights]
    subroots = ends[0]
    for other in ends[1:]:
        subroots = subroots.unionByName(other)
    return heights, subroots


def log_nodes(heights: list[DataFrame]) -> DataFrame:
    """(tree, level, number, position, digest) of all nodes of a log; positions have no gap."""
    parts = []
    for height, stored in enumerate(heights):
        leaves_here = F.when(F.col("segment") == F.floor((F.col("total") - 1) / SEGMENT), (F.col("total") - 1) % SEGMENT + 1).otherwise(SEGMENT)
        schema = "tree string, level int, number bigint, digest string"

        def named(batches: Iterator[pa.RecordBatch], height=height) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    levels, k = levels_of(row["total"]), row["leaves"]
                    out = {"tree": [], "level": [], "number": [], "digest": []}
                    for level in range(1 if height else 0, levels + 1):
                        for i in range(-(-k // FAN**level)):
                            out["tree"].append(row["tree"])
                            out["level"].append(height * LEVELS + level)
                            out["number"].append(row["segment"] * FAN ** (LEVELS - level) + i)
                            out["digest"].append(row["nodes"][position(level, i, k, levels)])
                    yield pa.RecordBatch.from_pydict(
                        out, pa.schema([("tree", pa.string()), ("level", pa.int32()), ("number", pa.int64()), ("digest", pa.string())])
                    )

        parts.append(stored.select("tree", "segment", "total", "nodes", leaves_here.alias("leaves")).mapInArrow(named, schema))
    nodes = parts[0]
    for other in parts[1:]:
        nodes = nodes.unionByName(other)
    sizes = heights[0].groupBy("tree").agg(F.max("total").alias("leaves"))
    nodes = nodes.join(sizes, "tree")
    most = LEVELS * len(heights)
    last = F.least((F.col("number") + 1) * F.pow(F.lit(FAN), F.col("level")), F.col("leaves"))
    first = F.col("number") * F.pow(F.lit(FAN), F.col("level"))
    place = F.lit(-1)
    for m in range(most + 1):
        place += F.when(F.col("level") >= m, F.ceil(last / FAN**m)).otherwise(F.floor(first / FAN**m))
    return nodes.select("tree", "level", "number", place.cast("bigint").alias("position"), "digest")


def _down(heights: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Segments of the lowest height with the path above each: ``tops`` has one row a tree."""
    above = None
    for height in reversed(range(len(heights))):
        stored = heights[height]
        found = stored.filter(F.col("total") <= SEGMENT).join(tops, "tree")
        if above is not None:
            found = found.unionByName(stored.filter(F.col("total") > SEGMENT).join(above, ["tree", "segment"]), True)
        if height == 0:
            return found
        schema = f"tree string, segment bigint, subroot string, root string, path {PATH}"
        above = found.select("tree", "segment", "total", "nodes", "subroot", "root", "path").mapInArrow(
            _extended(pa.schema(_arrow_fields())), schema
        )
    raise AssertionError("a log has a height")


def _arrow_fields() -> list[tuple[str, pa.DataType]]:
    step = pa.struct([("before", pa.string()), ("after", pa.string())])
    return [("tree", pa.string()), ("segment", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("path", pa.list_(step))]


def _leaf_count(row: dict) -> int:
    return min(SEGMENT, row["total"] - row["segment"] * SEGMENT)


def _steps(path: list[dict]) -> list[tuple[str, str]]:
    return [(p["before"], p["after"]) for p in path]


def _extended(schema: pa.Schema):
    """Paths of the leaves of upper segments: they are the segments of the height below."""

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                k, rest = _leaf_count(row), _steps(row["path"])
                own = local_paths(row["nodes"], k, levels_of(row["total"]))
                yield _batch(
                    {
                        "tree": [row["tree"]] * k,
                        "segment": [row["segment"] * SEGMENT + i for i in range(k)],
                        "subroot": [row["subroot"]] * k,
                        "root": [row["root"]] * k,
                        "path": [[{"before": x, "after": y} for x, y in [*p, *rest]] for p in own],
                    },
                    schema,
                )

    return extended


class Manifest:
    """The stored logs of a data set: one of the sources' trees and one of their roots."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        ta.small_batches(spark, 256)
        self.log = scratch_path(spark, "merkle")
        # A number tells equal rows apart, so that they need not lie in one range.
        rows = leaves(docs).withColumn("tie", F.monotonically_increasing_id())
        rows = _stored(rows, f"{self.log}/leaves")
        rows = ranked(rows, ["tree"], ["doc_id", "leaf", "tie"]).select(
            "tree", "index", "total", F.col("leaf").alias("digest"), F.struct("doc_id", "tampered").alias("item")
        )
        self.heights, subroots = write_log(rows, f"{self.log}/sources")
        subroots = _stored(subroots, f"{self.log}/subroots")
        # The trees of the sources are the leaves of one more tree.
        tops = ranked(subroots.withColumn("all", F.lit("all")), ["all"], ["tree"])
        tops = tops.select(
            F.col("all").alias("tree"), "index", "total", F.col("subroot").alias("digest"), F.struct(F.col("tree").alias("source")).alias("item")
        )
        self.top_heights, self.root = write_log(tops, f"{self.log}/top")
        self.root = self.root.select(F.col("subroot").alias("root"))

    def subroot_paths(self) -> DataFrame:
        """(tree, subroot, root, path): one row a source, its path from the subroot to the root."""
        none = F.lit(None).cast("string").alias("subroot")
        start = self.root.select(F.lit("all").alias("tree"), none, "root", F.array().cast(PATH).alias("path"))
        found = _down(self.top_heights, start)
        schema = f"tree string, subroot string, root string, path {PATH}"

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fields = pa.schema([f for f in _arrow_fields() if f[0] != "segment"])
            for b in batches:
                for row in b.to_pylist():
                    levels, k, rest = levels_of(row["total"]), _leaf_count(row), _steps(row["path"])
                    own = local_paths(row["nodes"], k, levels)
                    yield _batch(
                        {
                            "tree": [item["source"] for item in row["items"]],
                            "subroot": [row["nodes"][position(0, i, k, levels)] for i in range(k)],
                            "root": [row["root"]] * k,
                            "path": [[{"before": x, "after": y} for x, y in [*p, *rest]] for p in own],
                        },
                        fields,
                    )

        return found.mapInArrow(paths, schema)

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, path): the siblings before and after each leaf, upwards."""
        return self._leaves(False)

    def verified(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

        ``folded_root`` is what the siblings and the row as found (changed or not) lead to.
        """
        return self._leaves(True)

    def _leaves(self, digests: bool) -> DataFrame:
        found = _down(self.heights, self.subroot_paths())
        schema = "doc_id bigint, leaf string, subroot string, root string, "
        schema += "proof_sha256 string, folded_root string, verified boolean" if digests else f"path {PATH}"
        fields = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string())]
        fields += (
            [("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())] if digests else _arrow_fields()[-1:]
        )

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    levels, k, rest = levels_of(row["total"]), _leaf_count(row), _steps(row["path"])
                    own = [[*p, *rest] for p in local_paths(row["nodes"], k, levels)]
                    leaf = [row["nodes"][position(0, i, k, levels)] for i in range(k)]
                    out = {
                        "doc_id": [item["doc_id"] for item in row["items"]],
                        "leaf": leaf,
                        "subroot": [row["subroot"]] * k,
                        "root": [row["root"]] * k,
                    }
                    if digests:
                        changed = [item["tampered"] or own_leaf for item, own_leaf in zip(row["items"], leaf, strict=True)]
                        out["proof_sha256"] = [digest([x + y for x, y in path]) for path in own]
                        out["folded_root"] = [fold(node, path) for node, path in zip(changed, own, strict=True)]
                        out["verified"] = [node == row["root"] for node in out["folded_root"]]
                    else:
                        out["path"] = [[{"before": x, "after": y} for x, y in path] for path in own]
                    yield _batch(out, pa.schema(fields))

        return found.mapInArrow(rows, schema)


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        node = digest([before, node, after])
    return node


# crc32 as eight shifts a byte over the reflected polynomial; trees by recursion.
ORACLE_SQL = """
WITH RECURSIVE numbered AS MATERIALIZED (
  SELECT *, row_number() OVER () AS row FROM documents),
codes AS (
  SELECT doc_id, [ascii(substr(doc_id::VARCHAR, i, 1)) FOR i IN range(1, length(doc_id::VARCHAR) + 1)] AS bytes
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
crc AS (
  SELECT doc_id, bytes, 0 AS step, 4294967295::BIGINT AS c FROM codes
  UNION ALL
  SELECT doc_id, bytes, step + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END
  FROM (SELECT *, CASE WHEN step % 8 = 0 THEN xor(c, bytes[step // 8 + 1]::BIGINT) ELSE c END AS x FROM crc
        WHERE step < 8 * len(bytes))),
chosen AS (
  SELECT doc_id FROM crc WHERE step = 8 * len(bytes) AND xor(c, 4294967295::BIGINT) % 5 = 0),
leaf_rows AS (
  SELECT row, doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS said,
    coalesce(strlen(text) || ':' || CASE WHEN doc_id IN (SELECT doc_id FROM chosen)
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-') AS found
  FROM numbered),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS number,
    count(*) OVER (PARTITION BY source) AS nodes
  FROM (SELECT row, doc_id, source, sha256(head || said) AS leaf, sha256(head || found) AS tampered FROM leaf_rows)),
grown AS (
  SELECT source, 0 AS level, number AS number, nodes, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, number // 16, (nodes + 15) // 16, sha256(string_agg(digest, '' ORDER BY number))
  FROM grown WHERE nodes > 1 GROUP BY source, level, number // 16, nodes),
subroots AS (
  SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place,
    count(*) OVER () AS nodes
  FROM grown WHERE nodes = 1),
top AS (
  SELECT 0 AS level, place AS number, nodes, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, number // 16, (nodes + 15) // 16, sha256(string_agg(digest, '' ORDER BY number))
  FROM top WHERE nodes > 1 GROUP BY level, number // 16, nodes),
runs AS (
  SELECT coalesce('=' || source, '-') AS tree, level, number // 16 AS run, list(digest ORDER BY number) AS digests
  FROM grown WHERE nodes > 1 GROUP BY ALL
  UNION ALL
  SELECT 'all', level, number // 16, list(digest ORDER BY number) FROM top WHERE nodes > 1 GROUP BY ALL),
folded AS (
  SELECT l.row, coalesce('=' || l.source, '-') AS tree, s.place, s.height, 0 AS level, l.number AS number,
    l.tampered AS node, '' AS siblings
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT f.row, f.tree, place, height, f.level + 1, number // 16,
    sha256(array_to_string(digests[1:number % 16], '') || node || array_to_string(digests[number % 16 + 2:], '')),
    siblings || array_to_string(digests[1:number % 16], '') || array_to_string(digests[number % 16 + 2:], '')
  FROM (
    SELECT row, tree, place, height, level, node, siblings,
      CASE WHEN level < height THEN number WHEN level = height THEN place ELSE number END AS number,
      CASE WHEN level < height THEN tree ELSE 'all' END AS run_tree,
      CASE WHEN level < height THEN level ELSE level - height END AS run_level
    FROM folded) f
  JOIN runs r ON r.tree = run_tree AND r.level = run_level AND r.run = number // 16),
ends AS (
  SELECT row, arg_max(node, level) AS folded_root, arg_max(siblings, level) AS siblings FROM folded GROUP BY row)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(e.siblings) AS proof_sha256, e.folded_root,
  e.folded_root = t.digest AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
JOIN ends e ON e.row = l.row, (SELECT digest FROM top WHERE nodes = 1) t
"""
