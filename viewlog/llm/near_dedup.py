"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. Each text gives the set of its distinct word shingles, a fingerprint of the whole set, and a
   MinHash signature of ``TREES`` keys with ``DEPTH`` values each. Documents with equal sets
   form a class; its smallest doc_id stands for it from here on.
2. Every tree orders the classes by its key. Classes whose keys share a prefix of ``MIN_DEPTH``
   values are candidates; a region with more than ``REGION`` of them is looked at one value
   deeper, and so on, down to the whole key. A row of such a crowd keeps a link to its smallest
   class, so rows that part deeper down are still compared. Candidates of all trees form
   candidate components.
3. Links are confirmed on full sets. A candidate component is solved as a whole in one task, or,
   above ``TASK_SHINGLES``, in blocks by set size and hash whose pairs are tasks of their own.
   In a task a prefix filter over the rarest shingles finds the pairs that can reach the limit,
   and pairs that are linked already by others are skipped; no pair list is made.
4. Components of the confirmed links are the groups.

Candidates can be missed only if no tree puts a chain between two documents: at similarity 0.8
and three values a key, all 16 trees miss one pair with probability 0.00001, in crowds as well.

Defined results: null, empty or wordless texts have no shingles and are linked with nothing, as
are rows without doc_id; rows that share a doc_id count as one document; copies get the smallest
doc_id of their group; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlog.llm import text_arrays as ta
from viewlog.llm.components import components
from viewlog.session import scratch_path

SHINGLE_WORDS = 5
PERCENT = 80
TREES, DEPTH, MIN_DEPTH = 16, 8, 3
REGION = 64
TASK_SHINGLES = 200_000
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
BROADCAST_REGIONS = 250_000

SIGNATURE_SCHEMA = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, signature binary"


def shingle_hashes(
    words: np.ndarray, first: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats) and the text of each; a short text is one shingle."""
    start, text = ta.full_windows(first, width)
    windows = ta.window_hashes(words, width)
    hashes = windows[start] if len(windows) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return hashes, text
    total = np.zeros(len(short), np.uint64)
    for j in range(width - 1):
        has = counts[short] > j
        at = np.minimum(first[:-1][short] + j, len(words) - 1)
        total = np.where(has, total * ta.MIX_1 + words[at], total)
    total = ta.mixed(total + counts[short].astype(np.uint64) * ta.MIX_2)
    hashes, text = np.concatenate([hashes, total]), np.concatenate([text, short])
    order = np.argsort(text, kind="stable")
    return hashes[order], text[order]


def shingle_sets(column: pa.Array, width: int):
    """For parts of a text column: (first row, rows, hashes, text): distinct, sorted in each text."""
    data, offsets = ta.strings(column)
    for low, high in ta.slices(offsets):
        part = ta.LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, first = ta.word_spans(part, offsets[low : high + 1] - offsets[low], ta.PLAIN_WORD)
        hashes, text = shingle_hashes(ta.span_hashes(part, starts, ends), first, width)
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        yield low, high - low, hashes[new], text[new]


def _family() -> tuple[np.ndarray, np.ndarray]:
    seeds = ta.mixed(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * ta.MIX_1)
    return seeds[::2] | np.uint64(1), seeds[1::2]


def signatures(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``SIGNATURE_SCHEMA`` of every document that has a word and an id."""
    ta.small_batches(docs.sparkSession)
    factors, masks = _family()

    def signed(batches):
        for batch in batches:
            names = batch.column("doc_id")
            for low, rows, hashes, text in shingle_sets(batch.column("text"), width):
                counts = np.bincount(text, minlength=rows)
                own = np.flatnonzero(counts)
                begin = (np.cumsum(counts) - counts)[own]
                values = np.empty((len(own), TREES * DEPTH), ">u4")
                scattered = ta.mixed(hashes)
                if len(own):
                    for k in range(TREES * DEPTH):
                        drawn = (((hashes ^ masks[k]) * factors[k]) >> np.uint64(32)).astype(np.uint32)
                        values[:, k] = np.minimum.reduceat(drawn, begin)
                    f1 = np.add.reduceat(scattered, begin)
                    f2 = np.bitwise_xor.reduceat(ta.mixed(scattered + ta.MIX_1), begin)
                else:
                    f1 = f2 = np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(low, rows).take(pa.array(own)),
                        pa.array(counts[own], pa.int64()),
                        pa.array(f1.view(np.int64)),
                        pa.array(f2.view(np.int64)),
                        ta.binary_rows(values.ravel(), np.arange(len(own) + 1) * TREES * DEPTH),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "signature"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.filter("doc_id IS NOT NULL").mapInArrow(signed, SIGNATURE_SCHEMA)


def forest_links(classes: DataFrame) -> DataFrame:
    """(u, v): each class of a region linked to the region's smallest, over all trees.

    ``classes`` has rep and signature. Counts of regions are reduced on the map side; only
    rows of regions with more than one class go on, and only large regions go deeper. Links
    of the first depth are kept for all rows, one a row: they alone hold the stated probability.
    """
    spark = classes.sparkSession
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = classes.select("rep", "signature", trees.alias("tree"))
    rows = rows.select(
        "rep", "tree", F.substring("signature", F.col("tree") * 4 * DEPTH + 1, F.lit(4 * DEPTH)).alias("key")
    )
    links = None
    for depth in range(MIN_DEPTH, DEPTH + 1):
        region = F.xxhash64(F.lit(depth), "tree", F.substring("key", 1, 4 * depth))
        rows = rows.withColumn("region", region)
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("smallest"))
        path = scratch_path(spark, f"region-sizes-{depth}")
        sizes.filter("n > 1").write.parquet(path)
        sizes = spark.read.parquet(path)
        # With few regions no row is shuffled, however many rows a region has.
        sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_REGIONS else sizes
        path = scratch_path(spark, f"regions-{depth}")
        rows.join(sizes, "region").write.parquet(path)
        stored = spark.read.parquet(path)
        last = depth == DEPTH
        found = stored.filter(F.lit(last or depth == MIN_DEPTH) | (F.col("n") <= REGION)).select(
            F.col("rep").alias("u"), F.col("smallest").alias("v")
        )
        links = found if links is None else links.unionByName(found)
        rows = stored.filter(F.col("n") > REGION).select("rep", "tree", "key")
        if last or rows.isEmpty():
            return links.filter("u <> v").distinct()


def solve_tasks(members: DataFrame) -> DataFrame:
    """(rep, tasks): the tasks in which each class is compared, as structs (task, side, crossed).

    ``members`` has component, rep, n_shingles. A component below ``TASK_SHINGLES`` is one task.
    A larger one falls into cells by set size (a factor of 1.25 each, so links are inside a cell
    or between neighbours), and a cell into blocks by hash; each pair of blocks is a task.
    """
    cell = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(1.25))).cast("int")
    members = members.withColumn("cell", cell)
    weights = members.groupBy("component", "cell").agg(F.sum("n_shingles").alias("w"))
    shapes = weights.groupBy("component").agg(
        F.sum("w").alias("total"),
        F.map_from_entries(
            F.collect_list(F.struct("cell", F.ceil(F.col("w") / TASK_SHINGLES).cast("int")))
        ).alias("blocks"),
    )  # some sixty cells at most
    rows = members.join(shapes, "component").withColumn(
        "b", F.expr("CAST(pmod(xxhash64(rep), blocks[cell]) AS INT)")
    )
    tasks = f"""CASE WHEN total <= {TASK_SHINGLES}
        THEN array(named_struct('task', xxhash64(component), 'side', 0, 'crossed', false))
        ELSE concat(
          transform(sequence(0, blocks[cell] - 1), k -> named_struct(
            'task', xxhash64(component, cell, least(b, k), cell, greatest(b, k)),
            'side', CASE WHEN b <= k THEN 0 ELSE 1 END, 'crossed', b <> k)),
          CASE WHEN blocks[cell + 1] IS NULL THEN array() ELSE
            transform(sequence(0, blocks[cell + 1] - 1), k -> named_struct(
              'task', xxhash64(component, cell, b, cell + 1, k), 'side', 0, 'crossed', true)) END,
          CASE WHEN blocks[cell - 1] IS NULL THEN array() ELSE
            transform(sequence(0, blocks[cell - 1] - 1), k -> named_struct(
              'task', xxhash64(component, cell - 1, k, cell, b), 'side', 1, 'crossed', true)) END
        ) END"""
    return rows.select("rep", F.expr(tasks).alias("tasks"))


def member_sets(docs: DataFrame, tasks: DataFrame, width: int) -> DataFrame:
    """(task, rep, side, crossed, shingles): the full sets of the members, once for each task."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tasks")
    tasks.write.parquet(path)
    stored = spark.read.parquet(path)
    # Rough bytes of a row and of each of its tasks: crowds have many tasks a row.
    weight = stored.agg(F.sum(64 + 40 * F.size("tasks").cast("bigint"))).first()[0] or 0
    few = weight <= BROADCAST_BYTES
    rows = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(
        F.broadcast(stored) if few else stored, "rep"
    )

    def sets(batches):
        for batch in batches:
            for low, rows, hashes, text in shingle_sets(batch.column("text"), width):
                cuts = np.searchsorted(text, np.arange(rows + 1))
                part = batch.slice(low, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("tasks"), ta.binary_rows(hashes, cuts)],
                    ["rep", "tasks", "shingles"],
                )

    task = "array<struct<task: bigint, side: int, crossed: boolean>>"
    made = rows.mapInArrow(sets, f"rep bigint, tasks {task}, shingles binary")
    return made.select("rep", "shingles", F.explode("tasks").alias("t")).select("rep", "shingles", "t.*")


def confirmed_links(
    reps: np.ndarray, sets: list[np.ndarray], side: np.ndarray, crossed: bool, percent: int = PERCENT
) -> list[tuple[int, int]]:
    """Pairs (i, j) that reach the limit and connect all that can be connected by such pairs.

    Rows of one ``reps`` value are one document and connected from the start.
    With ``crossed``, pairs of side 0 and side 1 alone are looked at.
    """
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    begin = np.cumsum(size) - size
    # Rarest shingles first: a pair at the limit shares one of the first n - ceil(0.8 n) + 1.
    order = np.lexsort((token, often[token], owner))
    token = token[order]
    inside = ta.ranges(size)
    prefix = inside < (size - (percent * size + 99) // 100 + 1)[owner]
    sort = np.argsort(token[prefix], kind="stable")
    listed, holders = token[prefix][sort], owner[prefix][sort]
    bounds = np.searchsorted(listed, np.arange(len(often) + 1))
    label = np.unique(reps, return_inverse=True)[1]
    mark = np.zeros(len(often), bool)
    links = []
    for i in range(len(sets)):
        if crossed and side[i] == 0:
            continue
        own = token[begin[i] : begin[i] + size[i]]
        near = np.zeros(len(sets), bool)
        for t in own[: size[i] - (percent * size[i] + 99) // 100 + 1].tolist():
            low, high = bounds[t], bounds[t + 1]
            if high - low > 1:
                near[holders[low:high]] = True
        near[side == 1 if crossed else slice(i, None)] = False
        near &= (size * 100 >= size[i] * percent) & (size * percent <= size[i] * 100)
        rest = np.flatnonzero(near & (label != label[i]))
        mark[own] = True
        chunk = 8
        while len(rest):
            some, rest = rest[:chunk], rest[chunk:]
            spread = np.repeat(begin[some], size[some]) + ta.ranges(size[some])
            shared = np.add.reduceat(mark[token[spread]].astype(np.int64), np.cumsum(size[some]) - size[some])
            good = some[100 * shared >= percent * (size[some] + size[i] - shared)]
            for j in good.tolist():
                if label[j] != label[i]:
                    links.append((i, j))
                    label[label == label[j]] = label[i]
            rest = rest[label[rest] != label[i]]
            chunk *= 4
        mark[own] = False
    return links


def verified_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending")])
        reps = table.column("rep").to_numpy()
        arrays = [np.frombuffer(raw, np.uint64) for raw in table.column("shingles").to_pylist()]
        side = table.column("side").to_numpy()
        crossed = bool(table.column("crossed")[0].as_py())
        links = confirmed_links(reps, arrays, side, crossed, percent) if len(reps) > 1 else []
        u = [int(reps[i]) for i, _ in links]
        v = [int(reps[j]) for _, j in links]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return sets.groupBy("task").applyInArrow(solve, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    path = scratch_path(spark, "signatures")
    signatures(docs, width).write.parquet(path)
    signed = spark.read.parquet(path)
    classes = signed.groupBy("f1", "f2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.first("signature").alias("signature")
    )
    candidates = components(forest_links(classes.select("rep", "signature")))
    sizes = signed.groupBy(F.col("doc_id").alias("rep")).agg(F.max("n_shingles").alias("n_shingles"))
    members = candidates.withColumnRenamed("node", "rep").join(sizes, "rep")
    links = verified_links(member_sets(docs, solve_tasks(members), width), percent)
    path = scratch_path(spark, "near-links")
    links.write.parquet(path)
    groups = components(spark.read.parquet(path)).withColumnsRenamed(
        {"node": "rep", "component": "group"}
    )
    heads = signed.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    heads = heads.join(groups, "rep", "left")
    heads = heads.select("f1", "f2", "n_shingles", F.coalesce("group", "rep").alias("component_id"))
    placed = signed.join(heads, ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    placed = placed.groupBy("doc_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")
    )
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return ids.join(placed, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n_shingles", F.lit(0)).cast("bigint").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that stand for a smaller doc_id, with their own columns."""
    spark = docs.sparkSession
    path = scratch_path(spark, "dropped")
    near_duplicates(docs, width, percent).filter("NOT kept").select(
        F.col("doc_id").alias("dropped_id")
    ).distinct().write.parquet(path)
    dropped = spark.read.parquet(path)
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return docs.join(side, docs["doc_id"] == side["dropped_id"], "left_anti")
