"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Vectors are projected on a few random directions, shifted, and numbered along a Hilbert curve;
``CURVES`` such orders, each with directions and a shift of its own, are cut into ranges by
Spark. A query looks at the rows around its own place in every order; what the windows find is
scored on the vectors themselves, merged, and ranked.

Inner products become distances by one more coordinate: a vector x of norm at most M is placed at
(x, sqrt(M^2 - |x|^2)) / M, a query at (x, 0) / |x|. Equal vectors are one class, known by its
smallest id: a third of all rows with one vector are one point, and ties are always won by the
smallest ids, as each class keeps as many of its ids as a result can hold.

The window is measured, not guessed: ``PROBES`` queries are compared with every row, and the
window is the number of places within which a share of ``AIM`` of their true neighbours lie on
the best curve (``LEAST_WINDOW`` at least). Data of few dimensions get narrow windows; data
without structure need windows that grow with the table, and no order can help that. Rows are
dealt in blocks of at most ``BLOCK`` places of an order and the queries of a block in groups, so no task
holds more, however many rows lie in one place.

The driver holds ``SAMPLE`` vectors for the scale of the projections, the probes, and the
places of their neighbours: bounded by these parameters. All rows are indexed.

Defined results: vectors that are null, empty, zero or hold a null or a non-finite component
take no part, neither do rows without vec_id; of several vectors of one id the least counts.
Vectors of unlike lengths are never compared. A query with fewer than 20 candidates gets all of
its length in its windows (all there are, up to ``LEAST_WINDOW`` rows); one without any has no
row. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewlog.llm import text_arrays as ta
from viewlog.llm.labelled import thinned
from viewlog.llm.ranks import ranked
from viewlog.session import scratch_path

CURVES = 8
DIRECTIONS, KEY_BITS = 6, 60
SEED = 20
NEAREST = 20
EVERY = 20  # ids divisible by this are queries
SAMPLE, PROBES, AIM = 2048, 192, 0.96
LEAST_WINDOW, BLOCK, GROUP_ROWS = 256, 8192, 32768
SLICE = 256  # queries scored at once


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below 2^bits.

    From the highest bit down, each axis either flips or exchanges the lower bits of the first
    one; a Gray code of the axes then gives the digits of the key.
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for axis in range(len(x)):
            on = (x[axis] & bit) != 0
            change = np.where(on, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(on, low, change)
            x[axis] ^= change
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def matrices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, the rows that have it and their matrix in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, values[starts[rows][:, None] + np.arange(length)]


class Curves:
    """Directions, shifts and scales of all curves, for vectors of any length."""

    def __init__(self, sample: list[list[float]], largest: float, curves: int):
        self.largest, self.curves = largest, curves
        self.scales: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list] = {}
        for vector in sample:
            by_length.setdefault(len(vector), []).append(vector)
        for length, vectors in by_length.items():
            for curve in range(curves):
                seen = self._placed(np.array(vectors, np.float64), False) @ self._directions(curve, length)
                self.scales[curve, length] = (seen.mean(0), np.maximum(seen.std(0), 1e-12))

    def _directions(self, curve: int, length: int) -> np.ndarray:
        random = np.random.default_rng([SEED, curve, length])
        return np.linalg.qr(random.normal(size=(length + 1, min(DIRECTIONS, length + 1))))[0]

    def _placed(self, x: np.ndarray, queries: bool) -> np.ndarray:
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        if queries:
            return np.hstack([x / norms, np.zeros_like(norms)])
        rest = np.sqrt(np.maximum(0.0, 1.0 - (norms / self.largest) ** 2))
        return np.hstack([x / self.largest, rest])

    def keys(self, curve: int, x: np.ndarray, queries: bool) -> np.ndarray:
        """Places of vectors of one length: the middle four deviations either way fill the grid."""
        length = x.shape[1]
        directions = self._directions(curve, length)
        axes = directions.shape[1]
        mean, deviation = self.scales.get((curve, length), (np.zeros(axes), np.full(axes, length**-0.5)))
        shift = np.random.default_rng([SEED + 1, curve, length]).random(axes)
        unit = np.clip((self._placed(x, queries) @ directions - mean) / (8 * deviation) + 0.5, 0.0, 1.0)
        bits = min(20, KEY_BITS // axes)
        return hilbert_keys(((unit + shift) * 0.5 * (2**bits - 1)).astype(np.int64), bits)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one an id."""
    given = rows.select(F.struct("vec_id", "embedding").alias("r"))
    vector = F.col("r.embedding")
    if "array<float>" not in given.select(vector).schema.simpleString():
        vector = vector.cast("array<double>")
    given = given.select(F.col("r.vec_id").cast("bigint").alias("vec_id"), vector.alias("embedding"))
    finite = F.forall("embedding", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    there = F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    return given.filter(F.col("vec_id").isNotNull() & there).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Index:
    """Every usable row of a table of vectors in all orders, stored below the shared folder."""

    def __init__(self, rows: DataFrame, curves: int = CURVES):
        self.spark = spark = rows.sparkSession
        ta.small_batches(spark, 2048)
        self.base = base = scratch_path(spark, "hilbert")
        ids = _stored(usable(rows), f"{base}/vectors")
        classes = ids.groupBy("embedding").agg(
            F.min("vec_id").alias("rep"),
            F.count("*").alias("n"),
            F.max(F.col("vec_id") % EVERY == 0).alias("asked"),
        )
        self.classes = classes = _stored(classes, f"{base}/classes")
        several = classes.filter("n > 1").select("embedding", "rep")
        self.has_copies = not several.isEmpty()
        if self.has_copies:
            members = ids.join(several, "embedding", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"))
            self.members = _stored(members, f"{base}/members")
        else:
            self.members = ids.select("vec_id", F.col("vec_id").alias("rep"))
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
        self.rows, self.largest = classes.agg(F.count("*"), F.max(norm)).first()
        if self.rows:
            self._order(curves)

    def _few(self, rows: DataFrame, wanted: int) -> DataFrame:
        few = rows.filter(thinned(F.col("rep"), wanted, rows.count()))
        return few.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("rep", "embedding")

    def _order(self, curves: int) -> None:
        sample = [r["embedding"] for r in self._few(self.classes, SAMPLE).collect()]
        fitted = Curves(sample, self.largest, curves)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rep = b.column("rep").to_numpy()
                asked = b.column("asked").to_numpy(zero_copy_only=False)
                for rows, x in matrices(b.column("embedding")):
                    for curve in range(fitted.curves):
                        for queries in (False, True):
                            use = asked[rows] if queries else np.ones(len(rows), bool)
                            if use.any():
                                keys = fitted.keys(curve, x[use], queries)
                                n = len(keys)
                                columns = [
                                    np.full(n, curve, np.int32), np.full(n, x.shape[1], np.int32), keys, np.full(n, queries), rep[rows[use]],
                                ]
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["curve", "dims", "key", "query", "rep"])

        schema = "curve int, dims int, key bigint, query boolean, rep bigint"
        keys = self.classes.select("rep", "asked", "embedding").mapInArrow(keyed, schema)
        self.order = _stored(
            ranked(keys, ["curve"], ["dims", "key", "query", "rep"]).select("curve", "index", "total", "query", "rep"),
            f"{self.base}/order",
        )

    def window(self, aim: float = AIM) -> int:
        """Places to look at on either side, from probes that are compared with every row."""
        probes = self._few(self.classes.filter("asked"), PROBES).toArrow()
        own = probes.column("rep").to_numpy()
        asked = list(matrices(probes.column("embedding")))

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                rep = b.column("rep").to_numpy()
                for rows, x in matrices(b.column("embedding")):
                    for which, q in asked:
                        if q.shape[1] == x.shape[1]:
                            for i, scores in zip(which, q @ x.T, strict=True):
                                scores[rep[rows] == own[i]] = -np.inf
                                old = best.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                                s, r = np.concatenate([old[0], scores]), np.concatenate([old[1], rep[rows]])
                                top = np.argsort(-s)[:NEAREST]
                                best[i] = (s[top], r[top])
            for i, (s, r) in best.items():
                real = np.isfinite(s)
                columns = [np.full(real.sum(), own[i]), r[real], s[real]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["probe", "near", "score"])

        found = self.classes.select("rep", "embedding").mapInArrow(compared, "probe bigint, near bigint, score double")
        place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "near"))
        pairs = found.withColumn("place", place).filter(F.col("place") <= NEAREST).select("probe", "near")
        pairs = _stored(pairs, f"{self.base}/probes-{aim}")  # PROBES * NEAREST rows at most
        here = self.order.filter("query").select("curve", F.col("rep").alias("probe"), F.col("index").alias("own"))
        here = here.join(F.broadcast(pairs.select("probe").distinct()), "probe")
        there = self.order.filter("NOT query").join(F.broadcast(pairs), F.col("rep") == F.col("near"))
        there = there.select("curve", "probe", "near", "index")
        away = there.join(here, ["curve", "probe"]).groupBy("probe", "near").agg(F.min(F.abs(F.col("index") - F.col("own"))))
        needed = np.sort(np.array([r[2] for r in away.collect()], np.int64))
        if not len(needed):
            return LEAST_WINDOW
        return max(LEAST_WINDOW, int(needed[min(len(needed) - 1, int(aim * len(needed)))]) + 1)

    def search(self, nearest: int = NEAREST, window: int | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score) of every query: the nearest that its windows hold."""
        schema = "query_id bigint, rank int, vec_id bigint, score double"
        if not self.rows or self.classes.filter("asked").isEmpty():
            return self.spark.createDataFrame([], schema)
        window = self.window() if window is None else window
        best = self._classes_near(nearest + 1, window)
        if self.has_copies:
            first = F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))
            copies = self.members.join(self.classes.filter("n > 1").select("rep"), "rep")
            copies = copies.withColumn("place", first).filter(F.col("place") <= nearest + 1)
            copies = copies.groupBy(F.col("rep").alias("near")).agg(F.collect_list("vec_id").alias("ids"))
            best = best.join(copies, "near", "left")
            best = best.select("query", "score", F.explode(F.coalesce("ids", F.array("near"))).alias("vec_id"))
        else:
            best = best.select("query", "score", F.col("near").alias("vec_id"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        top = best.withColumn("place", place).filter(F.col("place") <= nearest + 1)
        top = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("top"))
        asking = self.members.filter(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")
        found = asking.join(top, F.col("rep") == F.col("query")).select(
            "query_id", F.posexplode(F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, nearest)).alias("i", "t")
        )
        return found.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")

    def _classes_near(self, wanted: int, window: int) -> DataFrame:
        """(query, near, score): the ``wanted`` nearest classes of each query class in its windows."""
        size = min(BLOCK, max(window, LEAST_WINDOW))
        groups = -(-(size + 2 * window) // GROUP_ROWS)

        def block(place: Column) -> Column:
            return F.floor(place / size)

        last = block(F.col("total") - 1)
        visited = F.sequence(
            F.greatest(block(F.col("index") - window), F.lit(0)), F.least(block(F.col("index") + window), last)
        )
        own_group = F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int")
        placed = self.order.join(self.classes.select("rep", "embedding"), "rep")
        queries = placed.filter("query").select("curve", F.explode(visited).alias("block"), own_group.alias("grp"), "query", "rep", "embedding")
        every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        others = placed.filter("NOT query").select("curve", block(F.col("index")).alias("block"), every_group.alias("grp"), "query", "rep", "embedding")

        def scored(part: pa.Table) -> pa.Table:
            rep = part.column("rep").to_numpy()
            query = part.column("query").to_numpy()
            out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            for rows, x in matrices(part.column("embedding")):
                asks = query[rows]
                near, c = rep[rows[~asks]], x[~asks]
                q_rep, q = rep[rows[asks]], x[asks]
                for low in range(0, len(q) if len(c) else 0, SLICE):
                    for column, values in zip(out, best_pairs(q_rep[low : low + SLICE], q[low : low + SLICE], near, c, wanted), strict=True):
                        column.append(values)
            return pa.table([pa.array(np.concatenate(c)) for c in out], ["query", "near", "score"])

        found = queries.unionByName(others).groupBy("curve", "block", "grp").applyInArrow(scored, "query bigint, near bigint, score double")
        # A pair has the same score wherever it is found, so equal pairs share a place.
        place = F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("score"), "near"))
        return found.withColumn("place", place).filter(F.col("place") <= wanted).drop("place").distinct()


def best_pairs(q_rep: np.ndarray, q: np.ndarray, near: np.ndarray, c: np.ndarray, wanted: int):
    """(query, near, score) of the ``wanted`` best of ``c`` for each query, ties to smaller ids.

    The product of matrices only chooses; scores are summed a pair at a time, which gives one
    value for a pair in any company.
    """
    rough = q @ c.T
    if len(c) > wanted:
        least = np.partition(rough, len(c) - wanted, axis=1)[:, len(c) - wanted]
        slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
        row, col = np.nonzero(rough >= (least - slack)[:, None])
    else:
        row, col = (a.ravel() for a in np.indices(rough.shape))
    score = (q[row] * c[col]).sum(axis=1)
    order = np.lexsort((near[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < wanted
    return q_rep[row[keep]], near[col[keep]], score[keep]
