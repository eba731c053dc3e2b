"""Quality of documents: random-indexing word vectors and a two-layer network.

Every token bucket has a fixed sparse random index vector; its word vector is the sum of the
index vectors of the tokens around it, over the whole corpus. A document is pooled to means and
spreads of its tokens' vectors, and a two-layer network in numpy, with a temperature fitted on
rows it did not learn from, turns that into a probability.

The corpus pass gives each task one matrix of ``BUCKETS`` x ``DIMS`` counts; matrices are added
in two steps, by blocks of buckets, so no task gathers all. The network learns from at most
``ROWS_PER_CLASS`` labelled documents of either label. Scoring is one pass without a shuffle.

Defined results: a null or empty text is pooled to zeros and scored like any other; without
labels of both kinds every score is the share of label 1 (0.5 without labels); rows with equal
or null ids are scored one by one (a null id counts as held out); an empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlog.llm import text_arrays as ta
from viewlog.llm.labelled import fold, training_sample

FOLDS, HELD_OUT_FOLD = 3, 1
ROWS_PER_CLASS = 8_000
BUCKETS, DIMS, ONES = 1 << 14, 32, 4
BLOCKS = 32
REACH = 2
HIDDEN, ROUNDS, RATE, DECAY = 32, 600, 0.01, 1e-3

_LETTER = ~ta.byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_DIGIT = ta.byte_class((0x30, 0x39))
# Kinds of bytes; a token is a run of one kind. 0 separates.
_KIND = np.where(_LETTER, 1, np.where(_DIGIT, 2, np.where(ta.PLAIN_WORD, 3, 0))).astype(np.int8)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of each bucket's ``ONES`` entries."""
    draws = ta.mixed(np.arange(1, BUCKETS * ONES + 1, dtype=np.uint64) * ta.MIX_1).reshape(BUCKETS, ONES)
    return (draws % np.uint64(DIMS)).astype(np.int64), np.where(draws >> np.uint64(63), 1, -1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every token: runs of letters (case kept), digits, or other characters."""
    kind = _KIND[data]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    use = kind[starts] > 0
    starts, ends = starts[use], ends[use]
    # Numbers are one token, whatever their digits.
    ends = np.where(kind[starts] == 2, starts, ends)
    hashes = ta.span_hashes(data, starts, ends, seed=1)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(offsets, starts, "right") - 1


def context_counts(docs: DataFrame) -> np.ndarray:
    """Word vectors of all buckets, from every document."""
    ta.small_batches(docs.sparkSession)
    size = BUCKETS // BLOCKS * DIMS
    salts = math.isqrt(docs.rdd.getNumPartitions()) + 1  # a group adds that many blocks at most

    def counted(batches):
        dims, signs = _index_vectors()
        matrix = np.zeros(BUCKETS * DIMS, np.int64)
        for batch in batches:
            data, offsets = ta.strings(batch.column("text"))
            for low, high in ta.slices(offsets):
                part = data[offsets[low] : offsets[high]]
                bucket, text = tokens(part, offsets[low : high + 1] - offsets[low])
                for step in range(1, REACH + 1):
                    near = text[step:] == text[:-step]
                    a, b = bucket[:-step][near], bucket[step:][near]
                    for own, other in ((a, b), (b, a)):
                        at = (own[:, None] * DIMS + dims[other]).ravel()
                        matrix += np.bincount(at, signs[other].ravel(), BUCKETS * DIMS).astype(np.int64)
        blocks = [_packed(matrix[i * size : (i + 1) * size]) for i in range(BLOCKS)]
        salt = int(ta.mixed(matrix[:1000].view(np.uint64)).sum() % np.uint64(salts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array(blocks, pa.binary())],
            ["block", "salt", "counts"],
        )

    def added(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("counts"):
                total += _unpacked(raw.as_buffer(), size)
        return total

    def add_salted(key, batches):
        total = added(batches)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([_packed(total)], pa.binary())], ["block", "counts"]
        )

    parts = docs.select("text").mapInArrow(counted, "block int, salt int, counts binary")
    schema = "block int, counts binary"
    for keys in (("block", "salt"), ("block",)):
        parts = parts.groupBy(*keys).applyInArrow(_streamed(add_salted), schema)
    matrix = np.zeros((BLOCKS, size), np.int64)
    for row in parts.collect():  # BLOCKS rows of a fixed size
        matrix[row["block"]] = _unpacked(row["counts"], size)
    vectors = matrix.reshape(BUCKETS, DIMS).astype(np.float64)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(norm, 1)).astype(np.float32)


def _packed(counts: np.ndarray) -> bytes:
    """Four bytes a count where they suffice, else eight."""
    narrow = np.abs(counts).max(initial=0) < 1 << 31
    return counts.astype(np.int32 if narrow else np.int64).tobytes()


def _unpacked(raw, size: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * size else np.int64).astype(np.int64)


def _streamed(add):
    """A grouped function over a table, from one over batches."""

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(add(key, table.to_batches())))

    return apply


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Means and spreads of word vectors, and means of index vectors, of each text."""
    rows = len(offsets) - 1
    bucket, text = tokens(data, offsets)
    counts = np.bincount(text, minlength=rows)
    out = np.zeros((rows, 3 * DIMS + 2), np.float32)
    if not len(bucket):
        return out
    dims, signs = _index_vectors()
    own = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[own]
    n = counts[own][:, None]
    chosen = vectors[bucket].astype(np.float64)
    mean = np.add.reduceat(chosen, begin) / n
    square = np.add.reduceat(chosen**2, begin) / n
    at = (text[:, None] * DIMS + dims[bucket]).ravel()
    index = np.bincount(at, signs[bucket].ravel(), rows * DIMS).reshape(rows, DIMS)[own] / n
    out[own, :DIMS] = mean
    out[own, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square - mean**2, 0))
    out[own, 2 * DIMS : 3 * DIMS] = index
    out[own, -2] = (index**2).sum(1)
    out[own, -1] = np.log1p(counts[own])
    return out


class Network:
    """One hidden layer of tanh units and a logistic output with a temperature."""

    def __init__(self, share: float = 0.5):
        self.share, self.layers = share, None
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, check: np.ndarray) -> Network:
        """Learn from the rows not in ``check``; fit the temperature on those."""
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        rng = np.random.default_rng(7)
        z = (x - self.centre) / self.scale
        w = [
            rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            np.zeros(1),
        ]
        learn = ~check
        zl, yl = z[learn], y[learn]
        wl = weight[learn] / weight[learn].sum()
        mean, square = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for step in range(1, ROUNDS + 1):
            hidden = np.tanh(zl @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30)))
            d = (p - yl) * wl
            back = np.outer(d, w[2]) * (1 - hidden**2)
            grads = [zl.T @ back + DECAY * w[0], back.sum(0), hidden.T @ d + DECAY * w[2], d.sum(keepdims=True)]
            for i, g in enumerate(grads):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                w[i] -= RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-9)
        self.layers = w
        logits, target, share = self.logits(x[check]), y[check], weight[check]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [(share * np.logaddexp(0, np.where(target == 1, -logits, logits) / t)).sum() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if check.any() else 1.0
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.tanh(z @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _per_text(rows: DataFrame, keep: str, schema: str, make, sent) -> DataFrame:
    """One output row a text: the column ``keep`` and what ``make`` gives for the texts' bytes."""

    def mapped(batches):
        model = ta.received(sent)
        for batch in batches:
            data, offsets = ta.strings(batch.column("text"))
            for low, high in ta.slices(offsets):
                made = make(model, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([batch.column(keep).slice(low, high - low), made], [keep, "made"])

    return rows.mapInArrow(mapped, schema)


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network:
    sample, totals = training_sample(
        docs, labels, "quality", lambda i: fold(i, FOLDS) != HELD_OUT_FOLD, ROWS_PER_CLASS
    )
    if len(totals) < 2:
        return Network(float(next(iter(totals), 0.5)))
    sent = ta.send(docs.sparkSession, vectors)

    def pool(vectors, data, offsets):
        x = pooled(vectors, data, offsets)
        return ta.binary_rows(x.ravel(), np.arange(len(x) + 1) * x.shape[1])

    keyed = sample.select(F.struct("doc_id", "y").alias("key"), "text")
    schema = "key struct<doc_id: bigint, y: int>, made binary"
    rows = sorted((r["key"]["doc_id"], r["key"]["y"], bytes(r["made"])) for r in _per_text(keyed, "key", schema, pool, sent).collect())
    x = np.stack([np.frombuffer(made, np.float32) for _, _, made in rows]).astype(np.float64)
    y = np.array([label for _, label, _ in rows])
    counts = np.bincount(y, minlength=2)
    if not counts.all():
        return Network(float(y.mean()))
    weight = np.array([1.0, totals[1] / totals[0] * counts[0] / counts[1]])[y]
    check = ta.mixed(np.array([i for i, _, _ in rows], np.int64).view(np.uint64)) % np.uint64(5) == 0
    return Network().fit(x, y, weight, check)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    vectors = context_counts(docs)
    sent = ta.send(docs.sparkSession, (vectors, fit(docs, labels, vectors)))

    def score(model, data, offsets):
        vectors, network = model
        return pa.array(network.probability(pooled(vectors, data, offsets)).astype(np.float64))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = _per_text(rows, "doc_id", "doc_id bigint, made double", score, sent)
    return made.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD, F.lit(True)).alias("held_out"),
        F.col("made").alias("score"),
        (F.col("made") >= 0.5).cast("int").alias("predicted"),
    )
