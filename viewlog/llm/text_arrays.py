"""Words of many texts at once, as numpy arrays over an Arrow string column.

Texts are handled as UTF-8 bytes. All word patterns here are classes of ASCII bytes or their
complements, so that byte classes give the same words as character classes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

# Rows of an Arrow batch, and bytes of text that are turned into arrays at once.
BATCH_ROWS = 512
SLICE_BYTES = 2 << 20

MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch: very long texts must fit in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def send(spark: SparkSession, value) -> Broadcast:
    """A broadcast of a value together with its classes; plain broadcasts name them only."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    return pickle.loads(sent.value)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for bytes in one of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
PLAIN_WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM_WORD = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column (null: empty) and the offsets of each string."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(rows, max(low + 1, high))
        yield low, high
        low = high


def word_spans(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``data``; words of text i are first[i] .. first[i+1]."""
    inside = is_word[data]
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX_2
    x ^= x >> np.uint64(32)
    x *= MIX_2
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    length = ends - starts
    hashes = mixed(length.astype(np.uint64) * MIX_1 + np.uint64(seed))
    active, at = np.arange(len(starts)), 0
    while len(active):
        left = length[active] - at
        keep = (8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8)
        block = blocks[starts[active] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> keep)
        hashes[active] = mixed((hashes[active] + MIX_1) ^ block)
        at += 8
        active = active[left > 8]
    return hashes


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive words, in order of their first word."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        total *= MIX_1
        total += words[j : j + len(total)]
    return mixed(total)


def full_windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows over all texts' words in a row: those inside one text, and their texts."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    start = first[:-1][text] + ranges(counts)
    return start, text


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0]-1, 0 .. counts[1]-1, and so on."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def texts_of(df: DataFrame) -> DataFrame:
    """doc_id and text alone, as the operators read them."""
    return df.select("doc_id", "text")


def binary_rows(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column: row i holds the raw bytes of values[cuts[i]:cuts[i+1]]."""
    buffer = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    offsets = (np.asarray(cuts, np.int64) * values.itemsize).astype(np.int64)
    column = pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), buffer]
    )
    return column.cast(pa.binary())
