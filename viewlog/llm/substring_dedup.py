"""Word sequences that repeat across documents, by level-wise doubling.

Level 1 looks at windows of 6 words, level 2 at those of 13 words (twice 6 and one) that hold a
window repeated at level 1. It ends there: a longer repeat is a union of repeats of 13 words, so
longer windows would remove nothing more. Level 1 takes one window out of each 8 in a row, the
one with the smallest hash: equal sequences of 13 words choose equal windows of 6, none is missed.

Documents are stored once in shards (a table bucketed by shard, so it is never shuffled again).
A shard sends the distinct window hashes it holds, packed by ranges of the hash; the task of a
range answers each shard with one bit a hash. A passage that half of all documents share is so
one entry a shard, not one a document.

A word goes if a window over it also starts in a document with a smaller id, so the smallest
document keeps its text. Copies of a whole text are found first, by a hash: of them only the
smallest is looked at, the others lose every word.

Defined results: null or wordless texts have no words; texts of fewer than 13 words lose none;
repeats inside one document alone do not count; a null id comes after all others, and rows of
equal id never take words from each other; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlog.llm import text_arrays as ta
from viewlog.session import scratch_path

WIDTH, SEED_WIDTH = 13, 6
SHARD_BYTES = 4 << 20
RANGE_HASHES = 1 << 20
LAST_ID = (1 << 63) - 1

# Bytes of text for each hash of level 1, roughly.
HASH_EVERY_BYTES = 24
BROADCAST_ROWS = 500_000
CLASS = ["text_hash", "text_check"]

PACK_SCHEMA = "range int, shard bigint, hashes binary, lowest binary, several binary"
BITS_SCHEMA = "shard bigint, range int, bits binary"
RESULT_SCHEMA = "text_hash bigint, text_check bigint, n_words bigint, lost bigint, kept string"
RESULT_TYPES = {
    "text_hash": pa.int64(),
    "text_check": pa.int64(),
    "n_words": pa.int64(),
    "lost": pa.int64(),
    "kept": pa.string(),
}


class _Words:
    """Hashes of the words of a shard's documents, which are in order of their ids."""

    def __init__(self, texts: pa.Array, ids: np.ndarray):
        data, offsets = ta.strings(texts)
        self.ids = ids
        parts, firsts, spans = [], [np.zeros(1, np.int64)], []
        total = 0
        for low, high in ta.slices(offsets):
            part = data[offsets[low] : offsets[high]]
            starts, ends, first = ta.word_spans(part, offsets[low : high + 1] - offsets[low], ta.PLAIN_WORD)
            parts.append(ta.span_hashes(part, starts, ends))
            firsts.append(first[1:] + total)
            spans.append((part, starts, ends, first))
            total += len(starts)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.first = np.concatenate(firsts)
        self.spans = spans

    def kept(self, gone: np.ndarray):
        """The words of each text that are not gone, joined by a space, as bytes."""
        at = 0
        for part, starts, ends, first in self.spans:
            raw = part.tobytes()
            for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                stay = np.flatnonzero(~gone[at + low : at + high]) + low
                yield b" ".join([raw[b:e] for b, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
            at += len(starts)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, text, hash) of all windows inside one text."""
        start, text = ta.full_windows(self.first, width)
        hashes = ta.window_hashes(self.hashes, width)
        return start, text, (hashes[start] if len(start) else np.zeros(0, np.uint64))

    def seeds(self, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window of ``width``: its start, text, and the smallest hash of ``seed`` words."""
        start, text = ta.full_windows(self.first, width)
        small = ta.window_hashes(self.hashes, seed)
        best = small[start] if len(start) else np.zeros(0, np.uint64)
        for step in range(1, width - seed + 1):
            best = np.minimum(best, small[start + step]) if len(start) else best
        return start, text, ta.mixed(best + ta.MIX_1)  # smallest values crowd the low ranges


def _distinct(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the smallest id of each, and whether it has several ids."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(hashes)) - 1
    if not len(begin):
        return hashes, ids, np.zeros(0, bool)
    return hashes[begin], ids[begin], ids[begin] != ids[last]


def _range_cuts(hashes: np.ndarray, ranges: int) -> list[int]:
    """Where sorted hashes fall apart into ranges of equal width."""
    edges = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    return [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]


def _packs(shard: int, hashes, lowest, several, ranges: int):
    """Rows of ``PACK_SCHEMA``: sorted hashes cut into ranges of equal width."""
    cuts = _range_cuts(hashes, ranges)
    return [
        (
            r,
            shard,
            hashes[low:high].tobytes(),
            b"" if lowest is None else lowest[low:high].tobytes(),
            np.packbits(several[low:high]).tobytes(),
        )
        for r, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        if high > low
    ]


def _pack_table(rows: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["range", "shard", "hashes", "lowest", "several"]
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, columns, types, strict=True)})


def repeated(packs: DataFrame, across: bool) -> DataFrame:
    """Answer every pack with one bit a hash (``BITS_SCHEMA``).

    With ``across``: whether a smaller id than the shard's smallest holds the hash. Without:
    whether two texts or more hold it.
    """

    def answer(table: pa.Table) -> pa.Table:
        shards, number = table.column("shard").to_pylist(), table.column("range")[0].as_py()
        hashes = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
        sizes = [len(h) for h in hashes]
        several = [
            np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool)
            for b, n in zip(table.column("several").to_pylist(), sizes, strict=True)
        ]
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        run = np.ones(len(flat), bool)
        run[1:] = flat[order][1:] != flat[order][:-1]
        begin, group = np.flatnonzero(run), np.cumsum(run) - 1
        answer = np.empty(len(flat), bool)
        if across:
            low = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("lowest").to_pylist()])
            least = np.minimum.reduceat(low[order], begin)
            answer[order] = least[group] < low[order]
        else:
            often = np.diff(np.append(begin, len(flat))) > 1
            often |= np.logical_or.reduceat(np.concatenate(several)[order], begin)
            answer[order] = often[group]
        cuts = np.cumsum([0, *sizes])
        bits = [np.packbits(answer[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table(
            {
                "shard": pa.array(shards, pa.int64()),
                "range": pa.array([number] * len(shards), pa.int32()),
                "bits": pa.array(bits, pa.binary()),
            }
        )

    return packs.groupBy("range").applyInArrow(answer, BITS_SCHEMA)


def _flags(bits: pa.Table, hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The answers to a shard's distinct hashes, in their order."""
    cuts = _range_cuts(hashes, ranges)
    flags = np.zeros(len(hashes), bool)
    for r, raw in zip(bits.column("range").to_pylist(), bits.column("bits").to_pylist(), strict=True):
        low, high = cuts[r], cuts[r + 1]
        flags[low:high] = np.unpackbits(np.frombuffer(raw, np.uint8))[: high - low]
    return flags


def _survivors(words: _Words, level_1: pa.Table, width: int, seed: int, ranges: int):
    """(start, text, hash) of the windows whose seed is repeated."""
    start, text, best = words.seeds(width, seed)
    distinct, at = np.unique(best, return_inverse=True)
    use = _flags(level_1, distinct, ranges)[at] if len(at) else np.zeros(0, bool)
    _, _, hashes = words.windows(width)
    return start[use], text[use], hashes[use]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, an id for order (null last), text, and the two hashes that name its class."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("key_id"),
        text.alias("text"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.lit(29), text).alias("text_check"),
    )


def _store_shards(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """One row of every distinct text (the smallest id), in a table bucketed by shard."""
    spark = rows.sparkSession
    shards = max(1, math.ceil(total / SHARD_BYTES))
    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    heads = classes.filter("rows > 1").select(*CLASS, "head")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads
    first = rows.join(heads, CLASS, "left").filter("head IS NULL OR head = key_id")
    shard = F.pmod(F.xxhash64(*CLASS), F.lit(shards))
    table = f"substring_shards_{uuid.uuid4().hex[:12]}"
    (
        first.select("key_id", *CLASS, "text", shard.alias("shard"))
        .repartition(tasks, "shard")
        .write.bucketBy(tasks, "shard")
        .sortBy("shard")
        .option("path", scratch_path(spark, "shards"))
        .option("compression", "zstd")
        .saveAsTable(table)
    )
    return spark.table(table)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _own(table: pa.Table) -> tuple[int, _Words, pa.Table]:
    """A shard's number, words, and rows in one order, each text once."""
    table = table.sort_by([("text_hash", "ascending"), ("text_check", "ascending"), ("key_id", "ascending")])
    keys = np.stack([table.column(c).to_numpy() for c in CLASS])
    new = np.ones(len(table), bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
    table = table.filter(pa.array(new))
    texts = table.column("text").combine_chunks()
    return table.column("shard")[0].as_py(), _Words(texts, table.column("key_id").to_numpy()), table


def repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED_WIDTH, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row.

    ``kept`` is the kept words joined by one space, or with ``digest`` its sha256 in hex.
    """
    spark = docs.sparkSession
    rows = _rows(docs)
    classes = _stored(
        rows.groupBy(*CLASS).agg(
            F.min("key_id").alias("head"),
            F.count(F.lit(1)).alias("rows"),
            F.max(F.octet_length("text").cast("bigint")).alias("bytes"),
        ),
        "text-classes",
    )
    total = classes.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(1, math.ceil(total / HASH_EVERY_BYTES / RANGE_HASHES))
    shards = _store_shards(rows, classes, total)

    def seeds(table: pa.Table) -> pa.Table:
        shard, words, _ = _own(table)
        _, text, best = words.seeds(width, seed)
        hashes, _, several = _distinct(best, words.ids[text])
        return _pack_table(_packs(shard, hashes, None, several, ranges))

    def windows(table: pa.Table, level_1: pa.Table) -> pa.Table:
        if not len(table):
            return _pack_table([])
        shard, words, _ = _own(table)
        _, text, found = _survivors(words, level_1, width, seed, ranges)
        hashes, lowest, several = _distinct(found, words.ids[text])
        return _pack_table(_packs(shard, hashes, lowest, several, ranges))

    def cut(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({n: pa.array([], t) for n, t in RESULT_TYPES.items()})
        _, words, table = _own(table)
        level = bits.column("level")
        level_1 = bits.filter(pc.equal(level, 1))
        start, text, found = _survivors(words, level_1, width, seed, ranges)
        hashes, lowest, _ = _distinct(found, words.ids[text])
        elsewhere = _flags(bits.filter(pc.equal(level, 2)), hashes, ranges)
        at = np.searchsorted(hashes, found)
        goes = (elsewhere[at] | (lowest[at] < words.ids[text])) if len(at) else np.zeros(0, bool)
        change = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(change, start[goes], 1)
        np.add.at(change, start[goes] + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        counts = np.diff(words.first)
        lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        kept = list(words.kept(gone))
        if digest:
            kept = [hashlib.sha256(k).hexdigest().encode() for k in kept]
        return pa.table(
            {
                **{c: table.column(c) for c in CLASS},
                "n_words": pa.array(counts, pa.int64()),
                "lost": pa.array(lost, pa.int64()),
                "kept": pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
            }
        )

    by_shard = shards.groupBy("shard")
    level_1 = _stored(repeated(by_shard.applyInArrow(seeds, PACK_SCHEMA), across=False), "level-1")
    packs = by_shard.cogroup(level_1.groupBy("shard")).applyInArrow(windows, PACK_SCHEMA)
    level_2 = _stored(repeated(packs, across=True), "level-2")
    bits = level_1.withColumn("level", F.lit(1)).unionByName(level_2.withColumn("level", F.lit(2)))
    result = by_shard.cogroup(bits.groupBy("shard")).applyInArrow(cut, RESULT_SCHEMA)
    result = _stored(result, "kept-words")
    nothing = F.sha2(F.lit(""), 256) if digest else F.lit("")
    copy = (F.col("key_id") > F.col("head")) & (F.col("n_words") >= width)
    return (
        rows.select("doc_id", "key_id", *CLASS)
        .join(classes.select(*CLASS, "head").join(result, CLASS), CLASS)
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.col("lost")).alias("n_removed"),
            F.when(copy, nothing).otherwise(F.col("kept")).alias("kept"),
        )
    )
