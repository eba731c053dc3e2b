"""Packing of tokenised documents into sequences of a fixed length.

Shortest-pack-first over the length histogram: lengths are placed longest first, each into the
pack with the least content so far, and only counts of equal packing patterns are kept. Pieces
then find their place by their rank among the pieces of the same length.

A document is its token ids and an end token; a document longer than a sequence is cut into
full pieces and a rest. Tokens are made once, where the text is read, and only pieces (lengths
and checksums, with their ids on demand) move on. The histogram has at most ``SEQUENCE`` rows
and the plan made of it is bounded by ``SEQUENCE`` alone, whatever the number of documents.

Ranks within a length are not counted in one task: pieces of a length are dealt over buckets,
numbered inside them, and shifted by the counts of the buckets before.

Defined results: a null or empty text is its end token alone; rows with equal or null ids are
packed one by one; an empty table gives an empty result. Other columns, whatever their names,
are not part of the result.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewlog.llm import text_arrays as ta
from viewlog.session import scratch_path

SEQUENCE = 2048
END_ID = 1
# Pieces per bucket of a length, on average; units of text kept by a task.
BUCKET_PIECES = 5_000
CACHED_UNITS = 600_000
JOINED_UNITS = 500

# White space outside ASCII, and control characters on which definitions of it differ.
_ODD_CODES = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B))
_ODD_CODES += (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_ODD_SPACE = re.compile(f"[{''.join(map(chr, _ODD_CODES))}]")
_SPACE = ta.byte_class((0x20, 0x20), (0x09, 0x0D))
_LETTER = ta.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_SIGN = ta.byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))

PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids array<int>"
)


class UnitTokenizer:
    """Token ids of many texts; a unit of text that was seen before is looked up.

    A text is cut where the vocabulary's pre-tokeniser always cuts: before a single space, before
    and after a single newline, and between a letter or digit and a sign other than an apostrophe
    (all ASCII). The ids of the units, in order, are then the ids of the text. Texts with other
    white space go in whole, as do those that hold an added token of the vocabulary, which is
    looked for before any cut and may lie across one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        """Known units: sorted hashes, and where in ``flat`` the ids of each begin and how many."""
        self.hashes, self.begins = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids per unit) of units without inner white space, many at a time.

        They are joined by newlines, which are tokens of their own there; where they are not, the
        units are encoded one by one.
        """
        lengths = ends - starts + 1
        at = np.cumsum(lengths)
        text = np.full(int(at[-1]), 0x0A, np.uint8)
        text[ta.ranges(lengths - 1) + np.repeat(at - lengths, lengths - 1)] = data[ta.ranges(lengths - 1) + np.repeat(starts, lengths - 1)]
        firsts = np.arange(0, len(starts), JOINED_UNITS)
        lasts = np.append(firsts[1:], len(starts))
        lines = [text[at[f] - lengths[f] : at[e - 1] - 1].tobytes().decode("utf-8") for f, e in zip(firsts, lasts, strict=True)]
        found = []
        for line, ids, n in zip(lines, self._alone(lines), lasts - firsts, strict=True):
            stops = np.flatnonzero(ids == self.newline[0])
            if len(self.newline) == 1 and len(stops) == n - 1:
                found.append((ids[ids != self.newline[0]], np.diff([-1, *stops, len(ids)]) - 1))
            else:
                each = self._alone(line.split("\n"))
                found.append((np.concatenate(each), np.array([len(e) for e in each])))
        return found

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> None:
        """Encode new units (``hashes`` ascend) and put them among the known ones."""
        white = np.concatenate([[0], np.cumsum(_SPACE[data])])
        led = data[starts] == 0x20
        plain = (white[ends] == white[starts + led]) & (ends - starts > led) & ~whole
        counts, begins = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        parts = [self.flat]
        if plain.any():
            joined = self._joined(data, starts[plain], ends[plain])
            parts += [ids for ids, _ in joined]
            counts[plain] = np.concatenate([n for _, n in joined])
        rest = np.flatnonzero(~plain)
        if len(rest):
            each = self._alone([data[starts[i] : ends[i]].tobytes().decode("utf-8") for i in rest])
            parts += each
            counts[rest] = [len(e) for e in each]
        order = np.concatenate([np.flatnonzero(plain), rest])
        begins[order] = len(self.flat) + np.cumsum(counts[order]) - counts[order]
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.flat = np.insert(self.hashes, place, hashes), np.concatenate(parts)
        self.begins, self.counts = np.insert(self.begins, place, begins), np.insert(self.counts, place, counts)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of each text's ids."""
        starts, ends, first, whole = _units(data, offsets, self.added)
        hashes = ta.span_hashes(data, starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHED_UNITS:
            self._forget()
        place = np.searchsorted(self.hashes, distinct)
        new = np.append(self.hashes, np.uint64(0))[place] != distinct
        new |= place == len(self.hashes)
        if new.any():
            unit = where[new]
            self._learn(data, distinct[new], starts[unit], ends[unit], whole[unit])
            place = np.searchsorted(self.hashes, distinct)
        place = place[inverse]
        counts = self.counts[place]
        ids = self.flat[np.repeat(self.begins[place], counts) + ta.ranges(counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(sums[first])


def _holding(data: np.ndarray, offsets: np.ndarray, contents: list[str]) -> Iterator[int]:
    """Texts in which one of the contents lies; one across the end of a text is none."""
    raw = data.tobytes()
    for content in contents:
        wanted = content.encode()
        at = raw.find(wanted)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            inside = at + len(wanted) <= offsets[row + 1]
            if inside:
                yield row
            at = raw.find(wanted, int(offsets[row + 1]) if inside else at + 1)


def _units(
    data: np.ndarray, offsets: np.ndarray, added: list[str] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the units of all texts, units of text i being first[i] .. first[i+1], and which
    of them are texts that must not be cut."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64), np.zeros(0, bool)
    white = _SPACE[data]
    cut = np.zeros(len(data), bool)
    lone = ~white[:-2] & ~white[2:]
    cut[1:-1] = lone & ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A))
    cut[2:] |= lone & (data[1:-1] == 0x0A)
    cut[1:] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    # Bytes that begin a space outside ASCII, or a separator control character.
    odd = np.isin(data, (0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3))
    uncut = np.zeros(len(offsets) - 1, bool)
    suspects = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
    for row in suspects.tolist():
        text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
        uncut[row] = _ODD_SPACE.search(text) is not None
    for row in _holding(data, offsets, added or []):
        uncut[row] = True
    for row in np.flatnonzero(uncut):
        cut[offsets[row] : offsets[row + 1]] = False
    begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
    cut[begins] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, offsets), uncut[np.searchsorted(offsets, starts, "right") - 1]


def token_pieces(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``SEQUENCE`` ids of every document, as ``PIECE_SCHEMA``."""
    ta.small_batches(docs.sparkSession)

    def tokenised(batches):
        tokenizer = UnitTokenizer(tokenizer_path)
        for batch in batches:
            data, offsets = ta.strings(batch.column("text"))
            names = batch.column("doc_id")
            for low, high in ta.slices(offsets):
                part = data[offsets[low] : offsets[high]]
                ids, counts = tokenizer.ids(part, offsets[low : high + 1] - offsets[low])
                yield _pieces(names.slice(low, high - low), ids, counts, with_ids)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(tokenised, PIECE_SCHEMA)


def _pieces(names: pa.Array, ids: np.ndarray, counts: np.ndarray, with_ids: bool) -> pa.RecordBatch:
    """Cut each document, its end token included."""
    ends = np.cumsum(counts)
    all_ids = np.insert(ids, ends, END_ID).astype("<u4")
    total = counts + 1
    per_doc = -(-total // SEQUENCE)
    doc = np.repeat(np.arange(len(total)), per_doc)
    start = ta.ranges(per_doc) * SEQUENCE
    length = np.minimum(SEQUENCE, total[doc] - start)
    begin = (np.cumsum(total) - total)[doc] + start
    checks = [
        zlib.crc32(all_ids[b : b + n].tobytes())
        for b, n in zip(begin.tolist(), length.tolist(), strict=True)
    ]
    cuts = np.append(begin, len(all_ids)).astype(np.int32)
    lists = (
        pa.ListArray.from_arrays(pa.array(cuts), pa.array(all_ids.astype(np.int32)))
        if with_ids
        else pa.nulls(len(doc), pa.list_(pa.int32()))
    )
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(doc)),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array(checks, pa.int64()),
            pa.array(total[doc], pa.int64()),
            lists,
        ],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
    )


def packing_patterns(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths in a pack) for all pieces of the histogram."""
    free: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in free if r >= length), default=None)
            if room is None:
                free[size - length].append((left, (length, None)))
                break
            packs, pattern = free[room].pop()
            if not free[room]:
                del free[room]
            filled = min(left, packs)
            if packs > filled:
                free[room].append((packs - filled, pattern))
            free[room - length].append((filled, (length, pattern)))
            left -= filled
    plan = []
    for room in sorted(free):
        for packs, pattern in free[room]:
            lengths = []
            while pattern is not None:
                length, pattern = pattern
                lengths.append(length)
            plan.append((packs, lengths[::-1]))
    return plan


def slot_table(plan: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) keys of the runs of equal slots, their first sequence, offset."""
    taken: dict[int, int] = defaultdict(int)
    keys, sequences, offsets, sequence = [], [], [], 0
    for packs, lengths in plan:
        offset = 0
        for length in lengths:
            keys.append((length << 48) + taken[length])
            sequences.append(sequence)
            offsets.append(offset)
            taken[length] += packs
            offset += length
        sequence += packs
    order = np.argsort(np.array(keys, np.int64))
    return tuple(np.array(a, np.int64)[order] for a in (keys, sequences, offsets))


def pack_pieces(pieces: DataFrame) -> DataFrame:
    """Add sequence_id and offset to stored pieces (columns of ``PIECE_SCHEMA``)."""
    spark = pieces.sparkSession
    histogram = {
        r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()
    }  # at most SEQUENCE rows
    slots = spark.sparkContext.broadcast(slot_table(packing_patterns(histogram)))
    buckets = max(16, math.ceil(sum(histogram.values()) / BUCKET_PIECES))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "before",
            F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"),
        )
        .drop("n")
    )
    inside = F.row_number().over(
        Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    )
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside") - 1)
    columns = PIECE_SCHEMA.replace(",", "").split()[::2]

    def placed(batches):
        keys, sequences, offsets = slots.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            sequence = sequences[at] + (length << 48) + rank - keys[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offsets[at])],
                [*columns, "sequence_id", "offset"],
            )

    return ranked.select(*columns, "rank").mapInArrow(
        placed, PIECE_SCHEMA + ", sequence_id bigint, offset bigint"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place; ``ids`` is null unless asked for."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    token_pieces(docs, tokenizer_path, with_ids).write.parquet(path)
    return pack_pieces(spark.read.parquet(path))


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length) of pieces packed with their ids; a sequence is a bounded group."""
    gathered = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    ids = F.flatten(F.col("parts.ids"))
    return gathered.select("sequence_id", ids.alias("ids"), F.size(ids).alias("length"))
