"""Benchmark passages in documents, found in an FM-index of each training shard.

A shard is a run of documents of about ``SHARD_WORDS`` words that one task holds. Its words are
coded by the vocabulary of the benchmark phrases; any other word, and the end of each document,
is code 0, which no phrase contains. The suffixes of the code sequence are sorted, the
Burrows-Wheeler transform goes into a wavelet matrix, and all phrases are searched backward at
once. Occurrences are located by walking back to a sampled suffix position.

A zero counts as a symbol of its own, ordered by position: a suffix is compared up to its first
zero only, and the position after a zero is always sampled, so no walk crosses one.

Documents are read once and nothing is shuffled. The phrases are sent to the tasks in blocks of
bounded size; a benchmark of several blocks takes one pass for each.

Defined results: null or wordless texts have no words and no hits; items without words have no
windows; equal windows of several items hit for all of them; rows with equal or null ids are
judged one by one (with several blocks: rows with equal id and text together); an empty table of
documents gives an empty result, an empty benchmark gives no hits. Other columns are kept,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlog.llm import text_arrays as ta

WIDTH = 10
SHARD_WORDS = 1 << 19
SAMPLE_EVERY = 8
BLOCK_BYTES = 2 << 20

HIT_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("clean_text", T.StringType()),
]


def suffix_order(codes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of ``codes`` (which ends in 0) in the order of their suffixes.

    The first sort is by as many symbols as fit 62 bits; then groups of equal suffixes alone are
    sorted by the rank of what follows, at twice the depth each time.
    """
    n, depth = len(codes), max(1, 62 // bits)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(depth):
        symbol = np.zeros(n, np.int64)
        symbol[: max(0, n - j)] = codes[j:]
        key = (key << bits) | np.where(alive, symbol, 0)
        alive &= symbol != 0
    order = np.argsort(key)
    changed = np.ones(n, bool)
    changed[1:] = key[order][1:] != key[order][:-1]
    # Suffixes that met a zero are done: equal ones stand in order of position.
    rows = np.flatnonzero(~alive[order] & ~_lone(changed))
    order[rows] = order[rows][np.lexsort((order[rows], key[order[rows]]))]
    changed[rows] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(changed)[np.cumsum(changed) - 1]
    del key, alive
    while True:
        rows = np.flatnonzero(~_lone(changed))
        if not len(rows):
            return order
        # No zero within ``depth`` symbols, so something follows there.
        part = order[rows]
        key = rank[part] * n + rank[part + depth]
        sort = np.argsort(key)
        part, key = part[sort], key[sort]
        order[rows] = part
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        changed[rows] = new
        rank[part] = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        depth *= 2


def _lone(changed: np.ndarray) -> np.ndarray:
    """Rows that are a group of their own, from where groups begin."""
    return changed & np.append(changed[1:], True)


class FmIndex:
    """Backward search and location over a code sequence that ends in 0."""

    def __init__(self, codes: np.ndarray, symbols: int):
        n = len(codes)
        self.bits = max(1, int(symbols - 1).bit_length())
        order = suffix_order(codes, self.bits)
        self.bwt = np.where(order > 0, codes[order - 1], 0).astype(np.int32)
        self.first = np.zeros(symbols + 1, np.int64)
        self.first[1:] = np.cumsum(np.bincount(codes, minlength=symbols))
        marked = (order % SAMPLE_EVERY == 0) | (self.bwt == 0)
        self.marked, self.samples = marked, order[marked]
        self.sample_row = np.cumsum(marked) - 1
        self.levels, self.zeros, current = [], [], self.bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(n - int(ones[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        every = np.arange(symbols)
        self.base = self._descend(every, np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            up = (symbol >> (self.bits - 1 - level)) & 1
            before = ones[row]
            row = np.where(up == 1, zeros + before, row - before)
        return row

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row of the transform."""
        return self._descend(symbol, row) - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each phrase."""
        last = phrases[np.arange(len(phrases)), lengths - 1]
        low, high = self.first[last].copy(), self.first[last + 1].copy()
        for back in range(2, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        found, steps, rows = np.empty(len(rows), np.int64), 0, rows.copy()
        open_rows = np.arange(len(rows))
        while len(open_rows):
            at = rows[open_rows]
            done = self.marked[at]
            found[open_rows[done]] = self.samples[self.sample_row[at[done]]] + steps
            open_rows, at = open_rows[~done], at[~done]
            symbol = self.bwt[at].astype(np.int64)
            rows[open_rows] = self.first[symbol] + self.rank(symbol, at)
            steps += 1
        return found


class Phrases:
    """Distinct windows of the items, coded by a vocabulary of word hashes."""

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH):
        ids = [i for i, _ in items]
        data, offsets = ta.strings(pa.array([t for _, t in items], pa.string()))
        data = ta.LOWER[data]
        starts, ends, first = ta.word_spans(data, offsets, ta.ALNUM_WORD)
        hashes = ta.span_hashes(data, starts, ends)
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        windows: dict[tuple, set[str]] = {}
        for item, low, high in zip(ids, first[:-1], first[1:], strict=True):
            words = codes[low:high] + 1
            for at in range(max(1, len(words) - width + 1)) if len(words) else ():
                windows.setdefault(tuple(words[at : at + width].tolist()), set()).add(item)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.codes = np.zeros((len(windows), width), np.int64)
        for row, window in enumerate(windows):
            self.codes[row, : len(window)] = window
        self.items = [sorted(found) for found in windows.values()]

    def coded(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def phrase_blocks(benchmark: DataFrame, width: int, block_bytes: int) -> tuple[int, Iterator[Phrases]]:
    """How many blocks of about ``block_bytes`` of text there are, and their windows in turn."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(
        "text IS NOT NULL"
    )
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return blocks, (
        Phrases([(r["item_id"] or "", r["text"]) for r in items.filter(block == b).collect()], width)
        for b in range(blocks)
    )


class _Shard:
    """Codes of the documents gathered so far."""

    def __init__(self):
        self.batches, self.texts, self.size = [], [], 0

    def add(self, batch: pa.RecordBatch, phrases: Phrases) -> None:
        data, offsets = ta.strings(batch.column("text"))
        self.batches.append(batch)
        for low, high in ta.slices(offsets):
            part = data[offsets[low] : offsets[high]]
            at = offsets[low : high + 1] - offsets[low]
            lower = ta.LOWER[part]
            starts, ends, first = ta.word_spans(lower, at, ta.ALNUM_WORD)
            codes = phrases.coded(ta.span_hashes(lower, starts, ends))
            self.texts.append((part, at, starts, ends, first, codes))
            self.size += len(codes)

    def hits(self, phrases: Phrases) -> list[dict]:
        """One dict of hit fields for each document."""
        counts = np.concatenate([np.diff(t[4]) for t in self.texts])
        place = np.cumsum(counts + 1) - counts - 1  # a zero stands after each document
        sequence = np.zeros(int(counts.sum()) + len(counts), np.int64)
        words = np.concatenate([t[5] for t in self.texts])
        owner = np.repeat(np.arange(len(counts)), counts)
        sequence[np.arange(len(words)) + owner] = words
        empty = np.zeros(0, np.int64)
        at, which = empty, empty
        if len(phrases.lengths) and sequence.any():
            index = FmIndex(sequence, len(phrases.vocabulary) + 1)
            low, high = index.search(phrases.codes, phrases.lengths)
            which = np.repeat(np.arange(len(low)), np.maximum(high - low, 0))
            rows = np.repeat(low, np.maximum(high - low, 0)) + ta.ranges(np.maximum(high - low, 0))
            at = index.locate(rows)
        change = np.zeros(len(sequence) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + phrases.lengths[which], -1)
        covered = np.cumsum(change[:-1]) > 0
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        span_low, span_high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc_of = np.searchsorted(place, at, "right") - 1
        pairs = np.unique(doc_of * max(1, len(phrases.lengths)) + which)
        items: dict[int, set] = {}
        for pair in pairs.tolist():
            doc, phrase = divmod(pair, max(1, len(phrases.lengths)))
            items.setdefault(doc, set()).update(phrases.items[phrase])
        spans: dict[int, list] = {}
        span_doc = np.searchsorted(place, span_low, "right") - 1
        for doc, low, high in zip(span_doc.tolist(), span_low.tolist(), span_high.tolist(), strict=True):
            spans.setdefault(doc, []).append([low - int(place[doc]), high - int(place[doc])])
        out, doc = [], 0
        for part, offsets, starts, ends, first, _ in self.texts:
            for row in range(len(offsets) - 1):
                own = spans.get(doc, [])
                out.append(
                    {
                        "n_words": int(first[row + 1] - first[row]),
                        "n_hit": sum(high - low for low, high in own),
                        "items": sorted(items.get(doc, ())),
                        "spans": own,
                        "clean_text": _cut(part, offsets, row, starts, ends, int(first[row]), own),
                    }
                )
                doc += 1
        return out


def _cut(data, offsets, row, starts, ends, first, spans) -> str | None:
    """The text without the words of the spans and what stands between them; None if unchanged."""
    if not spans:
        return None
    pieces, at = [], int(offsets[row])
    for low, high in spans:
        pieces.append(data[at : starts[first + low]].tobytes())
        at = int(ends[first + high - 1])
    pieces.append(data[at : offsets[row + 1]].tobytes())
    return b"".join(pieces).decode("utf-8", "replace")


def _search(docs: DataFrame, keep: list[str], phrases: Phrases) -> DataFrame:
    spark = docs.sparkSession
    ta.small_batches(spark)
    sent = ta.send(spark, phrases)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), "text")
    schema = T.StructType([rows.schema["doc"], *HIT_FIELDS])
    types = pa.schema(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.list_(pa.int32()))),
            ("clean_text", pa.string()),
        ]
    )

    def search(batches):
        own = ta.received(sent)

        def results(shard):
            found, done = shard.hits(own), 0
            for batch in shard.batches:
                hits = found[done : done + batch.num_rows]
                done += batch.num_rows
                columns = [pa.array([h[f.name] for h in hits], f.type) for f in types]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), *columns], ["doc", *types.names]
                )

        shard = _Shard()
        for batch in batches:
            if batch.num_rows:
                shard.add(batch, own)
            if shard.size >= SHARD_WORDS:
                yield from results(shard)
                shard = _Shard()
        if shard.batches:
            yield from results(shard)

    return rows.mapInArrow(search, schema)


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc, n_words, n_hit, items, spans, clean_text) of all rows.

    ``doc`` holds the columns named in ``keep`` (default: all). ``spans`` are merged ranges of
    word numbers, end exclusive; ``clean_text`` is the text without them, null if nothing goes.
    """
    count, blocks = phrase_blocks(benchmark, width, block_bytes)
    keep = docs.columns if keep is None else keep
    if count == 1:
        return _search(docs, keep, next(blocks))
    return _merged(docs, keep, blocks)


def _merged(docs: DataFrame, keep: list[str], blocks: Iterator[Phrases]) -> DataFrame:
    """Several blocks: spans of each are gathered per document, merged, and cut out at last."""
    key = F.xxhash64("text")
    keyed = docs.select("doc_id", "text", key.alias("text_key"))
    found = None
    for phrases in blocks:
        part = _search(keyed, ["doc_id", "text_key"], phrases).filter("n_hit > 0")
        part = part.select("doc.doc_id", "doc.text_key", "items", "spans")
        found = part if found is None else found.unionByName(part)
    gathered = found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
    )
    gathered = gathered.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), "doc_id", "text", key.alias("text_key")
    )
    joined = rows.join(
        gathered,
        F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("text_key").eqNullSafe(F.col("hit_key")),
        "left",
    ).select("doc", "text", "items", "spans")
    schema = T.StructType([rows.schema["doc"], *HIT_FIELDS])

    def cut(batches):
        for batch in batches:
            data, offsets = ta.strings(batch.column("text"))
            starts, ends, first = ta.word_spans(ta.LOWER[data], offsets, ta.ALNUM_WORD)
            spans = [merge_spans(s or []) for s in batch.column("spans").to_pylist()]
            clean = [
                _cut(data, offsets, row, starts, ends, int(first[row]), own)
                for row, own in enumerate(spans)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([sum(b - a for a, b in own) for own in spans], pa.int64()),
                    pa.array([i or [] for i in batch.column("items").to_pylist()], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    pa.array(clean, pa.string()),
                ],
                ["doc", *(f.name for f in HIT_FIELDS)],
            )

    return joined.mapInArrow(cut, schema)


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return merged


def remove_passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with benchmark passages cut out, with their own columns.

    A document that keeps no word is dropped. n_chars, if there is one, follows the text.
    """
    found = find_passages(docs, benchmark, width=width)
    found = found.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    changed = {"text": F.coalesce("clean_text", "doc.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_hit") == 0, F.col("doc.n_chars")).otherwise(
            F.length("clean_text").cast(kind)
        )
    return found.select(*(changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS k, w[i : i + least(len(w), 10) - 1] AS win FROM
  (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, w[i : i + k - 1] AS win FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw USING (k, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM
  (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM
  (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit,
  coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""
