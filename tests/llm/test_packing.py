"""Packing against the plain tokeniser and the rules of a packing."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from viewlog.llm import packing
from viewlog.llm import text_arrays as ta
from viewlog.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(rows, texts, tokenizer):
    """Pieces cover every document's ids once; sequences are gapless and no longer than allowed."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, packing.END_ID]
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SEQUENCE
        used += at
    return used / (packing.SEQUENCE * len(by_sequence))


def test_query_packs_all_documents(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    rows = QUERIES["op3_packing"](spark, data).collect()
    assert check(rows, {r["doc_id"]: r["text"] for r in docs}, tokenizer) > 0.97


def test_odd_texts(spark, tokenizer):
    texts = {
        1: None, 2: "", 3: " ", 4: "  two  spaces \n and\ttabs  ", 5: "a b c  d \x85 e",
        6: "it's  <|endoftext|> here", 7: "word " * 5000, 8: "x" * 9000, 9: "a\x1cb c \x1f d", 10: "é ü 你好 世界 　 z",
        11: "word " * 5000, 12: "\n\n a \n b", 13: "end ",
        14: "it's. 'tis a.b,c's x's'y 3's l'été l'a a\nb\n c \nd.\n\n.e a_b a-'s 1.5,\n\"q\" é. é's ß!\n",
        15: "\n", 16: ".\n", 17: "a\n", 18: "a.\r\nb", 19: "don't. we'll, I'm\nI'd 're've",
    }
    df = spark.createDataFrame(
        [(k, v, k, "x") for k, v in texts.items()], "doc_id int, text string, length int, ids string"
    )
    rows = packing.pack_documents(df, tokenizer_path()).collect()
    check(rows, texts, tokenizer)


LETTERS = "ab'sé. ,\n\t0_-ß\u00a0"


def test_units_give_the_ids_of_whole_texts(tokenizer):
    """Random texts of awkward characters, without Spark."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(LETTERS), rng.integers(0, 30))) for _ in range(4000)]
    data, offsets = ta.strings(pa.array(texts))
    ids, counts = packing.UnitTokenizer(tokenizer_path()).ids(data, offsets)
    ends = np.cumsum(counts)
    for text, low, high in zip(texts, ends - counts, ends, strict=True):
        assert ids[low:high].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_have_their_ids(tokenizer):
    """Inside, at the edges, next to letters and signs, broken, and across the end of a text."""
    rng = np.random.default_rng(7)
    parts = ["<|endoftext|>", "<|endof", "text|>", "<|", "|>", "a", " ", ".", "\n", "b c", "é", "\u00a0", "'s"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(3000)]
    texts += ["end of text <|endoftext|> next", "x <|endof", "text|> y", "<|endoftext|>", "", "<|endoftext|><|endoftext|>"]
    data, offsets = ta.strings(pa.array(texts))
    ids, counts = packing.UnitTokenizer(tokenizer_path()).ids(data, offsets)
    ends = np.cumsum(counts)
    for text, low, high in zip(texts, ends - counts, ends, strict=True):
        assert ids[low:high].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert 50256 in ids


def test_repeated_rows_and_null_ids(spark, tokenizer):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(df, tokenizer_path()).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df, tokenizer_path()).collect() == []


def test_sequences_hold_the_ids(spark, tokenizer):
    df = spark.createDataFrame([(1, "a b c"), (2, "word " * 3000)], "doc_id long, text string")
    packed = packing.pack_documents(df, tokenizer_path(), with_ids=True)
    ids = packing.packed_sequences(packed).agg(F.sum("length")).first()[0]
    assert ids == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in ("a b c", "word " * 3000))


def test_patterns_use_every_piece():
    rng = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in zip(range(1, 2049), rng.integers(0, 50, 2048), strict=True) if c}
    placed = defaultdict(int)
    for packs, lengths in packing.packing_patterns(histogram):
        assert sum(lengths) <= packing.SEQUENCE
        for n in lengths:
            placed[n] += packs
    assert placed == histogram
