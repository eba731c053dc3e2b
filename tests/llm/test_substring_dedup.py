"""Removal of repeated passages against a plain computation."""

from __future__ import annotations

import hashlib
import re

import pytest

from viewlog.llm import substring_dedup
from viewlog.llm.queries import QUERIES


def brute(texts: dict, width: int = 13) -> dict:
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts.items()}
    first: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, own in words.items():
        gone = set()
        for i in range(len(own) - width + 1):
            if first[tuple(own[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out[d] = (len(own), len(gone), kept)
    return out


def test_query_matches_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = brute({r["doc_id"]: r["text"] for r in docs})
    got = {r["doc_id"]: r for r in QUERIES["op2_substring_dedup"](spark, data).collect()}
    assert set(got) == set(want)
    for d, (n, lost, kept) in want.items():
        assert (got[d]["n_words"], got[d]["n_removed"]) == (n, lost)
        assert got[d]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


W = [f"w{i}" for i in range(40)]


@pytest.mark.parametrize("shard_bytes, range_hashes", [(4 << 20, 1 << 20), (300, 20)])
def test_passages(spark, monkeypatch, shard_bytes, range_hashes):
    """Also over many shards and ranges."""
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(substring_dedup, "RANGE_HASHES", range_hashes)
    texts = {
        1: None, 2: "", 3: " ".join(W), 4: "x " + " ".join(W[5:25]) + " y", 5: " ".join(W), 6: " ".join(W[:13]),
        7: " ".join(W[:12]), 8: " ".join(W[:12]), 9: "a " * 40, 10: "a  " * 13, 11: "W0 " + " ".join(W[1:14]),
        12: " ".join(W[20:35] + W[2:16]), 13: "é\n" + "\t".join(W[:14]), 14: "q " * 20_000 + " ".join(W[8:30]),
        0: " ".join(W[30:40] + ["z"] * 14), 15: "z " * 13,
    }
    df = spark.createDataFrame(
        [(k, v, "x", k) for k, v in texts.items()], "doc_id int, text string, shard string, kept int"
    ).repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.repeats(df).collect()}
    assert got == brute(texts)


def test_null_ids_repeats_and_empty_table(spark):
    text = " ".join(W)
    df = spark.createDataFrame([(None, text), (2, text), (2, text), (3, text)], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.repeats(df).collect())
    assert rows == [("2", 0), ("2", 0), ("3", 40), ("None", 40)]
    assert substring_dedup.repeats(df.limit(0)).collect() == []
