"""The pipeline's stages against plain computations, one after the other."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import pytest
from test_near_dedup import brute
from test_packing import check

import corpus_pipeline
from viewlog.llm import decontaminate, line_dedup, quality_rules
from viewlog.llm.queries import tokenizer_path


def good(path: str) -> set:
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
        return {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.ORACLE_SQL}) WHERE kept").fetchall()}


def without_lines(docs: dict) -> dict:
    sites, first = defaultdict(set), {}
    strip = " \t\n\x0b\x0c\r"
    for d in sorted(docs):
        for at, line in enumerate((docs[d]["text"] or "").split("\n")):
            if key := line.strip(strip):
                sites[key].add(docs[d]["source"])
                first.setdefault(key, (d, at))
    out = {}
    for d, row in docs.items():
        kept = [
            x for at, x in enumerate((row["text"] or "").split("\n"))
            if not x.strip(strip) or len(sites[x.strip(strip)] - {None}) < line_dedup.MIN_SITES or first[x.strip(strip)] == (d, at)
        ]
        if "\n".join(kept) == row["text"] or "".join(kept).strip(strip):
            out[d] = "\n".join(kept)
    return out


def without_passages(texts: dict, items: list) -> dict:
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    windows = set()
    for item in items:
        words = pattern.findall((item or "").translate(lower))
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    out = {}
    for d, text in texts.items():
        found = list(pattern.finditer(text.translate(lower)))
        words, hit = [m.group() for m in found], set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if hit and len(hit) == len(words):
            continue
        pieces, at = [], 0
        for low, high in decontaminate.merge_spans([[i, i + 1] for i in hit]):
            pieces.append(text[at : found[low].start()])
            at = found[high - 1].end()
        out[d] = "".join([*pieces, text[at:]])
    return out


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_stages(spark, data, tokenizer):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = good(data)
    texts = without_lines({d: r for d, r in docs.items() if d in kept})
    groups = brute(texts, 5)
    texts = without_passages({d: t for d, t in texts.items() if groups[d][1] == d}, items)
    rows = corpus_pipeline.run(spark, data).collect()
    assert 0 < len(texts) < len(docs)
    check(rows, texts, tokenizer)


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near dedup", "decontamination", "packing",
    ]


def test_stages_take_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert out.collect() == []
        docs = out if out.columns == docs.columns else docs
