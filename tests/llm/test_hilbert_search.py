"""Nearest neighbours against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from viewlog.llm import hilbert_search as hs
from viewlog.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, query int, rep string"


def brute(rows, nearest=20):
    """Exact ranking of (vec_id, vector) rows; scores in double precision."""
    rows = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in sorted(rows) if v]
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            scored = sorted((-float((v * w).sum()), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in scored[:nearest]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hit / sum(len(v) for v in want.values())


def test_hilbert_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(2**bits), repeat=axes)))
        keys = hs.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_query_recall(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want, got = brute(rows), by_query(QUERIES["op12_nearest_neighbours"](spark, data))
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    for q, own in got.items():
        exact = {i: s for i, s in brute([(q, dict(rows)[q])] + [r for r in rows if r[0] in {i for i, _ in own}])[q]}
        assert own == [(i, pytest.approx(exact[i], abs=1e-12)) for i, _ in own]


def clustered(n, dims, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(n // 50, dims))
    return (centres[random.integers(0, len(centres), n)] + 0.1 * random.normal(size=(n, dims))).astype(np.float32)


def test_windows_and_blocks(spark, monkeypatch):
    """Narrow windows over many blocks and groups; norms differ, and a third are near copies."""
    monkeypatch.setattr(hs, "LEAST_WINDOW", 40)
    monkeypatch.setattr(hs, "BLOCK", 64)
    monkeypatch.setattr(hs, "GROUP_ROWS", 50)
    x = clustered(2000, 16, 1)
    x[:600] = x[0] + 0.01 * np.random.default_rng(2).normal(size=(600, 16))
    rows = [(i, x[i].tolist()) for i in range(len(x))]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    index = hs.Index(df)
    window, want = index.window(), brute(rows)
    assert window < 500
    assert recall(by_query(index.search(window=window)), want) >= 0.9


def test_copies_ties_and_odd_rows(spark):
    random = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 2.0] if i % 3 == 0 else random.normal(size=3).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200, [1.0, 0.0]), (201, [0.5, 0.5]), (220, [1.0])]
    odd = [(300, None), (320, [0.0, 0.0, 0.0]), (301, []), (302, [1.0, None, 2.0]), (303, [float("nan"), 1.0, 1.0]), (340, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (200, [1.0, 0.0]), (200, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + odd], SCHEMA)
    got, want = by_query(hs.Index(df).search()), brute(rows)
    assert got == {q: [(i, pytest.approx(s, abs=1e-12)) for i, s in own] for q, own in want.items() if own}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hs.Index(empty).search().collect() == []
    alone = spark.createDataFrame([(20, [1.0, 2.0], 0, 0, "")], SCHEMA)
    assert hs.Index(alone).search().collect() == []
