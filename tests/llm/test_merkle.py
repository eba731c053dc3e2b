"""The manifest against a plain Merkle tree, and its SQL."""

from __future__ import annotations

import hashlib
import zlib

import oracle
import pytest

from viewlog.llm import merkle
from viewlog.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, root string, item int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    steps = []
    for nodes in tree[:-1]:
        first = i // 16 * 16
        run = nodes[first : first + 16]
        steps.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
        i //= 16
    return steps


def leaf(doc):
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in doc[:5]]
    return h(*said)


def lowered(doc):
    d, source, lang, n, text = doc[:5]
    if d is not None and text is not None and zlib.crc32(str(d).encode()) % 5 == 0:
        text = "".join(c.lower() if c.isascii() else c for c in text)
    return d, source, lang, n, text


def brute(docs):
    by = {}
    for doc in docs:
        by.setdefault(doc[1], []).append(doc)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[name] = levels([leaf(d) for d in by[name]])
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for i, doc in enumerate(by[name]):
            steps = path(trees[name], i) + path(top, place)
            node = leaf(lowered(doc))
            for before, after in steps:
                node = h(before, node, after)
            proof = h(*[x + y for x, y in steps])
            root = top[-1][0]
            out.append((doc[0], leaf(doc), trees[name][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def test_levels_and_sources(spark):
    docs = [(i, None if i % 700 == 0 else "big" if i % 3 else f"s{i % 40}", "en", i, f"Text {i}") for i in range(1500)]
    docs += [(None, None, None, None, None), (None, None, None, None, None), (7, "big", "en", 7, "Text 7"), (1, "é", None, None, "")]
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    got = sorted((tuple(r) for r in merkle.Manifest(rows).verified().collect()), key=str)
    assert got == brute(docs)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4097])
def test_log_is_gapless_and_complete(spark, n):
    docs = spark.createDataFrame([(i, "one", None, None, None, "", 0) for i in range(n)], SCHEMA)
    manifest = merkle.Manifest(docs)
    nodes = merkle.log_nodes(manifest.heights).collect()
    assert sorted(r["position"] for r in nodes) == list(range(len(nodes)))
    want = levels([leaf((i, "one", None, None, None)) for i in range(n)])
    assert {(r["level"], r["number"]): r["digest"] for r in nodes} == {
        (level, i): d for level, row in enumerate(want) for i, d in enumerate(row)
    }


def test_places_follow_completion():
    for k in range(1, 257):
        levels_here = merkle.levels_of(k)
        log = merkle.segment([str(i) for i in range(k)], levels_here)
        assert [log[merkle.position(0, i, k, levels_here)] for i in range(k)] == [str(i) for i in range(k)]
        assert merkle.position(levels_here, 0, k, levels_here) == len(log) - 1


def test_empty_table(spark):
    assert merkle.Manifest(spark.createDataFrame([], SCHEMA)).verified().collect() == []


def test_query_matches_sql(spark, data):
    name = "op13_merkle_manifest"
    with oracle.connection(data) as con:
        assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], data) == ""
