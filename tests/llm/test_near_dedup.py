"""Near-duplicate groups against a comparison of all sets."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from viewlog.llm import near_dedup
from viewlog.llm.queries import QUERIES


def brute(texts: dict, width: int) -> dict:
    """doc_id to (set size, component), comparing all pairs that share a shingle."""
    sets, holders = {}, defaultdict(set)
    for doc, text in texts.items():
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
        for s in sets[doc]:
            holders[s].add(doc)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = set()
    for doc, own in sets.items():
        for other in {o for s in own for o in holders[s] if o > doc}:
            if (doc, other) not in seen and 100 * len(own & sets[other]) >= 80 * len(own | sets[other]):
                a, b = sorted((find(doc), find(other)))
                parent[b] = a
            seen.add((doc, other))
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_query_matches_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = brute({r["doc_id"]: r["text"] for r in docs}, 4)
    got = {r["doc_id"]: r for r in QUERIES["op1_minhash_near_dedup"](spark, data).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


WORDS = [f"w{i}" for i in range(60)]


def variants() -> dict:
    texts = {0: None, 1: "", 2: " \n", 3: "one two", 4: "ONE two", 5: "one  two three", 6: "one two three"}
    for i in range(40):  # each with one other word in another place
        texts[10 + i] = " ".join([*WORDS[:i], f"x{i % 3}", *WORDS[i + 1 :]])
    texts[60], texts[61] = " ".join(WORDS), " ".join(WORDS[:30]) + " unlike this " + " ".join(WORDS[:5])
    texts[62] = " ".join(f"v{i}" for i in range(30_000))
    texts[63] = texts[62] + " end"
    return texts


@pytest.mark.parametrize("limit", [near_dedup.TASK_SHINGLES, 200])
def test_groups_of_variants(spark, monkeypatch, limit):
    """Also with so small a limit that groups are solved in blocks."""
    monkeypatch.setattr(near_dedup, "TASK_SHINGLES", limit)
    monkeypatch.setattr(near_dedup, "REGION", 4)
    texts = variants()
    df = spark.createDataFrame(
        [(k, v, "x", k) for k, v in texts.items()], "doc_id long, text string, rep string, component int"
    ).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 4).collect()}
    assert got == brute(texts, 4)
    kept = near_dedup.keep_one_of_each(df, 4)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in got.items() if c == d}


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    rows = sorted(near_dedup.near_duplicates(df, 4).collect(), key=str)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in rows] == [
        (1, 1, True), (1, 1, True), (2, 1, False), (None, None, True),
    ]
    assert near_dedup.near_duplicates(df.limit(0), 4).collect() == []


def test_rows_of_one_id_count_as_one_document(spark):
    """Another text under the same id links as well."""
    words = " ".join(WORDS)
    df = spark.createDataFrame([(1, "q r s t u"), (1, words), (2, words + " x"), (3, "z")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df, 4).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}


def test_short_texts_differ_by_length(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a a"), (3, "a a a")], "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(df, 4).collect()} == {1, 2, 3}


def crowd(count: int, seed: int) -> dict:
    """Sets of one shared passage and own words, in pairs at 0.80 to 0.82 of each other."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(0, count, 2):
        own = [f"o{i}x{j}" for j in range(60)]
        texts[i] = " ".join(passage + own)
        # One changed word breaks 4 of 117 shingles; at both ends fewer.
        for place in rng.sample(range(3, 57), 3):
            own[place] = f"z{i}x{place}"
        texts[i + 1] = " ".join(passage + own)
    return texts


def test_no_link_is_lost_in_a_crowd(spark, monkeypatch):
    """5,000 sets share a passage, so that every tree holds crowded regions."""
    monkeypatch.setattr(near_dedup, "REGION", 8)
    texts = crowd(5000, 3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 4).collect()}
    want = brute_pairs(texts, 4)
    assert got == want
    assert sum(c != d for d, (_, c) in want.items()) > 2000


def brute_pairs(texts: dict, width: int) -> dict:
    """As ``brute``; a matrix product counts what two sets share."""
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in map(str.split, texts.values())]
    number = {s: i for i, s in enumerate(dict.fromkeys(s for own in sets for s in own))}
    kinds = [[number[s] for s in own] for own in sets]
    holders = defaultdict(list)
    for i, own in enumerate(kinds):
        for s in own:
            holders[s].append(i)
    shared = np.zeros((len(sets), len(sets)), np.int32)
    for held in holders.values():
        shared[np.ix_(held, held)] += 1
    size = np.array([len(s) for s in sets])
    linked = 100 * shared >= 80 * (size[:, None] + size[None, :] - shared)
    names, component = list(texts), {}
    for i, name in enumerate(names):
        if name in component:
            continue
        open_, group = [i], {i}
        while open_:
            new = set(np.flatnonzero(linked[open_.pop()]).tolist()) - group
            group |= new
            open_ += new
        component.update({names[j]: name for j in group})
    return {name: (len(s), component[name]) for name, s in zip(names, sets, strict=True)}


def test_wide_task_lists_are_not_broadcast(spark, monkeypatch, plan):
    texts = variants()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tasks = spark.createDataFrame([(10, [(k, 0, False) for k in range(500)])], "rep long, tasks array<struct<task: bigint, side: int, crossed: boolean>>")
    assert "BroadcastHashJoin" in plan(near_dedup.member_sets(df, tasks, 4))
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", 10_000)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = near_dedup.member_sets(df, tasks, 4)
        assert "BroadcastHashJoin" not in plan(made)
        assert made.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
