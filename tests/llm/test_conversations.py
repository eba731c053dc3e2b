"""Repaired conversations against dynamic programming and SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import oracle
import pytest

from viewlog.llm import conversations as cv
from viewlog.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, long int"


def cheapest(codes):
    """(cost, letters) by dynamic programming from the end over (cost, letters) pairs."""
    best = {0: (0, ""), 3: (0, ""), 2: (5, "I"), 1: (10, "II")}
    for code in reversed(codes):
        took = {}
        for state in range(4):
            found = []
            for letter, cost, rows, after in cv.arcs(code, state):
                if rows:
                    found.append((best[after][0] + cost, letter + best[after][1]))
            took[state] = min(found)
        best = {
            state: min(
                took[state],
                (took[cv.DUE[state]][0] + 5, "I" + took[cv.DUE[state]][1]),
                (took[cv.DUE[cv.DUE[state]]][0] + 10, "II" + took[cv.DUE[cv.DUE[state]]][1]),
            )
            for state in range(4)
        }
    return best[0]


def test_auction_finds_the_cheapest_repair():
    for n in range(5):
        for codes in itertools.product("suaoxSUAO", repeat=n):
            assert cv.solve("".join(codes)) == cheapest(codes)


def test_blocks_of_long_conversations(monkeypatch):
    deal = random.Random(3)
    for block in (2, 5, 32):
        monkeypatch.setattr(cv, "BLOCK", block)
        for _ in range(60):
            codes = "".join(deal.choices("suaoxSUAO", weights=[1, 6, 6, 1, 2, 1, 1, 1, 1], k=deal.randint(33, 150)))
            assert cv.Lattice(codes).trace() == cheapest(codes)


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        own = convs.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        if kind:
            own.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        codes, n, seen = "", [0, 0, 0], set()
        for _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            first = role[:1] if role[:1] and role[:1] in "sua" else "o"
            if fault is not None:
                n[fault] += 1
            codes += "x" if fault in (0, 1) else first.upper() if fault == 2 else first
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest(codes)
        lines, at, due = [], 0, "user"
        for letter in audit:
            if letter == "I":
                lines.append(f"{due}:")
            elif letter != "D":
                role = own[at][1] if letter == "K" else due
                lines.append(f"{role}:{own[at][2]}")
            at += letter != "I"
            if letter != "D":
                due = "assistant" if lines[-1].startswith("u") else "user"
        out.append((conv, gaps, *n, bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, convs, most):
    deal = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut", "", None, " \n", "Yes.", "tail.\n ", "é.", "x" * 50 + "."]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "unknown"]
    return [
        (None if c == 0 else c, deal.choice([None, *range(6)]) if c % 3 == 0 else t, deal.choice(roles), deal.choice(texts))
        for c in range(convs)
        for t in range(deal.randint(1, most))
    ]


@pytest.mark.parametrize("limit", [4096, 3])
def test_repair_matches_brute_force(spark, monkeypatch, limit):
    """With the lower limit most conversations take the way of the long ones."""
    monkeypatch.setattr(cv, "LONG_ROWS", limit)
    rows = random_rows(1, 120, 30) + [(999, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(300)]
    rows += [(1234, 5 * t + 3, "user", "Gone.") for t in range(900) if zlib.crc32(f"1234:{5 * t + 3}".encode()) % 20 == 0]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in cv.repair(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert cv.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_sql(spark, data):
    name = "op11_conversation_repair"
    with oracle.connection(data) as con:
        assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], data) == ""
