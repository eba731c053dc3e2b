"""Personal data against the plain patterns."""

from __future__ import annotations

import hashlib
import re
import time

import numpy as np

from viewlog.llm import pii
from viewlog.llm.queries import QUERIES

# The base patterns as they are stated.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind: str, span: str) -> bool:
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1]))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text: str) -> list:
    return [
        (kind, *m.span()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if valid(kind, m.group())
    ]


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(5)
    for letters in ("a1.@-", "12.", "4 -0", "+1 (.-", "aé@._1 +2()-"):
        for _ in range(1500):
            text = "".join(rng.choice(list(letters), rng.integers(0, 40)))
            assert pii.in_order(pii.base_spans(text)) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000, "a.@" * 60_000):
        pii.base_spans(text)
        pii.proposals(text)


def test_query_keeps_every_base_span(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op8_pii"](spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r["doc_id"]])
        listed = [f"{k}:{s}:{e}" for k, s, e in want]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert set(listed) <= set(spans)


def test_model_adds_other_spellings():
    rng = np.random.default_rng(2)
    texts = []
    for i in range(400):
        number = f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}"
        texts.append(f"some words {number} and ann.{i}@mail{i % 7}.example.com then 12{i} or 4.0 and 2019-03-{i % 28 + 1:02}")
    model = pii.SpanModel().fit(texts)
    text = "please write to bob.7(at)mail3.example.com or 4.0 in 2019-03-04"
    added = model.added(text, pii.base_spans(text))
    assert [text[s:e] for k, s, e in added if k == "email"] == ["bob.7(at)mail3.example.com"]
    clean = "version 4.0 of 2019-03-11 has 1234567 words"
    assert model.added(clean, pii.base_spans(clean)) == []


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, "d"), (1, "", "d"), (None, "x a.b@c.de é 1.2.3.4", "d"), (1, "é" * 9 + " a.b@c.de", "d")],
        "doc_id long, text string, doc string",
    )
    rows = pii.find_personal_data(df).collect()
    assert sorted(r["redacted"] or "" for r in rows) == ["", "", "x [email] é [ip]", "é" * 9 + " [email]"]
    assert pii.find_personal_data(df.limit(0)).collect() == []


def parts(text: str) -> set:
    return {text[s:e] for s, e in pii.proposals(text)}


def test_numbers_side_by_side_are_proposed():
    for sep in (" ", "  ", " / ", " - "):
        for numbers in (
            ["555-123-4567", "555-987-6543"],
            ["(555) 123-4567", "(555) 987-6543"],
            ["555-123-4567", "555-987-6543", "555-777-8888", "555-222-3333"],
            ["+1 (826) 555-4081", "190.137.223.204", "4111.1111.1111.1111", "+44 20 7946 0958"],
            [f"555-{i:03}-{i:04}" for i in range(300)],
        ):
            assert set(numbers) <= parts(f"call {sep.join(numbers)} now"), (sep, numbers[:2])
    assert {"(555-123-4567", "555-123-4567"} <= parts("(555-123-4567)")
    assert parts("(call) 555 12 or 1.23 in 2020") == set()


def test_model_keeps_neighbours_apart():
    rng = np.random.default_rng(3)
    texts = []
    for i in range(500):
        number = f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}"
        ip = ".".join(map(str, rng.integers(1, 255, 4)))
        texts.append(f"words {number} and {ip} then 12{i} or 4.0 and 2019-03-{i % 28 + 1:02} at 10:{i % 50 + 10} of {i} 1{i}")
    model = pii.SpanModel().fit(texts)
    for text, want in (
        ("see 555-123-4567 555-987-6543 there", ["555-123-4567", "555-987-6543"]),
        ("see (555) 123-4567 (555) 987-6543 there", ["(555) 123-4567", "(555) 987-6543"]),
        ("see +1 (826) 555-4081 190.137.223.204 there", ["+1 (826) 555-4081"]),
    ):
        added = model.added(text, pii.base_spans(text))
        assert sorted(text[s:e] for k, s, e in added if k == "phone") == sorted(want), text


def test_phone_beside_an_address_of_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = pii.find_personal_data(docs).filter("doc.doc_id = 1377").select("doc.text", "spans").collect()
    assert "+1 (826) 555-4081" in [r["text"][s["start"] : s["end"]] for r in rows for s in r["spans"]]


def test_rare_kinds_are_learnt_from_distinct_texts(spark):
    rows = [f"number {i} of 1{i} and 2019-03-{i % 28 + 1:02}" for i in range(20_000)]
    rows += [f"write {i} to ann.{i}@mail{i % 7}.example.com now" for i in range(12)]
    rows += ["one text 1234567 of many copies"] * 3_000
    docs = spark.createDataFrame([(r,) for r in rows], "text string").repartition(4)
    texts = pii.sample(docs)
    assert len(texts) == len(set(texts)) <= pii.KIND_ROWS + pii.CLEAN_ROWS
    assert sum("@" in t for t in texts) == 12
    assert "email" in pii.SpanModel().fit(texts).kinds


def test_spelt_addresses_of_any_length():
    """The whole run before the sign and the whole domain after it, in linear time."""
    text = "write to " + "a" * 80 + " (at) " + "b" * 90 + ".c" * 12 + " now"
    assert (9, len(text) - 4) in pii.proposals(text)
    began = time.perf_counter()
    for unit in ("a(at)", "a@", "a" * 50 + "@b.", "(dot)a@"):
        pii.proposals(unit * (200_000 // len(unit)))
    assert time.perf_counter() - began < 20
