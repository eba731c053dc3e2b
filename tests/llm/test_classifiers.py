"""The trained scorers on held-out rows, and on awkward tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from viewlog.llm import quality_model, toxicity
from viewlog.llm.boosting import BoostedTrees, calibrate
from viewlog.llm.queries import QUERIES


def area(score, y) -> float:
    """Probability that a row of class 1 scores above one of class 0."""
    score, y = np.array(score), np.array(y)
    a, b = score[y == 1][:, None], score[y == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


@pytest.mark.parametrize(
    "name, label, parts, out, least",
    [("op9_toxicity", "toxic", 5, 0, 0.8), ("op10_quality_classifier", "quality", 3, 1, 0.9)],
)
def test_held_out_rows_are_told_apart(spark, data, name, label, parts, out, least):
    folder = data.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert area([r["score"] for r in held], [labels[r["doc_id"]] for r in held]) >= least


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_model, "quality")])
def test_awkward_tables(spark, module, label):
    texts = ["", None, "word", "x" * 40_000, "plain words here. " * 2000]
    rows = [(i, t, "s", 0.5) for i, t in enumerate(texts)] + [(None, "no id", None, None), (0, "", "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, made string, score double")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    odd = spark.createDataFrame([(2, 1), (2, 1), (3, 0), (4, None), (None, 1), (99, 0)], f"doc_id long, {label} int")
    for labels in (none, odd):
        got = module.score_documents(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert module.score_documents(docs.limit(0), labels).collect() == []


def test_toxic_sentences_are_located(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(400):
        text = ". ".join(" ".join(rng.choice(words, 8)) for _ in range(5))
        if i % 4 == 0:
            text += f". {' '.join(rng.choice(words, 3))} badword and more. " + " ".join(rng.choice(words, 8))
        rows.append((i, text, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score_documents(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got)
    assert all("badword" in s for r in got for s in r["sentences"]) and any(r["sentences"] for r in got)


def test_word_vectors_do_not_depend_on_the_partitioning(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one, many = (quality_model.context_counts(docs.repartition(n)) for n in (1, 7))
    assert (one == many).all()


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    slope, shift = calibrate(np.array([-3.0, -2.0, 2.0, 3.0] * 10), np.array([0, 0, 1, 1] * 10))
    assert 0 < slope < 50 and abs(shift) < 5
