"""Quality rules, line dedup and decontamination: against SQL, and on awkward tables."""

from __future__ import annotations

import time

import oracle
import pytest
from pyspark.sql import functions as F

from viewlog.llm import decontaminate, line_dedup, quality_rules
from viewlog.llm.queries import ORACLES, QUERIES

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, doc string, votes int, n_words string, removed int"


def awkward(spark, *texts):
    """Rows with nulls, equal ids and columns named as the operators' own."""
    rows = [(i, t, None, f"s{i}", None, "d", 1, "w", 2) for i, t in enumerate(texts)]
    rows += [(None, "a null id " * 30, "en", None, 3, None, None, None, None)]
    rows += [(0, texts[0], None, "s0", None, "d", 1, "w", 2)]
    return spark.createDataFrame(rows, AWKWARD)


TEXTS = (
    "", None, " \t\n", "one", "word " * 49, "word " * 50, "good words of many kinds " * 30 + ".",
    "\n".join(f"line{i} has{i} other words{i} than line{i * i}" for i in range(40)), "é ü 你好 " * 100, "x" * 50_000,
    " ".join(f"w{i}" for i in range(30_000)), "same line\n" * 60, "a### b$$$ c&&& " * 30, "SHOUT LOUD AND CLEAR NOW " * 12,
)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, data, name):
    with oracle.connection(data) as con:
        assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], data) == ""


@pytest.mark.parametrize("name", ["op5_quality_rules", "op7_line_dedup"])
def test_native_queries_run_no_python(spark, data, plan, name):
    assert "Python" not in plan(QUERIES[name](spark, data)) and "Arrow" not in plan(QUERIES[name](spark, data))


def measured(text: str) -> tuple:
    """The base measures, plainly."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else set()
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_of_awkward_texts(spark):
    rows = quality_rules.judge_documents(awkward(spark, *TEXTS)).collect()
    assert len(rows) == len(TEXTS) + 2
    got = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(TEXTS):
        assert tuple(got[i][c] for c in quality_rules.BASE) == measured(text), i
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert got[0]["base_failed"] and not got[7]["base_failed"]


def test_stages_keep_the_columns_of_awkward_tables(spark):
    docs = awkward(spark, *TEXTS)
    items = spark.createDataFrame([(1, "good words of many kinds"), (2, None), (None, "")], "item_id int, text string")
    for stage in (
        quality_rules.keep_good,
        line_dedup.remove_boilerplate,
        lambda d: decontaminate.remove_passages(d, items),
    ):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.count() <= docs.count()
        assert stage(docs.limit(0)).collect() == []


def test_shared_lines_stay_where_they_stand_first(spark):
    rows = [(i, f"own {i}\n  shared by all \nrare" if i < 12 else f"own {i}\nrare", f"s{i}") for i in range(30)]
    rows += [(i, "local\nown text here", "s1") for i in range(40, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumn("text", F.when(F.col("doc_id") >= 20, F.regexp_replace("text", "\nrare", "")).otherwise(F.col("text")))
    marked = {r["doc"]["doc_id"]: r for r in line_dedup.mark_lines(docs, min_sites=10).collect()}
    assert marked[0]["n_removed"] == 0 and marked[0]["n_lines"] == 3
    assert marked[1]["kept_text"] == "own 1" and marked[11]["n_removed"] == 2
    assert marked[15]["kept_text"] == "own 15" and marked[25]["n_removed"] == 0
    assert marked[50]["n_removed"] == 0  # often, but on one site


def test_documents_made_of_shared_lines_go(spark):
    docs = spark.createDataFrame([(i, "all of it\nis shared", f"s{i}", 19) for i in range(15)], "doc_id long, text string, source string, n_chars int")
    assert [r["doc_id"] for r in line_dedup.remove_boilerplate(docs).collect()] == [0]


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 40])
def test_passages_are_cut(spark, block_bytes):
    """Also with a benchmark of several blocks."""
    items = spark.createDataFrame(
        [(1, ITEM), (2, "short item"), (3, " ".join(ITEM.split()[2:])), (4, None), (5, "..")], "item_id long, text string"
    )
    texts = {
        1: f"Before. {ITEM.upper()}, after.", 2: "a short, ITEM!", 3: " ".join(ITEM.split()[:9]), 4: None, 5: "",
        6: f"x {ITEM} y {ITEM}", 7: "w " * 40_000 + ITEM, 8: ITEM, 9: " ".join(ITEM.split()[1:11]),
    }
    docs = spark.createDataFrame([(k, v, "d", "h") for k, v in texts.items()], "doc_id long, text string, doc string, n_hit string").repartition(3)
    found = {r["doc"]["doc_id"]: r for r in decontaminate.find_passages(docs, items, block_bytes=block_bytes).collect()}
    assert {d: (r["n_words"], r["n_hit"], r["items"]) for d, r in found.items()} == {
        1: (14, 12, ["1", "3"]), 2: (3, 2, ["2"]), 3: (9, 0, []), 4: (0, 0, []), 5: (0, 0, []),
        6: (26, 24, ["1", "3"]), 7: (40_012, 12, ["1", "3"]), 8: (12, 12, ["1", "3"]), 9: (10, 10, ["1"]),
    }
    assert found[1]["clean_text"] == "Before. , after."
    assert found[6]["clean_text"] == "x  y "
    kept = {r["doc_id"] for r in decontaminate.remove_passages(docs, items).collect()}
    assert kept == set(texts) - {8, 9}


def test_index_finds_what_a_scan_finds():
    import numpy as np

    rng = np.random.default_rng(8)
    for symbols in (2, 3, 9, 300):
        codes = np.append(rng.integers(0, symbols, 700), 0)
        codes = np.concatenate([codes, codes[:300], [0]])
        index = decontaminate.FmIndex(codes, symbols)
        lengths = rng.integers(1, 6, 200)
        phrases = rng.integers(1, max(2, symbols), (200, 5))
        low, high = index.search(phrases, lengths)
        for row in range(200):
            want = [i for i in range(len(codes)) if codes[i : i + lengths[row]].tolist() == phrases[row, : lengths[row]].tolist()]
            assert sorted(index.locate(np.arange(low[row], max(low[row], high[row]))).tolist()) == want


def test_a_page_of_many_removed_lines(spark):
    """Twelve sites share 30,000 lines; removal must not take lines times removed lines."""
    shared = "\n".join(f"line {i}" for i in range(30_000))
    df = spark.createDataFrame([(i, f"s{i}", f"own {i}\n{shared}\nend {i}") for i in range(12)], "doc_id long, source string, text string")
    start = time.monotonic()
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(df).collect()}
    assert time.monotonic() - start < 60
    assert got[0] == f"own 0\n{shared}\nend 0"
    assert all(got[i] == f"own {i}\nend {i}" for i in range(1, 12))
