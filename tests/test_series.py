from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from viewlog.plans import driver_views, reports
from viewlog.plans.driver_views import table
from viewlog.session import scratch_path
from viewlog.streaming import intervals, ledger, timing_states
from viewlog.streaming.load_stream import LoadStream

START = datetime(2024, 1, 1)
SAMPLE = "mapper long, tag string, start timestamp, elapsed_ms double, error boolean"


def samples(spark, *calls):
    """Calls as (mapper, tag, minute, ms, failed)."""
    rows = [(m, t, START + timedelta(minutes=at), ms, bad) for m, t, at, ms, bad in calls]
    return spark.createDataFrame(rows, SAMPLE)


def first_minute():
    return int(START.timestamp() // 60)


def test_failed_calls_are_counted_and_not_timed(spark):
    df = samples(spark, (1, "get", 0, 10.0, False), (1, "get", 1, 30.0, False), (2, "get", 1, 99.0, True))
    row = intervals.interval_stats(df, 5).first()
    assert (row["count"], row["mean"], row["min"], row["max"], row["errors"]) == (2, 20.0, 10.0, 30.0, 1)
    assert row["stddev"] == 10.0
    sampled = intervals.interval_stats(df, 5, sample_deviation=True).first()
    assert sampled["stddev"] == pytest.approx(200**0.5)


def test_only_failed_calls(spark):
    row = intervals.interval_stats(samples(spark, (1, "get", 0, 5.0, True)), 5).first()
    assert (row["count"], row["mean"], row["errors"]) == (0, None, 1)


def test_sample_belongs_to_the_interval_of_its_start(spark):
    df = samples(spark, (1, "get", 4, 10.0 * 60_000, False), (1, "get", 5, 1.0, False))
    minutes = sorted(r["minute"] for r in intervals.interval_stats(df, 5).collect())
    assert minutes == [first_minute(), first_minute() + 5]


def test_open_interval_is_left_out(spark):
    df = samples(spark, (1, "get", 0, 1.0, False), (1, "get", 5, 1.0, False), (1, "get", 7, 1.0, False))
    stats = intervals.interval_stats(df, 5)
    closed = intervals.closed_intervals(stats, 5, intervals.last_minute(df))
    assert [r["minute"] for r in closed.collect()] == [first_minute()]


def test_carry_forward(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None)], "s string, t int, v int")
    got = intervals.carry_forward(df, "s", "t", "v").orderBy("t")
    assert [r.v for r in got.collect()] == [0, 5, 5]


def test_threads_are_carried_and_summed(spark):
    df = samples(
        spark,
        *[(m, "get", at, 1.0, False) for m in (1, 2) for at in (0, 5, 10)],
    )
    base = first_minute()
    readings = spark.createDataFrame(
        [(1, base, 4), (1, base + 6, 8), (1, base + 8, 12), (2, base + 10, 4)],
        "mapper long, minute long, threads long",
    )
    got = intervals.interval_threads(df, readings, 5).orderBy("minute").collect()
    assert [(r.minute - base, r.threads) for r in got] == [(0, 4), (5, 12), (10, 16)]


def test_series_has_a_row_for_every_task(spark):
    df = samples(spark, (1, "get", 0, 1.0, False), (1, "list", 5, 2.0, False), (1, "get", 5, 2.0, True))
    readings = spark.createDataFrame([(1, first_minute(), 4)], "mapper long, minute long, threads long")
    series = intervals.load_series(df, readings, 5, ["get", "list"])
    got = {(r.minute - first_minute(), r.tag): (r.threads, r.mean, r["count"], r.errors) for r in series.collect()}
    assert got == {
        (0, "get"): (4, 1.0, 1, 0),
        (0, "list"): (4, None, 0, 0),
        (5, "get"): (4, None, 0, 1),
        (5, "list"): (4, 2.0, 1, 0),
    }
    printed = reports.printed_stats(series).filter("tag = 'list'").orderBy("minute").collect()
    assert [(r.mean, r["count"], r.errors) for r in printed] == [("-", "0", "0"), ("0.002s", "1", "0")]


def stream_files(spark, events, parts):
    """Events as several files in order of time, as a stream would find them."""
    path = scratch_path(spark, "test-stream")
    for number, part in enumerate(parts):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return f"{path}/in", path


def test_stream_equals_batch(spark, data):
    events = table(spark, data, "events")
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    source, root = stream_files(spark, events, [F.col("ts") < middle, F.col("ts") >= middle])
    session = intervals.stream_session(spark, 2)
    stream = session.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second start finds nothing new and writes nothing twice
        intervals.stream_interval_stats(
            driver_views.samples_of(stream), 60, f"{root}/out", f"{root}/state", "1 hour"
        ).awaitTermination()
    got = spark.read.parquet(f"{root}/out")
    rows = driver_views.samples_of(events)
    end = rows.agg(F.max("start") - F.expr("interval 1 hour")).first()[0]
    batch = intervals.interval_stats(rows, 60).filter(
        F.timestamp_seconds((F.col("minute") + 60) * 60) <= F.lit(end)
    )
    names = ["minute", "tag", "min", "max", "count", "errors"]
    assert got.count() == batch.count() > 0
    assert got.select(names).exceptAll(batch.select(names)).count() == 0


def test_stream_drops_rows_behind_the_watermark(spark):
    root = scratch_path(spark, "test-late")
    on_time = samples(spark, (1, "get", 0, 1.0, False), (1, "get", 30, 1.0, False))
    late = samples(spark, (1, "get", 1, 1.0, False), (1, "get", 60, 1.0, False))
    session = intervals.stream_session(spark, 2)
    for df in (on_time, late):
        df.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = session.readStream.schema(df.schema).parquet(f"{root}/in")
        query = intervals.stream_interval_stats(stream, 5, f"{root}/out", f"{root}/state", "0 seconds")
        query.awaitTermination()
    assert intervals.dropped_late(query) == 1
    got = spark.read.parquet(f"{root}/out").orderBy("minute").collect()
    assert [(r.minute - first_minute(), r["count"]) for r in got] == [(0, 1), (30, 1)]


def test_load_store_documents(spark):
    runs = spark.createDataFrame(
        [("a.xml", "text_to_text", 10.0), ("a.xml", "text_to_text", 30.0), ("a.xml", "copy", 5.0)],
        "file string, tag string, elapsed_ms double",
    )
    document = json.loads(reports.load_store_report(runs).first()["document"])
    assert document == {
        "a.xml": {
            "copy": {"avg": 5.0, "min": 5.0, "max": 5.0, "standardDeviation": 0.0, "count": 1},
            "text_to_text": {"avg": 20.0, "min": 10.0, "max": 30.0, "standardDeviation": 10.0, "count": 2},
        }
    }
    chart = reports.min_avg_max_series(reports.load_store_stats(runs)).collect()
    assert {round(r.axis_limit, 6) for r in chart} == {33.0}


def test_load_test_document(spark):
    df = samples(spark, (1, "get", 0, 10.0, False), (1, "get", 5, 20.0, False), (1, "get", 5, 9.0, True))
    readings = spark.createDataFrame(
        [(1, first_minute(), 4), (1, first_minute() + 5, 8)], "mapper long, minute long, threads long"
    )
    series = intervals.load_series(df, readings, 5, ["get"])
    document = json.loads(reports.load_test_report({"a.xml": series}).first()["document"])
    assert [e["threads"] for e in document] == [4, 8]
    assert document[1]["mean"] == 20.0 and document[1]["error"] == "1"
    chart = {r.threads: r.scaled for r in reports.response_vs_threads(series).collect()}
    assert chart[8] == pytest.approx(1 / 1.1)


def test_load_test_report_keeps_every_interval(spark):
    """Equal thread counts, intervals of errors alone, and several result files."""
    df = samples(spark, (1, "get", 0, 10.0, False), (1, "get", 5, 20.0, False), (1, "get", 10, 9.0, True))
    readings = spark.createDataFrame([(1, first_minute(), 4)], "mapper long, minute long, threads long")
    series = intervals.load_series(df, readings, 5, ["get"])
    rows = reports.load_test_report({"a.xml": series, "b.xml": series.filter("count > 0")}).collect()
    documents = {r["file"]: json.loads(r["document"]) for r in rows}
    assert [(e["minute"] - first_minute(), e["threads"], e["mean"], e["error"]) for e in documents["a.xml"]] == [
        (0, 4, 10.0, "0"), (5, 4, 20.0, "0"), (10, 4, None, "1"),
    ]
    assert len(documents["b.xml"]) == 2


def test_speedup_lines(spark):
    runs = spark.createDataFrame(
        [("q1", "a", 10), ("q1", "a", 11), ("q1", "b", 3), ("q2", "a", 7), ("q2", "b", 0)],
        "query string, engine string, seconds long",
    )
    got = {r["query"]: tuple(r)[1:] for r in reports.speedup_report(runs, "a", "b").collect()}
    assert got == {"q1": (10, 3, 3.33), "q2": (7, 0, None), "Total": (17, 3, 5.66)}


def test_merged_states_equal_statistics_of_samples(spark):
    """Also for states without a timed call, and values far from zero."""
    calls = [(1, "get", at % 50, 1e9 + at * 0.5, at % 7 == 0) for at in range(200)] + [(1, "list", 3, 5.0, True)]
    df = samples(spark, *calls)
    path = scratch_path(spark, "states")
    for part in range(4):
        timing_states.append_states(df.filter(F.pmod(F.hash("elapsed_ms"), F.lit(4)) == part), path)
    for deviation in (False, True):
        want = {(r.minute, r.tag): r for r in intervals.interval_stats(df, 30, deviation).collect()}
        merged = timing_states.merge_states(spark.read.parquet(path), 30)
        got = timing_states.stats_of(merged, deviation).collect()
        assert len(got) == len(want) == 3
        for r in got:
            same = want[r.minute, r.tag]
            assert (r["count"], r["min"], r["max"], r.errors) == (same["count"], same["min"], same["max"], same.errors)
            for found, exact, digits in ((r.mean, same.mean, 1e-12), (r.stddev, same.stddev, 1e-6)):
                assert found == (None if exact is None else pytest.approx(exact, rel=digits))


def test_merging_states_shuffles_once(spark, plan):
    states = timing_states.timing_states(samples(spark, (1, "get", 0, 1.0, False)))
    path = scratch_path(spark, "states")
    states.write.parquet(path)
    assert plan(timing_states.merge_states(spark.read.parquet(path), 60)).count("Exchange") == 1


JOINING = SAMPLE + ", joins boolean"


def joining(spark, *calls):
    rows = [(m, t, None if at is None else START + timedelta(minutes=at), ms, bad, j) for m, t, at, ms, bad, j in calls]
    return spark.createDataFrame(rows, JOINING)


def test_load_stream_repeats_a_batch_without_a_trace(spark):
    """A batch that runs twice, late rows, an empty batch, rows without a start, a null client."""
    stream = LoadStream(spark, scratch_path(spark, "load"), 5, 5)
    first = joining(spark, (1, "get", 0, 1.0, False, True), (1, "get", 12, 3.0, False, True), (None, "get", 1, 2.0, True, False))
    second = joining(spark, (1, "get", 2, 9.0, False, True), (1, "get", 21, 5.0, False, False), (1, "get", None, 5.0, False, True))
    for batch, rows in [(0, first), (0, first), (1, first.limit(0)), (2, second), (2, second)]:
        stream.advance(rows, batch)
    books = [tuple(r)[:5] for r in stream.ledger().orderBy("batch").collect()]
    assert books == [(0, 3, 2, 0, 1), (1, 0, 0, 0, 1), (2, 2, 1, 1, 1)]
    assert sum(b[1] for b in books) == sum(b[2] + b[3] for b in books) + books[-1][4]
    base = first_minute()
    closed = {(r.mapper, r.minute - base): r.threads for r in stream.client_threads().collect()}
    assert closed == {(1, 0): 1, (None, 0): 0, (1, 10): 2}
    everything = {(r.mapper, r.minute - base): r.threads for r in stream.client_threads(True).collect()}
    assert everything == {**closed, (1, 20): 2}
    stats = {r.minute - base: (r["count"], r.mean, r.errors) for r in stream.statistics(True).collect()}
    assert stats == {0: (1, 1.0, 1), 10: (1, 3.0, 0), 20: (1, 5.0, 0)}


def test_load_stream_needs_the_state_before(spark):
    stream = LoadStream(spark, scratch_path(spark, "load"), 5, 5)
    with pytest.raises(RuntimeError, match="state of batch 0"):
        stream.advance(joining(spark, (1, "get", 0, 1.0, False, True)), 1)


def test_ledger_outlives_the_query(spark):
    """Two starts of one stream; each remembers two batches, the ledger all of them."""
    root, name = scratch_path(spark, "ledger"), "ledger-test"
    session = intervals.stream_session(spark, 1)
    session.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    times = [[0, 30], [1, 60], [90], [31, 95, 100]]
    for start in range(2):
        for part in times[start * 2 : start * 2 + 2]:
            rows = samples(spark, *[(1, "get", at, 1.0, False) for at in part])
            rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = session.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        books = ledger.BatchLedger(session, f"{root}/state", name)
        query = books.follow(
            lambda stream=stream: intervals.stream_interval_stats(stream, 5, f"{root}/out", f"{root}/state", "0 seconds", name)
        )
    stored = ledger.records(spark, f"{root}/state")
    assert stored.count() > 2 >= len(query.recentProgress)
    got = ledger.account(spark, spark.read.parquet(f"{root}/out"), f"{root}/state", f"{root}/state").first()
    assert (got.read, got.emitted + got.open + got.dropped, got.open) == (8, 8, 1)
    assert got.dropped == got.dropped_rows > 0
