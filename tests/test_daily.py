"""A day of alerts as one step, and model calls that fail."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.model_map import map_with_model
from tidemark.plans import event_processing as processing


def day_tables(spark):
    """Two stocks with calls on two days, a third without one today; links, pages, an earlier processed event."""
    calls = spark.createDataFrame(
        [("A", 1, dt.datetime(2024, 1, 4)), ("A", 2, dt.datetime(2024, 1, 5, 8)), ("A", 3, dt.datetime(2024, 1, 5, 9)), ("B", 4, dt.datetime(2024, 1, 5)), ("C", 5, dt.datetime(2024, 1, 4))],
        "stock_id string, call_id long, call_time timestamp",
    )
    rows = [(i, "ABC"[i % 3], {0: 3, 1: 4, 2: 5}[i % 3] if i < 30 else 1, "Acme", f"u{i % 5}", i == 6, i / 100, 0.5, 0.5) for i in range(36)]
    events = spark.createDataFrame(
        rows, "event_id long, stock_id string, call_id long, company string, top_articles string, irrelevant boolean, size_importance double, cohesiveness double, time_variance double"
    )
    processed = spark.createDataFrame([("p9", 9, "known", [0.0, 1.0])], "processed_id string, event_id long, summary string, summary_embedding array<double>")
    pages = spark.createDataFrame([(f"u{i}", f"<b>page {i}</b>") for i in range(5)], "url string, html string")
    interests = spark.createDataFrame(
        [(k, 7, k, "ABC"[k], f"stock {k}", k, "growth", [0.0, 1.0]) for k in range(3)],
        "interest_id int, user_id int, alert_stock_id int, stock_id string, stock string, area_id int, area string, interest_embedding array<double>",
    )
    return interests, calls, events, processed, pages


def test_only_todays_best_events_are_summarised(spark):
    interests, calls, events, processed, pages = day_tables(spark)
    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(sum("is a portion from" in t for t in texts))
        return [t[-30:] for t in texts]

    made = processing.daily_alerts(
        interests, calls, events, processed, pages, dt.date(2024, 1, 5), model, lambda ts: [[0.0, 1.0] for _ in ts], [1.0, 0.0], n=4
    )
    # The four best of today's last call of A and of B; 6 is flagged, 9 is known.
    best = {27, 24, 21, 18} | {28, 25, 22, 19}
    assert {r["event_id"] for r in made.processed.collect()} == best | {9}
    assert {r["stock_id"] for r in made.missing.collect()} == {"C"}
    analyses = {r["stock_id"]: r["analysis"] for r in made.analyses.collect()}
    assert set(analyses) == {"A", "B"}
    # A page is asked for once a company, however many events link it.
    assert asked.value == len({i % 5 for i in best})
    assert {r["event_id"] for r in made.flagged.collect()} == best


def test_another_day_has_other_calls(spark):
    interests, calls, events, processed, pages = day_tables(spark)
    made = processing.daily_alerts(
        interests, calls, events, processed, pages, dt.date(2024, 1, 4), None, lambda ts: [[0.0, 1.0] for _ in ts], [1.0, 0.0], n=4
    )
    assert {r["stock_id"] for r in made.missing.collect()} == {"B"}
    assert {r["event_id"] for r in made.processed.collect()} == {30, 33} | {29, 26, 23, 20} | {9}


def test_a_dead_service_is_not_waited_for_again(spark):
    """A batch fails with its waits once; halves are tried without waits, and good prompts get their answers."""
    calls = spark.sparkContext.accumulator(0)

    def moody(texts):
        calls.add(1)
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 37 else f"p{i}") for i in range(64)], "id int, p string").coalesce(1)
    got = {r["id"]: r["out"] for r in map_with_model(df, "p", "out", moody, waits=(0, 0)).collect()}
    assert got == {i: None if i == 37 else f"P{i}" for i in range(64)}
    # Three attempts of the whole batch, then two halves at each of six levels.
    assert calls.value == 3 + 2 * 6


def test_calls_are_bounded_by_default(spark):
    df = spark.range(0, 100, 1, 20).select(F.col("id").cast("string").alias("p"))
    assert map_with_model(df, "p", "out", lambda ts: ts).rdd.getNumPartitions() == 5
    assert map_with_model(df, "p", "out", lambda ts: ts, concurrency=None).rdd.getNumPartitions() == 20
