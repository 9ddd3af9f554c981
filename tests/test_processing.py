"""Model calls, event processing, digests and streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import chunking, digests, ordering, prompts, retrieval, vectors
from tidemark.operators.model_map import map_with_model
from tidemark.plans import event_processing as processing
from tidemark.plans import filings_qa
from tidemark.streaming import incremental, rate_limit


def test_failing_model_gives_null(spark):
    def moody(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, p string")
    got = map_with_model(df, "p", "out", moody, waits=(0, 0), batch_size=1).collect()
    assert {r["id"]: r["out"] for r in got} == {1: "A", 2: None, 3: None}


def test_one_bad_prompt_costs_one_answer(spark):
    def moody(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 4 else f"p{i}") for i in range(10)], "id int, p string").coalesce(1)
    got = {r["id"]: r["out"] for r in map_with_model(df, "p", "out", moody, waits=(0, 0)).collect()}
    assert got == {i: None if i == 4 else f"P{i}" for i in range(10)}


def test_missing_answers_are_an_error(spark):
    df = spark.createDataFrame([(i, "p") for i in range(10)], "id int, p string").coalesce(1)
    with pytest.raises(Exception, match="3 answers to 10 prompts"):
        map_with_model(df, "p", "out", lambda texts: texts[:3], waits=(0, 0)).collect()


def test_model_is_retried(spark, tmp_path):
    mark = str(tmp_path / "seen")

    def second_time(texts):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("first call fails")
        return texts

    df = spark.createDataFrame([("a",)], "p string").coalesce(1)
    assert map_with_model(df, "p", "out", second_time, waits=(0,), concurrency=1).first()["out"] == "a"


def test_one_missing_vector_changes_all(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "b")], "id int, text string")

    def first(texts):
        return [[1.0] if len(t) > 1 else None for t in texts]

    def second(texts):
        return [[2.0] for _ in texts]

    got = vectors.embed_with_fallback(df, "text", first, second, waits=(0,)).collect()
    assert [r["embedding"] for r in got] == [[2.0], [2.0]]
    kept = vectors.embed_with_fallback(df.where("id = 1"), "text", first, second).collect()
    assert [r["embedding"] for r in kept] == [[1.0]]


def test_default_vector(spark):
    df = spark.createDataFrame([(1, "Alpha beta alpha"), (2, "!"), (3, None), (4, "ALPHA, beta; alpha")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in vectors.embed(df, "text", dim=32).collect()}
    assert sum(v * v for v in got[1]) == pytest.approx(1.0) and got[1] == got[4]
    assert set(got[2]) == {0.0} and got[3] is None
    assert vectors.text_vector(spark, "alpha BETA alpha", 32) == got[1]


def test_irrelevant_anchor(spark):
    df = spark.createDataFrame([(1, "Irrelevant Article"), (2, "profit rises at the plant")], "id int, text string")
    embedded = vectors.embed(df, "text", out="summary_embedding")
    flagged = vectors.flag_irrelevant(embedded)
    assert {r["id"]: r["irrelevant"] for r in flagged.collect()} == {1: True, 2: False}


def test_pages_are_reduced_within_the_token_limit(spark):
    words = " ".join(f"w{i}" for i in range(40))
    events = spark.createDataFrame([(1, "Acme", "u1,missing")], "event_id int, company string, top_articles string")
    pages = spark.createDataFrame([("u1", f"<p>{words}</p>")], "url string, html string")
    sizes = spark.sparkContext.accumulator(0)

    def shorten(texts):
        sizes.add(len(texts))
        return ["s" + str(len(t)) for t in texts]

    got = processing.summarize_articles(events, pages, shorten, chunk_size=4, reduce_limit=3).collect()
    assert len(got) == 1 and got[0]["summary"].startswith("s")
    # 10 parts, then groups of 3, then groups again, then the event.
    assert sizes.value >= 10 + 4 + 2 + 1


def test_model_that_does_not_shorten_is_refused(spark):
    pieces = spark.createDataFrame([("u", "Acme", i, "a b c d") for i in range(3)], "url string, company string, position int, text string")
    with pytest.raises(ValueError, match="shorten"):
        processing.reduce_texts(pieces, ["url"], "{company} {docs}", lambda texts: texts, 2)


def event_tables(spark):
    events = spark.createDataFrame([(1, 3, False), (2, 1, False), (3, 2, True), (4, 4, None)], "event_id int, rank int, irrelevant boolean")
    processed = spark.createDataFrame([("p1", 1, "old", [1.0, 0.0])], "processed_id string, event_id int, summary string, summary_embedding array<double>")
    summaries = spark.createDataFrame([(2, "new", [0.0, 1.0]), (3, "flagged", [1.0, 0.0]), (4, "off", [1.0, 0.0])], "event_id int, summary string, summary_embedding array<double>")
    return events, processed, summaries


def test_process_events(spark):
    everything, flagged, ordered = processing.process_events(*event_tables(spark), anchor=[1.0, 0.0])
    assert {(r["event_id"], r["summary"]) for r in everything.collect()} == {(1, "old"), (2, "new")}
    assert {r["event_id"]: r["irrelevant"] for r in flagged.collect()} == {1: False, 2: False, 3: True, 4: True}
    assert [r["summary"] for r in ordered.orderBy("rank").collect()] == ["new", "old"]


def test_whole_step_only_asks_for_new_events(spark):
    events, processed, _ = event_tables(spark)
    linked = events.withColumn("company", F.lit("Acme")).withColumn("top_articles", F.concat(F.lit("u"), "event_id"))
    pages = spark.createDataFrame([(f"u{i}", f"<b>text {i}</b>") for i in range(1, 5)], "url string, html string")
    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(sum("is a portion from" in t for t in texts))
        return [t[-20:] for t in texts]

    everything, _, _ = processing.summarize_and_process(linked, processed, pages, model, lambda ts: [[0.0, 1.0] for _ in ts], [1.0, 0.0])
    assert {r["event_id"] for r in everything.collect()} == {1, 2, 4}
    assert asked.value == 2


def test_long_texts_come_in_parts(spark):
    df = spark.range(10).selectExpr("'k' AS k", "id AS pos", "CAST(id AS STRING) AS t")
    parts = ordering.concat_in_order(df, ["k"], "pos", F.col("t"), "text", part_size=4).orderBy("part").collect()
    assert [r["text"] for r in parts] == ["0123", "4567", "89"]


def test_parts_are_joined_again(spark):
    df = spark.range(25).selectExpr("'k' AS k", "id AS pos", "CAST(id % 10 AS STRING) AS t")
    parts = ordering.concat_in_order(df, ["k"], "pos", F.col("t"), "text", "-", part_size=2)
    assert [r["text"] for r in ordering.join_parts(parts, ["k"], "text", "-").collect()] == ["-".join(str(i % 10) for i in range(25))]


def test_an_event_with_many_links_is_one_row(spark):
    links = ",".join(f"u{i}" for i in range(1500))
    events = spark.createDataFrame([(1, "Acme", links)], "event_id long, company string, top_articles string")
    pages = spark.createDataFrame([("u7", "<b>seven</b>")], "url string, html string")
    got = processing.summarize_articles(events, pages).collect()
    assert len(got) == 1 and got[0]["summary"].count(processing.UNREADABLE) == 1499


def test_greeting_comes_first_wherever_turns_start(spark):
    rows = [(1, 1000 + k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(4)] + [(1, 999, "system", "rules")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    text = "".join(r["transcript"] for r in sorted(digests.chat_transcript(df).collect(), key=lambda r: r["part"]))
    assert text.startswith("Human: ") and text.endswith("Human: t0\nAI Assistant: t1\nHuman: t2\nAI Assistant: t3") and "rules" not in text
    assert "rules" in digests.chat_transcript(df, other_roles=("assistant", "system")).orderBy("part").first()["transcript"]


def test_positions_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_ROWS", 50)
    df = spark.range(1000).selectExpr("CASE WHEN id < 700 THEN 'hot' ELSE CAST(id AS STRING) END AS k", "(id * 37) % 701 AS o", "id AS tie")
    got = ordering.ordered_positions(df, ["k"], "o", ["tie"]).where("k = 'hot'").collect()
    expected = sorted((r["o"], r["tie"]) for r in got)
    assert [(r["o"], r["tie"]) for r in sorted(got, key=lambda r: r["position"])] == expected
    assert sorted(r["position"] for r in got) == list(range(700))


def test_alert_digest_layout(spark):
    rows = [(1, 10, "Acme", 5, "A5"), (1, 10, "Acme", 2, "A2"), (1, 11, "Bolt", None, None), (2, 12, "Core", 7, "C7")]
    df = spark.createDataFrame(rows, "user_id long, alert_stock_id long, stock string, area_id long, analysis string")
    got = {r["user_id"]: r["digest"] for r in digests.alert_digest(df).collect()}
    assert got == {1: "Acme\nA2\nA5\n\nBolt\n", 2: "Core\nC7\n"}


def test_missing_argument_is_quarantined(spark):
    df = spark.createDataFrame([("Acme", "supply", "news"), ("Acme", None, "news")], "company string, context string, events string")
    ready, missing = prompts.analysis_prompts(df, "alert", company="company", context="context", events="events")
    assert ready.count() == 1 and missing.count() == 1
    assert ready.first()["prompt"].endswith("Analysis:\n") and "{" not in ready.first()["prompt"]


def test_filing_is_indexed_once_and_answered(spark):
    filings = spark.createDataFrame(
        [("A1", "ACME", "10-K", dt.datetime(2024, 1, 1), "annual"), ("A2", "ACME", "10-K", dt.datetime(2023, 1, 1), "older"), ("B1", "BOLT", "10-K", dt.datetime(2024, 1, 1), "annual")],
        "accessionNo string, ticker string, formType string, filedAt timestamp, description string",
    )
    sections = spark.createDataFrame([(a, s, f"{a} text about supply and growth {s}") for a in ("A1", "A2", "B1") for s in ("1", "7")], "accessionNo string, filing_section string, text string")
    known = retrieval.index_sections(filings_qa.sections_of_latest(filings.where("ticker = 'BOLT'"), sections))
    companies = spark.createDataFrame([("ACME",), ("BOLT",)], "ticker string")
    chunks = filings_qa.extend_index(companies, known, filings, sections).cache()
    assert {(r["ticker"], r["filing_section"]) for r in chunks.collect()} == {(t, s) for t in ("ACME", "BOLT") for s in ("1", "7")}
    assert not chunks.where(F.col("content").contains("A2")).count()
    answers = filings_qa.answer_bank(companies, chunks, model=lambda ts: [t[:30] for t in ts], entities=True)
    filed = filings_qa.processed_filings(answers).collect()
    assert {r["ticker"] for r in filed} == {"ACME", "BOLT"}
    assert all(len(r["processed_data"]) == 2 and all(v["result"] for v in r["processed_data"].values()) for r in filed)


def test_stream_of_requests_equals_batch(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    log.repartition(4).write.parquet(str(tmp_path / "log"))
    arrivals = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    counted = rate_limit.rate_limit_stream(arrivals, "1 day", 1, lateness="60 days")
    job = counted.writeStream.format("memory").queryName("over_limit").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination(120)
    batch = rate_limit.over_limit(log, "1 day", 1)
    key = ("user_id", "window_start", "per", "requests")
    assert sorted(spark.table("over_limit").select(*key).collect()) == sorted(batch.select(*key).collect())
    assert batch.count() > 0


def test_incremental_events_are_processed_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = T.StructType.fromDDL("event_id long, irrelevant boolean, text string")
    rows = [[(1, False, "a"), (2, True, "b")], [(1, False, "a"), (3, None, "c")], [(3, False, "c"), (4, False, "d")]]

    def process(events):
        return events.select("event_id", F.upper("text").alias("summary"))

    def run():
        arrivals = incremental.read_arrivals(spark, source, schema, 1)
        job = incremental.incremental_events(arrivals, process, out, mark).trigger(availableNow=True).start()
        job.awaitTermination(120)
        assert job.exception() is None

    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        run()
    run()
    got = sorted((r["event_id"], r["summary"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "A"), (3, "C"), (4, "D")]


def test_a_new_run_keeps_what_earlier_runs_wrote(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = T.StructType.fromDDL("event_id long, irrelevant boolean, text string")
    for run, ids in (("one", range(5)), ("two", range(3, 8))):
        source = str(tmp_path / run)
        spark.createDataFrame([(i, False, run) for i in ids], schema).coalesce(1).write.parquet(source)
        for _ in range(2):
            arrivals = incremental.read_arrivals(spark, source, schema, 1)
            job = incremental.incremental_events(arrivals, lambda e: e.select("event_id", "text"), out, f"{source}-marks")
            job = job.trigger(availableNow=True).start()
            job.awaitTermination(120)
            assert job.exception() is None
    got = sorted((r["event_id"], r["text"]) for r in spark.read.parquet(out).collect())
    assert got == [(i, "one") for i in range(5)] + [(i, "two") for i in range(5, 8)]


def test_ids_of_other_runs_are_read_by_bucket(spark, tmp_path):
    """Repeats inside a run are dropped by the stream's state; another run reads the index, not the table."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = T.StructType.fromDDL("event_id long, irrelevant boolean, text string")

    def run(mark, seen):
        def process(new):
            seen.append(sorted(r["event_id"] for r in new.collect()))
            return new.select("event_id", "text")

        arrivals = incremental.read_arrivals(spark, source, schema)
        job = incremental.incremental_events(arrivals, process, out, str(tmp_path / mark)).trigger(availableNow=True).start()
        job.awaitTermination(120)
        assert job.exception() is None

    seen: list = []
    for ids in ([1, 2, 2, 3], [3, 4], [4, 5, 1]):
        spark.createDataFrame([(i, i == 2, "x") for i in ids], schema).write.mode("append").parquet(source)
        run("one", seen)
    assert seen == [[1, 3], [4], [5]]
    spark.createDataFrame([(9, None, "y"), (2, False, "now wanted")], schema).write.mode("append").parquet(source)
    seen.clear()
    run("two", seen)
    assert seen == [[2, 9]]
    keys = spark.read.parquet(f"{out}/_keys")
    assert sorted(r["event_id"] for r in keys.collect()) == [1, 2, 3, 4, 5, 9]
    assert set(keys.columns) == {"event_id", "run", "batch", "_bucket"}
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5, 9]


def test_a_table_without_an_index_is_indexed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = T.StructType.fromDDL("event_id long, irrelevant boolean")
    spark.createDataFrame([(i,) for i in range(5)], "event_id long").write.parquet(f"{out}/batch=old-0")
    spark.createDataFrame([(i, False) for i in range(8)], schema).write.parquet(source)
    arrivals = incremental.read_arrivals(spark, source, schema)
    job = incremental.incremental_events(arrivals, lambda e: e.select("event_id"), out, str(tmp_path / "m")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_a_page_of_many_parts_is_reduced_in_runs(spark, monkeypatch):
    """Runs of four positions: every level groups inside runs, order is kept, and small keys are as without runs."""
    pieces = spark.createDataFrame(
        [("big", "Acme", i, f"p{i:03}") for i in range(150)] + [("small", "Acme", i, f"s{i}") for i in range(3)], "url string, company string, position long, text string"
    )

    def initials(texts):
        # The answer keeps the first and the last word, so the order of all parts can be seen.
        return [f"{t.split()[0].split('-')[0]}-{t.split()[-1].split('-')[-1]}" for t in texts]

    want = {(r["url"], r["summary"]) for r in processing.reduce_texts(pieces, ["url"], "{docs}", initials, 4).collect()}
    assert want == {("big", "p000-p149"), ("small", "s0-s2")}
    monkeypatch.setattr(processing, "REDUCE_ROWS", 4)
    got = processing.reduce_texts(pieces, ["url"], "{docs}", initials, 4)
    assert {(r["url"], r["summary"]) for r in got.collect()} == want


def test_close_values_of_a_hot_key_use_several_slices(spark, monkeypatch):
    """Nearly all values lie together: equal widths would put them in one slice, quantiles don't."""
    monkeypatch.setattr(ordering, "SLICE_ROWS", 100)
    df = spark.range(4000).selectExpr(
        "IF(id < 3000, 'hot', IF(id < 3500, 'flat', CAST(id % 90 AS STRING))) AS k",
        "IF(id < 3000, IF(id = 0, 1000000000, id % 50), IF(id < 3500, 7, id % 5)) AS o", "(id * 37) % 4001 AS tie",
    )
    got = ordering.ordered_positions(df, ["k"], "o", ["tie"])
    assert got.columns == ["k", "o", "tie", "position"]
    rows = got.collect()
    for key in ("hot", "flat", "5"):
        mine = sorted((r["o"], r["tie"], r["position"]) for r in rows if r["k"] == key)
        assert [p for _, _, p in mine] == list(range(len(mine)))
    text = got._jdf.queryExecution().executedPlan().toString()
    window = [x for x in text.splitlines() if "row_number() windowspecdefinition" in x][0]
    assert "_slice" in window


def test_slices_are_about_equal(spark):
    """Cuts at quantiles: binary search numbers the slice of every row as counting does."""
    rows = spark.range(300).selectExpr("IF(id < 200, array(3L, 5L, 5L, 90L), CAST(NULL AS ARRAY<BIGINT>)) AS c", "id AS p")
    for r in rows.select("c", "p", ordering._cuts_below("c", "p").alias("n")).collect():
        assert r["n"] == sum(x <= r["p"] for x in r["c"] or [])


def test_tfidf_of_a_run_and_of_hot_terms(spark, monkeypatch):
    """Hot and rare terms weigh alike whichever way they are joined; a run counts its own rows."""
    rows = [(i, i % 2, ";".join(f"name{j},{j}" for j in range(i % 4 + 1)) + (";every,1" if i % 3 else "")) for i in range(40)]
    df = spark.createDataFrame(rows, "article_id long, call_id int, V2Persons string")

    def weights(frame, **options):
        found = vectors.tfidf(frame, {"persons": "V2Persons"}, **options)
        return {(r["article_id"], r["term"]): r["weight"] for r in found.collect()}

    plain = weights(df)
    for share in (1, 10**6):
        monkeypatch.setattr(vectors, "HOT_SHARE", share)
        assert weights(df) == pytest.approx(plain)
    together = weights(df, run=["call_id"])
    for call in (0, 1):
        alone = weights(df.where(F.col("call_id") == call))
        assert {k: v for k, v in together.items() if k[0] % 2 == call} == pytest.approx(alone)
    assert together != pytest.approx(plain)


def test_tfidf_in_slots_is_its_long_form_added_up(spark, monkeypatch):
    """Hot terms inside the row or all terms joined; repeated and NULL ids and runs, rows without terms."""
    rows = [(i // 2 if i < 10 else i, i % 2, ";".join(f"name{j},{j}" for j in range(i % 4 + 1)) + (";every,1" if i % 3 else ""), "1#some place#" if i % 5 else None) for i in range(40)]
    rows += [(None, 1, "name1,1", None), (50, None, "name1,1", None), (51, 1, None, None)]
    df = spark.createDataFrame(rows, "article_id long, call_id int, V2Persons string, V2Locations string")
    columns = {"persons": "V2Persons", "locations": "V2Locations"}
    for run in ([], ["call_id"]):
        expected: dict = {}
        for r in vectors.tfidf(df, columns, run=run).withColumn("slot", F.pmod(F.xxhash64("kind", "term"), F.lit(8))).collect():
            expected.setdefault(tuple(r[c] for c in [*run, "article_id"]), [0.0] * 8)[r["slot"]] += r["weight"]
        for hot in (100_000, 2, 0):
            monkeypatch.setattr(vectors, "HOT_TERMS", hot)
            found = vectors.tfidf(df, columns, run=run, slots=8).select(*run, "article_id", vectors.slot_vectors("parts", 8).alias("v")).collect()
            assert {tuple(r[c] for c in [*run, "article_id"]): r["v"] for r in found} == {k: pytest.approx(v) for k, v in expected.items()}
            assert len(found) == len(expected)


def test_wide_rows_reach_python_in_small_batches(spark):
    """Executor memory: packs and blocks of vectors go to the workers a few megabytes at a time; a distance matrix is small."""
    from tidemark.session import tune

    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"mb": [batch.nbytes / 1e6]})

    wide = tune(spark).range(0, 300, 1, 1).select(F.array_repeat(F.col("id").cast("double"), 20_000).alias("v"))
    assert max(r["mb"] for r in wide.mapInArrow(sizes, "mb double").collect()) < 10
    assert all((s.stop - s.start) * 12_000 <= 500_000 for s in vectors._slices(5_000, 12_000))


def _alert_rows(spark):
    """Interests with a shared id, without id, vector or stock; events with ties, without summary or vector."""
    vec = "array<double>"
    interests = spark.createDataFrame(
        [(i, 1, 10, "A" if i < 7 else "B", "x", i, f"area {i}", [float(i), 1.0]) for i in range(1, 10)]
        + [(3, 1, 10, "A", "x", 3, "again", [0.0, 1.0]), (None, 1, 10, "A", "x", 12, "none", [1.0, 1.0])]
        + [(13, 1, 10, "A", "x", 13, "bare", None), (14, 1, 10, None, "x", 14, "lost", [1.0, 1.0]), (15, 1, 10, "C", "x", 15, "new", [1.0, 1.0])],
        f"interest_id long, user_id long, alert_stock_id long, stock_id string, stock string, area_id long, area string, interest_embedding {vec}",
    )
    ready = spark.createDataFrame(
        [(5, "A", "five", [1.0, 0.0]), (4, "A", "four", [2.0, 0.0]), (6, "A", None, [0.5, 1.0]), (7, "A", "seven", None), (8, "B", "eight", [0.0, 1.0]), (9, "A", "nine", [0.0, 3.0])],
        f"event_id long, stock_id string, summary string, summary_embedding {vec}",
    )
    return interests, ready


def test_alert_digests_in_place_are_those_of_the_join(spark):
    interests, ready = _alert_rows(spark)
    columns = ["area_id", "analysis"]
    got = processing._analyses(interests, ready, None, 3).select(*columns).collect()
    told = processing._told_by_join(interests, ready, 3)
    wanted = prompts.analysis_prompts(told, "relevance", company="stock", context="area", events="events")[0].select("area_id", "prompt").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and len(got) == 14
    # Event ids that repeat are left to the join.
    twice = ready.unionByName(ready)
    got = processing._analyses(interests, twice, None, 3).select("area_id", "analysis").collect()
    told = processing._told_by_join(interests, twice, 3)
    wanted = prompts.analysis_prompts(told, "relevance", company="stock", context="area", events="events")[0].select("area_id", "prompt").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted))


def test_neighbours_of_alerts_are_not_shuffled(spark):
    interests, ready = _alert_rows(spark)
    single = interests.where("interest_id <> 3")
    plan = processing._analyses(single, ready, None, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(interest_id" not in plan and "hashpartitioning(query_id" not in plan


def test_alert_mails_at_once_are_those_in_slices(spark):
    rows = [(u, s, f"S{s}", a, f"text {u} {s} {a}") for u in (1, 2, 3) for s in (4, 2) for a in (9, 5, 5)]
    # A null area and analysis, an analysis twice, a stock that is not listed, two names of one entry, null keys.
    rows += [(1, 2, "S2", None, "first"), (1, 2, "S2", 7, None), (1, 2, "S2", 5, "text 1 2 5"), (1, 8, "S8", 1, "unlisted"), (2, 4, "T4", 5, "other"), (None, 4, "S4", 1, "x"), (4, None, "S1", 1, "y")]
    rows += [(5, 1, "S1", i, f"long {i}") for i in range(ordering.PART_SIZE + 5)]
    analyses = spark.createDataFrame(rows, "user_id long, alert_stock_id long, stock string, area_id long, analysis string")
    listed = analyses.where("alert_stock_id <> 8 OR alert_stock_id IS NULL").select("user_id", "alert_stock_id", "stock").distinct()
    listed = listed.unionByName(spark.createDataFrame([(1, 9, "S9"), (6, 1, "S1"), (3, 4, "S4")], listed.schema))
    keys = ["user_id", "alert_stock_id", "stock"]
    wanted = digests._digest_by_slices(listed.join(analyses, keys, "left"), "user_id").collect()
    got = processing.alert_mails(analyses, listed).collect()
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    plain = digests._digest_at_once(analyses.where("user_id = 1 AND alert_stock_id <> 8"), listed.where("user_id = 1"), "user_id").collect()
    assert [r for r in wanted if r["user_id"] == 1] == plain


def test_pieces_are_packed_greedily(spark):
    texts = ["", "a b c d e f", "aaaa " * 7, "x" * 25, "ab\n\ncd ef\ngh " + "y" * 11 + " z", "\n\n\n\n", "é" * 9 + " b", " lead", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got: dict = {}
    for r in chunking.chunk_text(df, "text", 10).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["content"])
    assert {i: "".join(c) for i, c in got.items()} == {i: t for i, t in enumerate(texts) if t}
    assert all(0 < len(c) <= 10 for cs in got.values() for c in cs)
    assert got[1] == ["a b c d e ", "f"] and got[2] == ["aaaa aaaa "] * 3 + ["aaaa "] and got[3] == ["x" * 10, "x" * 10, "x" * 5]


def test_listed_stocks_of_mails_are_derived_once(spark):
    """What the stocks are derived by is neither run nor shuffled a second time."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "user_id long, alert_stock_id long, stock string"
    listed = spark.createDataFrame([(1, 10, "A"), (1, 11, "B"), (2, 12, "A")], schema).mapInArrow(counted, schema)
    analyses = spark.createDataFrame([(1, 11, "B", 5, "text")], schema + ", area_id long, analysis string")
    mails = {r["user_id"]: r["digest"] for r in digests.alert_digest(analyses, listed=listed).collect()}
    assert mails == {1: "A\n\nB\ntext\n", 2: "A\n"}
    assert seen.value == 3
