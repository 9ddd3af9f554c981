"""Round trips of sources and sinks, statements, graph and portfolio rules."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, graph, joins, maintenance, statements, windows
from tidemark.plans import news_events
from tidemark.sources import articles, events, filings


def test_articles_are_pruned_by_day(spark, tmp_path):
    path = str(tmp_path / "articles")
    rows = spark.range(40).select(
        *[F.lit("x").alias(c) for c in articles.ARTICLE_COLUMNS if c not in ("V2Organizations", "DATE")],
        F.col("id").cast("string").alias("DATE"),
        F.when(F.col("id") % 2 == 0, F.lit("Acme Inc,5;B,9")).otherwise("Other,1").alias("V2Organizations"),
        F.date_sub(F.lit(dt.date(2024, 1, 31)), F.col("id").cast("int")).alias("partition_date"),
    )
    rows.write.partitionBy("partition_date").parquet(path)
    found = articles.read_articles(spark, path, "acme", 7, dt.datetime(2024, 1, 31))
    assert sorted(int(r["DATE"]) for r in found.collect()) == [0, 2, 4, 6]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_date" in plan
    assert list(articles.ARTICLE_COLUMNS) == sorted(found.columns, key=list(articles.ARTICLE_COLUMNS).index)

    sink = str(tmp_path / "entries")
    for call in (1, 2):
        articles.append_entries(found, call, sink, dt.date(2024, 1, call))
    kept = spark.read.parquet(sink)
    assert kept.count() == 8 and {"call_id", "themes", "call_date"} <= set(kept.columns)


def test_call_and_events_are_written(spark, tmp_path):
    info = spark.createDataFrame(
        [(3, 0.5, 1.0, 0.2, ["u1", "u2"], [("A", 2)], [("P", 1)], [], [("L", 1)], [0.1], dt.datetime(2024, 1, 1))],
        "cluster int, size_importance double, cohesiveness double, time_variance double, top_articles array<string>, "
        "top_themes array<struct<name:string,mentions:long>>, top_persons array<struct<name:string,mentions:long>>, "
        "top_organizations array<struct<name:string,mentions:long>>, top_locations array<struct<name:string,mentions:long>>, "
        "mean_embedding array<double>, median_date timestamp",
    )
    call = events.call_row(spark, 9, 5, dt.datetime(2024, 1, 2), 7, 10, {"top_n": 10})
    events.write_events(info, call, str(tmp_path))
    row = spark.read.parquet(str(tmp_path / "events")).first()
    assert (row["event_id"], row["call_id"], row["top_articles"], row["top_themes"], row["top_orgs"]) == ("9-3", 9, "u1,u2", "A", "")
    assert row["cluster_health"] == [0.5, 1.0, 0.2] and row["irrelevant"] is False
    assert json.loads(spark.read.parquet(str(tmp_path / "calls")).first()["config"]) == {"top_n": 10}


def test_filings_with_absent_fields(spark, tmp_path):
    file = tmp_path / "f.json"
    file.write_text(
        json.dumps({"accessionNo": "A1", "ticker": "T", "formType": "10-K", "filedAt": "2024-02-01T10:00:00Z", "periodOfReport": "2023-12-31"})
        + "\n" + json.dumps({"accessionNo": "A2", "ticker": "T", "formType": "8-K", "filedAt": "bad", "linkToXbrl": "x"}) + "\n"
    )
    first, second = filings.read_filings(spark, str(file)).orderBy("accessionNo").collect()
    assert first["filedAt"] == dt.datetime(2024, 2, 1, 10) and first["periodOfReport"] == dt.date(2023, 12, 31)
    assert first["linkToXbrl"] is None and first["effectivenessDate"] is None
    assert second["filedAt"] is None and second["linkToXbrl"] == "x"


XBRL = {
    "StatementsOfIncome": {
        "Sales": [
            {"value": "10", "period": {"startDate": "2023-01-01", "endDate": "2023-12-31"}},
            {"value": "99", "period": {"startDate": "2023-01-01", "endDate": "2023-12-31"}},
            {"value": "7", "segment": {"dimension": "x"}, "period": {"startDate": "2022-01-01", "endDate": "2022-12-31"}},
        ],
        "OnlySegments": [{"value": "1", "segment": "s", "period": {"startDate": "2023-01-01", "endDate": "2023-12-31"}}],
        "Nil": [{"segment": None, "period": {"startDate": "2023-01-01", "endDate": "2023-12-31"}}],
        "Empty": [],
    },
    "BalanceSheets": {
        "Cash": [{"period": {"instant": "2023-12-31"}}, {"value": "5", "period": {"instant": "2023-12-31"}}],
        "Empty": [],
    },
    "StatementsOfCashFlows": {
        "Net": [
            {"value": "3", "period": {"startDate": "2023-01-01", "endDate": "2023-12-31"}},
            {"value": "4", "period": {"instant": "2023-12-31"}},
            {"period": {"instant": "2022-12-31"}},
        ]
    },
}


def test_statements_from_converter_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(XBRL, indent=1))
    facts = filings.read_xbrl(spark, str(tmp_path)).cache()
    year = "2023-01-01-2023-12-31"

    def table(df):
        return {(r["item"], r["period"], r["value"]) for r in df.collect()}

    assert table(statements.income_statement(facts)) == {("Sales", year, "10"), ("OnlySegments", None, None), ("Nil", year, None), ("Empty", None, None)}
    # The nil fact comes first and counts as 0; an item without facts gives no row.
    assert table(statements.balance_sheet(facts)) == {("Cash", "2023-12-31", "0")}
    assert table(statements.cash_flow(facts)) == {("Net", year, "3"), ("Net", "2023-12-31", "4"), ("Net", "2022-12-31", "0")}
    wide = {r["item"]: r[year] for r in statements.statement_table(statements.income_statement(facts), [year]).collect()}
    assert wide == {"Sales": "10", "OnlySegments": None, "Nil": None, "Empty": None}


def test_section_files(spark, tmp_path):
    (tmp_path / "section1A.txt").write_text("risk\nfactors")
    row = filings.read_sections(spark, str(tmp_path)).first()
    assert (row["filing_section"], row["text"]) == ("section1A", "risk\nfactors")


def test_graph_of_two_companies(spark):
    rows = [
        (0, "AAPL", {"Supplier1": "Provides chips", "Supplier2": "Provides screens"}),
        (1, "GOOGL", {"Supplier1": "Provides storage", "Partner1": "Collaboration in AI", "AAPL": "rival"}),
        (2, "LONE", {}),
    ]
    df = spark.createDataFrame(rows, "seq long, stock string, entities map<string,string>")
    nodes, edges = graph.build_graph(df)
    kinds = {r["node"]: r["type"] for r in nodes.collect()}
    # The later mention as an entity overwrites the stock mark.
    assert kinds == {"AAPL": "entity", "GOOGL": "stock", "LONE": "stock", "Supplier1": "entity", "Supplier2": "entity", "Partner1": "entity"}
    assert {(r["src"], r["dst"]): r["description"] for r in edges.collect()}[("AAPL", "GOOGL")] == "rival"
    degree = {r["node"]: r["centrality"] for r in graph.degree_centrality(nodes, edges).collect()}
    assert degree["AAPL"] == pytest.approx(3 / 5) and degree["LONE"] == 0.0


def test_position_rules(spark):
    schema = "portfolio_id long, stock_id long, shares int, purchase_price decimal(10,2)"
    held = spark.createDataFrame([], schema)
    bridge = held.select("portfolio_id", "stock_id")
    one = spark.sql("SELECT 1L AS portfolio_id, 2L AS stock_id, 10 AS shares, CAST(100.00 AS DECIMAL(10,2)) AS purchase_price, 1L AS row_no")
    held, bridge, rejected = maintenance.add_positions(held, bridge, one, "row_no")
    assert [tuple(r) for r in held.collect()] == [(1, 2, 10, __import__("decimal").Decimal("100.00"))]
    assert bridge.count() == 1 and rejected.count() == 0
    held, bridge, rejected = maintenance.add_positions(held, bridge, one, "row_no")
    assert held.count() == 1 and bridge.count() == 1 and rejected.count() == 1
    assert audits.duplicate_positions(held).count() == 0
    assert audits.duplicate_positions(held.unionByName(held)).first()["n"] == 2


def test_areas_rule(spark):
    areas = spark.range(13).selectExpr("id % 2 AS alert_stock_id", "CAST(id AS STRING) AS description")
    assert sorted(r["alert_stock_id"] for r in audits.too_many_areas(areas).collect()) == [0, 1]
    assert audits.too_many_areas(areas, 7).count() == 0


def test_insert_if_absent_keeps_one_per_key(spark):
    known = spark.createDataFrame([("A", 1)], "k string, v int")
    new = spark.createDataFrame([("A", 9), ("B", 3), ("B", 2)], "k string, v int")
    assert sorted(map(tuple, joins.insert_if_absent(known, new, "k", "v").collect())) == [("A", 1), ("B", 2)]


def test_null_health_ranks_first(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.5), (2, 1, 1.0, 1.0, None), (3, 1, 0.9, 0.5, 0.5)],
                               "event_id int, call_id int, size_importance double, cohesiveness double, time_variance double")
    assert [r["event_id"] for r in windows.top_events(df, 2).orderBy("rank").collect()] == [2, 3]


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    rows = spark.range(6).select(
        *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in articles.ARTICLE_COLUMNS],
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 3).cast("int")).alias("partition_date"),
    )
    sink = str(tmp_path / "entries")
    for call, day, n in ((1, 1, 6), (2, 1, 4), (1, 1, 5), (3, 2, 6)):
        articles.append_entries(rows.limit(n), call, sink, dt.date(2024, 1, day))
    counts = {r["call_id"]: r["count"] for r in articles.read_entries(spark, sink).groupBy("call_id").count().collect()}
    assert counts == {1: 5, 2: 4, 3: 6}
    assert articles.read_entries(spark, sink, 2).columns == ["call_id", *articles.ARTICLE_COLUMNS.values(), "call_date"]

    table = str(tmp_path / "articles")
    articles.write_articles(rows, table)
    articles.write_articles(rows.where("partition_date = '2024-01-02'").limit(1), table)
    days = {str(r["partition_date"]): r["count"] for r in spark.read.parquet(table).groupBy("partition_date").count().collect()}
    assert days == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 2}


def company_articles(spark):
    """Articles of two companies over forty days, some with dates that can't be read."""
    stories = ["plant fire", "merger talks"]
    rows = []
    for i in range(120):
        day = dt.date(2024, 1, 31) - dt.timedelta(days=i % 40)
        story = stories[i // 2 % 2]
        date = "not a date" if i % 10 == 0 else day.strftime("%Y%m%d") + "120000"
        rows.append((i, date, day, f"{'Acme' if i % 2 else 'Other'} Inc,1", f"{story} boss,3", f"{story.upper()},2", "1#Europe#Spain#", "t", "n", "a", f"u{i}"))
    return spark.createDataFrame(
        rows, "article_id long, DATE string, partition_date date, V2Organizations string, V2Persons string, V2Themes string, V2Locations string, "
        "V2Tone string, AllNames string, Amounts string, DocumentIdentifier string",
    )


def test_company_run_from_articles_to_events(spark, tmp_path):
    rows = company_articles(spark)
    table, store = str(tmp_path / "articles"), str(tmp_path / "store")
    articles.write_articles(rows, table)
    config = news_events.EventConfig(interval=20, eps=0.2)
    as_of = dt.datetime(2024, 1, 31)
    for _ in range(2):
        found, bad = news_events.company_run(spark, table, store, "acme", 7, 3, as_of, config)
    wanted = rows.where("partition_date >= DATE'2024-01-11' AND V2Organizations LIKE 'Acme%'")
    unreadable = wanted.where("DATE = 'not a date'")
    assert sorted(r["article_id"] for r in bad.collect()) == sorted(r["article_id"] for r in unreadable.collect())
    alone = news_events.news_events(wanted.where("DATE <> 'not a date'"), config)
    assert {(r["cluster_id"], r["top_articles"]) for r in found.collect()} == {(r["cluster"], ",".join(r["top_articles"])) for r in alone.collect()}
    assert found.count() > 0 and found.where("event_window <> 20 OR stock_id <> 3 OR call_id <> 7").count() == 0
    assert events.read_calls(spark, store).count() == 1
    # A shorter interval reads fewer days; a call without bad dates has none in quarantine.
    news_events.company_run(spark, table, store, "acme", 8, 3, dt.datetime(2024, 1, 31), news_events.EventConfig(interval=5, eps=0.2))
    assert events.read_calls(spark, store).count() == 2 and events.read_events(spark, store, 7).count() == found.count()
    good = articles.read_articles(spark, table, "acme", 5, as_of)
    taken = sum(len(r["top_articles"].split(",")) for r in events.read_events(spark, store, 8).collect())
    assert taken <= good.count()


def test_a_company_without_articles_has_an_empty_call(spark, tmp_path):
    table, store = str(tmp_path / "articles"), str(tmp_path / "store")
    articles.write_articles(company_articles(spark).where("DATE <> 'not a date'"), table)
    for call, name, least in ((1, "nobody", 3), (2, "acme", 1000)):
        config = news_events.EventConfig(interval=9, eps=0.1, min_cluster_size=least)
        found, bad = news_events.company_run(spark, table, store, name, call, 3, dt.datetime(2024, 1, 31), config)
        assert found.count() == 0 and bad.count() == 0 and events.read_calls(spark, store).count() == call


def test_legacy_run_among_others_is_as_alone(spark):
    rows = company_articles(spark).withColumn("call_id", (F.col("article_id") % 2).cast("long"))
    config = news_events.EventConfig(eps=0.3, top_n=2)

    def table(df):
        return sorted(
            (r["cluster"], round(r["health"], 6), tuple(r["top_articles"]), len(r["top_themes"])) for r in df.collect()
        )

    together = news_events.legacy_events(rows, config, run=["call_id"])
    assert together.count() >= 2
    for call in (0, 1):
        alone = news_events.legacy_events(rows.where(F.col("call_id") == call), config, run=["call_id"])
        assert table(together.where(F.col("call_id") == call)) == table(alone)
