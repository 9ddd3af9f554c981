"""Shapes of physical plans that matter at scale."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.checks import catalog, fixtures
from tidemark.checks.fixtures import Tables
from tidemark.operators import aggregates, filters, ordering, windows
from tidemark.operators.vectors import knn
from tidemark.sources.articles import select_articles

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_time_filter_and_columns_reach_the_scan(spark):
    t = Tables(spark, SF_DIR)
    text = plan(filters.recent(t.events, "ts", dt.datetime(2024, 1, 31), 7).select("event_id"))
    assert "GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_only_needed_article_columns_are_kept(spark):
    t = Tables(spark, SF_DIR)
    assert "embedding" not in plan(select_articles(t.clustered, "brand", 7, dt.datetime(2001, 1, 1), "partition_date")).split("FileScan")[0]


def test_top_k_is_cut_before_the_shuffle(spark):
    t = Tables(spark, SF_DIR)
    text = plan(aggregates.top_entities(t.clustered, 5, ("call_id", "cluster")))
    assert text.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan(windows.filings_dashboard(t.filings))


def test_latest_row_combines_before_the_shuffle(spark):
    t = Tables(spark, SF_DIR)
    text = plan(ordering.latest_per_key(t.events, ["user_id"], ["ts", "event_id"]))
    assert "partial_max_by" in text and "Window" not in text


def test_small_query_side_leaves_the_corpus_in_place(spark):
    t = Tables(spark, SF_DIR)
    text = plan(knn(t.embeddings, t.embeddings, 5, ["label"], query_id="vec_id", corpus_id="vec_id"))
    before = text[text.index("MapInPandas"):]
    assert "Exchange" not in before


LAZY = [
    name for name in sorted(catalog.QUERIES)
    # Whole runs, which write their steps; what they consist of is looked at on its own.
    if not name.startswith(("a10", "c", "s1_article", "s2", "s3", "st2", "r9_daily", "v2", "v4_knn_blocks"))
]


@pytest.mark.parametrize("name", LAZY)
def test_no_product_or_row_udf(spark, no_broadcast, name):
    text = plan(catalog.QUERIES[name](spark, SF_DIR))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert forbidden not in text


def test_hot_cluster_is_counted_in_many_tasks(spark):
    """The shuffle key of the counts includes the name, not the cluster alone."""
    rows = spark.range(100).select(
        (F.col("id") % 2).alias("cluster"), *[F.lit("a,1;b,2").alias(c) for c in ("V2Persons", "V2Organizations", "V2Locations", "V2Themes")]
    )
    text = plan(aggregates.entity_counts(rows))
    shuffle = text[text.index("hashpartitioning("):].split(")")[0]
    assert "cluster" in shuffle and "kind" in shuffle and "name" in shuffle


def test_chunks_are_derived_once(spark):
    assert "posexplode" not in plan(catalog.QUERIES["t2_chunk_by_separator"](spark, SF_DIR))


def test_lines_of_an_order_are_gathered_in_one_list(spark):
    text = plan(Tables(spark, SF_DIR).articles)
    # One list, partial and merged.
    assert "listagg(" not in text and text.count("collect_list(") == 2


def test_gathered_articles_are_those_of_the_aggregates(spark, tmp_path):
    def listagg(x: str) -> str:
        return f"listagg({x}, ';') WITHIN GROUP (ORDER BY l_linenumber, {x})"

    rows = {
        "region": "SELECT 1 AS r_regionkey, 'R' AS r_name",
        "nation": "SELECT 1 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey UNION ALL SELECT 2, NULL, 1",
        "supplier": "SELECT * FROM VALUES (1, 's b', 1), (2, '', 1), (3, NULL, 2), (4, 's a', 1) AS t(s_suppkey, s_name, s_nationkey)",
        "part": "SELECT * FROM VALUES (1, 'p', 'B1', 'T'), (2, NULL, 'B2', NULL), (3, 'é x', 'B3', 'U'), (3, 'twice', 'B3', 'U') AS t(p_partkey, p_name, p_brand, p_type)",
        # Lines with one number, without number, of one order only nulls, repeated rows, an order without lines.
        "lineitem": """SELECT * FROM VALUES (1, 2, 1, 1), (1, 2, 4, 3), (1, 1, 2, 2), (1, NULL, 1, 3), (1, 10, 1, 1), (1, 10, 1, 1), (2, 1, 3, 2), (3, 1, 2, 1),
          (NULL, 1, 1, 1) AS t(l_orderkey, l_linenumber, l_suppkey, l_partkey)""",
        "orders": """SELECT *, TIMESTAMP '2024-01-02 03:04:05' AS o_orderdate, 'O' AS o_orderstatus FROM
          VALUES (1, '1-HIGH'), (2, '5-LOW'), (2, NULL), (3, '2-X'), (4, '2-X'), (NULL, '2-X') AS t(o_orderkey, o_orderpriority)""",
    }
    for name, sql in rows.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    tables = Tables(spark, str(tmp_path))
    got = tables.articles
    text = re.sub(r"\{joined:(\w+)\}", lambda m: listagg(m[1]), fixtures.ARTICLES.replace("{string}", "STRING").replace("{date}", fixtures.Spark.stamp("o_orderdate")))
    wanted = spark.sql(text)
    assert got.schema.simpleString() == wanted.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())) and got.count() == 4


def test_stock_removal_adds_up_no_pairs_in_its_joins(spark, tmp_path):
    """The inputs are added up and written before; the tasks of the joins only sort them."""
    from pyspark.sql import Row

    lines = [(1, 1, 5), (1, 2, 1), (2, 2, 6), (3, 1, 2), (3, 1, 7), (None, 4, 1)]
    spark.createDataFrame([Row(l_orderkey=o, l_partkey=p, l_linenumber=n, l_quantity=1.0, l_extendedprice=2.0) for o, p, n in lines]).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([Row(o_orderkey=o, o_custkey=o * 10) for o in (1, 2, 3)]).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([Row(p_partkey=1)]).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["o4_remove_stock"](spark, str(tmp_path))
    assert "HashAggregate" not in plan(got)
    want = [(tab, user, stock) for tab in ("alert_stocks", "bridge", "positions") for user, stock in ((10, 2), (30, 1))]
    assert sorted(map(tuple, got.collect())) == want
