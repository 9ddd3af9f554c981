"""Joins, aggregates, windows, maintenance and audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.checks.fixtures import Tables
from tidemark.checks.registry import query
from tidemark.checks.scalars import question_rows_sql
from tidemark.functions.mentions import MENTION_COLUMNS
from tidemark.operators import aggregates, audits, digests, joins, maintenance, ordering, windows
from tidemark.operators.prompts import COMPANY_QUESTIONS, GREETING
from tidemark.session import write_once

KEYS = ("call_id", "cluster")

# Health vector per (call, cluster), written out from the definitions.
STATS_SQL = """
  unit AS (SELECT call_id, cluster, article_id, ts,
      list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS u FROM clustered),
  dims AS (SELECT call_id, cluster, i, sum(u[i]) AS s FROM unit, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
  sizes AS (SELECT call_id, cluster, count(*) AS n, var_pop(epoch_us(ts) / 1e6) AS v FROM clustered GROUP BY ALL),
  coh AS (SELECT call_id, cluster, CASE WHEN n > 1 THEN (sum(s * s) - n) / (n * n) ELSE 0 END AS c
          FROM dims JOIN sizes USING (call_id, cluster) GROUP BY call_id, cluster, n),
  stats AS (SELECT * FROM sizes JOIN coh USING (call_id, cluster)),
  top AS (SELECT call_id, max(n) AS mn, max(CASE WHEN cluster <> -1 THEN c END) AS mc,
                 max(CASE WHEN cluster <> -1 THEN v END) AS mv FROM stats GROUP BY call_id),
  ranked AS (SELECT call_id, cluster, n AS size, n / mn AS size_importance, c / nullif(mc, 0) AS cohesiveness,
                    v / nullif(mv, 0) AS time_variance FROM stats JOIN top USING (call_id) WHERE cluster <> -1)
"""

HEAD_SQL = {
    "persons": "string_split(m, ',')[1]",
    "organizations": "string_split(m, ',')[1]",
    "themes": "string_split(m, ',')[1]",
    "locations": "string_split(m, '#')[3]",
}


def counts_sql(kind: str) -> str:
    return f"""SELECT call_id, cluster, '{kind}' AS kind, name, count(*) AS mentions FROM (
      SELECT call_id, cluster, unnest(list_transform(string_split({MENTION_COLUMNS[kind]}, ';'), lambda m: {HEAD_SQL[kind]})) AS name
      FROM clustered) WHERE name IS NOT NULL AND name <> '' GROUP BY ALL"""


def ranked_counts_sql() -> str:
    every = " UNION ALL ".join(counts_sql(k) for k in MENTION_COLUMNS)
    return f"""SELECT *, row_number() OVER (PARTITION BY call_id, cluster, kind ORDER BY mentions DESC, name) AS rank
      FROM ({every})"""


# -- joins -----------------------------------------------------------------------------------


def _calls(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("stock_id"), F.col("ts").alias("call_time"),
        F.lit(7).alias("interval"),
    )


@query(
    "j1_enrich_events",
    """SELECT l_orderkey AS event_id, l_linenumber AS line, p_partkey AS stock_id, p_name AS stock_name, p_brand AS ticker,
              o_orderkey AS call_id, strftime(o_orderdate, '%Y-%m-%d') AS call_day
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey""",
)
def j1(t: Tables) -> DataFrame:
    events = t.lineitem.select(
        F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("stock_id"), F.col("l_orderkey").alias("call_id"),
    )
    stocks = t.part.select(F.col("p_partkey").alias("stock_id"), F.col("p_name").alias("stock_name"), F.col("p_brand").alias("ticker"))
    calls = t.orders.select(F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").alias("call_time"), F.lit(7).alias("interval"))
    return joins.enrich_events(events, stocks, calls).select(
        "event_id", "line", "stock_id", "stock_name", "ticker", "call_id",
        F.date_format("call_time", "yyyy-MM-dd").alias("call_day"),
    )


@query("j2_unprocessed", "SELECT doc_id AS event_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2(t: Tables) -> DataFrame:
    return joins.unprocessed(
        t.documents.select(F.col("doc_id").alias("event_id")), t.labels.select(F.col("doc_id").alias("event_id"))
    )


@query(
    "j3_processed_in_order",
    """SELECT o_orderkey AS event_id, o_custkey AS rank, first_line AS processed_id, part AS summary FROM orders JOIN (
         SELECT l_orderkey, min(k) AS first_line, arg_min(l_partkey, k) AS part FROM (
           SELECT *, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS k FROM lineitem) GROUP BY l_orderkey)
       ON l_orderkey = o_orderkey""",
)
def j3(t: Tables) -> DataFrame:
    events = t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("rank"))
    processed = t.lineitem.select(
        F.col("l_orderkey").alias("event_id"),
        (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("processed_id"),
        F.col("l_partkey").alias("summary"),
    )
    return joins.processed_in_order(events, processed)


@query(
    "j4_insert_if_absent",
    """SELECT accessionNo, ticker FROM filings WHERE formType = '10-K' UNION ALL
       SELECT accessionNo, min(ticker) FROM (SELECT accessionNo, ticker FROM filings UNION ALL
         SELECT concat('A', CAST(l_orderkey AS VARCHAR)), 'Z' FROM lineitem)
       WHERE accessionNo NOT IN (SELECT accessionNo FROM filings WHERE formType = '10-K') GROUP BY accessionNo""",
    ("filings",),
)
def j4(t: Tables) -> DataFrame:
    known = t.filings.where("formType = '10-K'").select("accessionNo", "ticker")
    # The incoming batch repeats keys.
    again = t.lineitem.select(F.concat(F.lit("A"), F.col("l_orderkey").cast("string")).alias("accessionNo"), F.lit("Z").alias("ticker"))
    incoming = t.filings.select("accessionNo", "ticker").unionByName(again)
    return joins.insert_if_absent(known, incoming, "accessionNo", "ticker")


@query(
    "j5_available_stocks",
    "SELECT p_partkey AS stock_id FROM part WHERE p_partkey NOT IN (SELECT stock_id FROM positions WHERE user_id = 7)",
    ("positions",),
)
def j5(t: Tables) -> DataFrame:
    return joins.available_stocks(t.part.select(F.col("p_partkey").alias("stock_id")), t.positions, 7)


def _alerts(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("alert_id"), F.col("o_custkey").alias("user_id")).distinct()


@query(
    "j6_alert_fan_out",
    """SELECT s.alert_id, s.user_id, c_name AS user_name, s.stock_id, p_name AS stock, s.alert_stock_id, a.description
       FROM alert_stocks s JOIN customer ON c_custkey = s.user_id JOIN part ON p_partkey = s.stock_id
       LEFT JOIN areas a ON a.alert_stock_id = s.alert_stock_id""",
    ("alert_stocks", "areas"),
)
def j6(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    stocks = t.part.select(F.col("p_partkey").alias("stock_id"), F.col("p_name").alias("stock"))
    mine = t.alert_stocks.select("alert_id", "stock_id", "alert_stock_id")
    return joins.alert_fan_out(_alerts(t), users, mine, stocks, t.areas.select("alert_stock_id", "description"))


@query(
    "j7_outside_portfolio",
    """SELECT alert_stock_id, alert_id, user_id, stock_id FROM alert_stocks s WHERE NOT EXISTS (
         SELECT 1 FROM positions p WHERE p.user_id = s.user_id AND p.stock_id = s.stock_id AND p.shares > 20)""",
    ("alert_stocks", "positions"),
)
def j7(t: Tables) -> DataFrame:
    mine = t.alert_stocks.select("alert_stock_id", "alert_id", "stock_id")
    return joins.outside_portfolio(mine, _alerts(t), t.positions.where("shares > 20"))


@query(
    "j8_parent_chunks",
    """SELECT vec_id AS query_id, doc_id, text AS page_content, source FROM embeddings
       JOIN documents ON doc_id = vec_id""",
)
def j8(t: Tables) -> DataFrame:
    hits = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("doc_id"))
    chunks = t.documents.select("doc_id", F.col("text").alias("original_content"), F.col("source").alias("filing_section"))
    return joins.parent_chunks(hits, chunks).select("query_id", "doc_id", "page_content", "source")


@query("j9_question_pairs", question_rows_sql("SELECT DISTINCT source AS ticker FROM documents", COMPANY_QUESTIONS))
def j9(t: Tables) -> DataFrame:
    return joins.question_pairs(t.documents.select(F.col("source").alias("ticker")), COMPANY_QUESTIONS)


@query(
    "j10_position_of",
    """SELECT portfolio_id, stock_id, user_id, p_brand AS ticker, shares, CAST(purchase_price AS DOUBLE) AS purchase_price
       FROM positions JOIN customer ON c_custkey = portfolio_id JOIN part ON p_partkey = stock_id""",
    ("positions",),
)
def j10(t: Tables) -> DataFrame:
    portfolios = t.customer.select(F.col("c_custkey").alias("portfolio_id"), F.col("c_custkey").alias("user_id"))
    stocks = t.part.select(F.col("p_partkey").alias("stock_id"), F.col("p_brand").alias("ticker"))
    found = joins.position_of(t.positions.drop("user_id"), portfolios, stocks)
    return found.withColumn("purchase_price", F.col("purchase_price").cast("double"))


# -- aggregates ------------------------------------------------------------------------------


@query(
    "a1_top_entities",
    f"SELECT call_id, cluster, kind, name, mentions, rank FROM ({ranked_counts_sql()}) WHERE rank <= 5",
    ("clustered",),
)
def a1(t: Tables) -> DataFrame:
    return aggregates.top_entities(t.clustered, 5, KEYS)


@query("a2_cluster_sizes", "SELECT call_id, cluster, count(*) AS size FROM clustered GROUP BY ALL", ("clustered",))
def a2(t: Tables) -> DataFrame:
    return aggregates.cluster_sizes(t.clustered, KEYS)


@query(
    "a3_centroid",
    """SELECT call_id, cluster, CAST(i AS INTEGER) AS i, round(avg(embedding[i + 1]), 6) AS mean
       FROM clustered, (SELECT unnest(range(0, 64)) AS i) GROUP BY ALL""",
    ("clustered",),
)
def a3(t: Tables) -> DataFrame:
    means = aggregates.centroid(t.clustered, keys=KEYS)
    return means.select(*KEYS, F.posexplode("centroid").alias("i", "m")).select(*KEYS, "i", F.round("m", 6).alias("mean"))


@query("a4_cohesiveness", f"WITH {STATS_SQL} SELECT call_id, cluster, round(c, 6) AS cohesiveness FROM stats", ("clustered",))
def a4(t: Tables) -> DataFrame:
    return aggregates.cohesiveness(t.clustered, keys=KEYS).withColumn("cohesiveness", F.round("cohesiveness", 6))


@query(
    "a5_date_variance",
    "SELECT call_id, cluster, round(var_pop(epoch_us(ts) / 8.64e10), 6) AS date_variance FROM clustered GROUP BY ALL",
    ("clustered",),
)
def a5(t: Tables) -> DataFrame:
    spread = aggregates.date_variance(t.clustered, keys=KEYS, seconds_per_unit=86400.0)
    return spread.withColumn("date_variance", F.round("date_variance", 6))


@query(
    "a6_median_date",
    """SELECT event_type AS cluster, strftime(make_timestamp(CAST(floor(median(epoch_us(ts))) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS median_date
       FROM events GROUP BY event_type""",
)
def a6(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("cluster"), "ts")
    return aggregates.median_date(rows).withColumn("median_date", F.date_format("median_date", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "a7_rank_clusters",
    f"""WITH {STATS_SQL} SELECT call_id, cluster, size, round(size_importance, 6) AS size_importance,
         round(cohesiveness, 6) AS cohesiveness, round(time_variance, 6) AS time_variance FROM ranked""",
    ("clustered",),
)
def a7(t: Tables) -> DataFrame:
    ranked = aggregates.rank_clusters(t.clustered, keys=KEYS)
    return ranked.withColumns({c: F.round(c, 6) for c in ("size_importance", "cohesiveness", "time_variance")})


@query(
    "a8_rank_by_silhouette",
    f"""WITH top5 AS (SELECT call_id, cluster, sum(mentions) AS mass FROM ({ranked_counts_sql()}) WHERE rank <= 5 GROUP BY ALL),
         f AS (SELECT call_id, cluster, avg((article_id % 97) / 89.0) AS sil, count(*) AS n FROM clustered GROUP BY ALL),
         j AS (SELECT *, max(sil) OVER w AS ms, max(n) OVER w AS mn, max(mass) OVER w AS mm
               FROM f JOIN top5 USING (call_id, cluster) WINDOW w AS (PARTITION BY call_id))
       SELECT call_id, cluster, round(sil / nullif(ms, 0), 6) AS rank, round(n / mn, 6) AS norm_size, round(mass / mm, 6) AS norm_entities FROM j""",
    ("clustered",),
)
def a8(t: Tables) -> DataFrame:
    scored = t.clustered.withColumn("silhouette", (F.col("article_id") % 97) / 89.0)
    ranked = aggregates.rank_clusters_by_silhouette(scored, keys=KEYS)
    return ranked.withColumns({c: F.round(c, 6) for c in ("rank", "norm_size", "norm_entities")})


@query(
    "a9_entity_mass",
    f"SELECT call_id, cluster, CAST(sum(mentions) AS BIGINT) AS entity_mass FROM ({ranked_counts_sql()}) WHERE rank <= 5 GROUP BY ALL",
    ("clustered",),
)
def a9(t: Tables) -> DataFrame:
    return aggregates.entity_mass(t.clustered, keys=KEYS)


INFO_SQL = f"""WITH {STATS_SQL},
  firsts AS (SELECT call_id, cluster, string_agg(DocumentIdentifier, ',' ORDER BY rn) AS top_articles FROM (
      SELECT *, row_number() OVER (PARTITION BY call_id, cluster ORDER BY ts, article_id) AS rn FROM clustered) WHERE rn <= 3 GROUP BY ALL),
  counted AS (SELECT * FROM ({ranked_counts_sql()}) WHERE rank <= 5),
  lists AS (SELECT call_id, cluster, string_agg(CASE WHEN kind = 'themes' THEN name END, ',' ORDER BY rank) AS top_themes,
      string_agg(CASE WHEN kind = 'persons' THEN name END, ',' ORDER BY rank) AS top_persons,
      string_agg(CASE WHEN kind = 'organizations' THEN name END, ',' ORDER BY rank) AS top_orgs,
      string_agg(CASE WHEN kind = 'locations' THEN name END, ',' ORDER BY rank) AS top_locs FROM counted GROUP BY ALL),
  medians AS (SELECT call_id, cluster, strftime(make_timestamp(CAST(floor(median(epoch_us(ts))) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS median_date
      FROM clustered GROUP BY ALL),
  info AS (SELECT call_id, cluster, size, round(size_importance, 6) AS size_importance, round(cohesiveness, 6) AS cohesiveness,
      round(time_variance, 6) AS time_variance, top_articles, coalesce(top_themes, '') AS top_themes, coalesce(top_persons, '') AS top_persons,
      coalesce(top_orgs, '') AS top_orgs, coalesce(top_locs, '') AS top_locs, median_date
    FROM ranked JOIN firsts USING (call_id, cluster) LEFT JOIN lists USING (call_id, cluster) JOIN medians USING (call_id, cluster))"""


def readable(info: DataFrame, *extra: str | Column) -> DataFrame:
    """Cluster rows with lists as text, for comparison."""
    names = {"top_themes": "top_themes", "top_persons": "top_persons", "top_organizations": "top_orgs", "top_locations": "top_locs"}
    return info.select(
        *KEYS, "size", *extra, *[F.round(c, 6).alias(c) for c in ("size_importance", "cohesiveness", "time_variance")],
        F.array_join("top_articles", ",").alias("top_articles"),
        *[F.array_join(F.transform(F.col(c), lambda e: e["name"]), ",").alias(n) for c, n in names.items()],
        F.date_format("median_date", "yyyy-MM-dd HH:mm:ss").alias("median_date"),
    )


MEANS_SQL = """, means AS (SELECT call_id, cluster, round(sum(i * a), 6) AS mean_sum, round(sum(a * a), 6) AS mean_square FROM (
      SELECT call_id, cluster, i, avg(embedding[i]) AS a FROM clustered, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY ALL)"""


@query("a10_cluster_info", INFO_SQL + MEANS_SQL + " SELECT info.*, mean_sum, mean_square FROM info JOIN means USING (call_id, cluster)", ("clustered",))
def a10(t: Tables) -> DataFrame:
    """All coordinates of the mean vector are compared through their weighted sum and their squares."""
    # The derived input is read several times, so it is written once.
    info = aggregates.cluster_info(write_once(t.clustered, "clustered"), keys=KEYS)
    weighted = F.transform("mean_embedding", lambda v, i: v * (i + 1))
    return readable(
        info, F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 6).alias("mean_sum"),
        F.round(F.aggregate("mean_embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("mean_square"),
    )


@query(
    "a11_events_digest",
    """SELECT call_id, (rn - 1) // 1000 AS part, string_agg(concat(' ' || chr(10) || '        Summary: "', DocumentIdentifier, '" ' || chr(10)), ''
              ORDER BY rn) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY ts, article_id) AS rn FROM clustered)
       GROUP BY ALL""",
    ("clustered",),
)
def a11(t: Tables) -> DataFrame:
    articles = t.clustered.select("call_id", "article_id", F.col("DocumentIdentifier").alias("summary"), F.unix_micros("ts").alias("at"))
    ranked = ordering.ordered_positions(articles, ["call_id"], "at", ["article_id"], "before").withColumn("rank", F.col("before") + 1)
    return digests.events_digest(ranked)


@query(
    "a12_event_string",
    """SELECT conv_id, CAST(0 AS BIGINT) AS part, string_agg(concat(chr(10), ' Event Summary:', chr(10), role, chr(10), chr(10), chr(10),
              ' Event Summary:', chr(10), text, chr(10), chr(10)), '' ORDER BY turn) AS event_string FROM conversations GROUP BY conv_id""",
)
def a12(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("summaries", F.create_map(F.lit("a"), "role", F.lit("b"), "text"))
    return digests.event_string(rows, ["conv_id"], "turn", "summaries")


@query(
    "a13_qa_string",
    """SELECT conv_id, CAST(0 AS BIGINT) AS part, string_agg(concat('Question:', chr(10), role, chr(10), ' Answer:', chr(10), text, chr(10)), ''
              ORDER BY turn) AS qa_string FROM conversations GROUP BY conv_id""",
)
def a13(t: Tables) -> DataFrame:
    return digests.qa_string(t.conversations, ["conv_id"], "turn", "role", "text")


@query(
    "a14_alert_digest",
    """WITH lines AS (SELECT s.user_id, s.alert_stock_id, p_name AS stock,
           concat(p_name, chr(10), coalesce(string_agg('About ' || a.description || chr(10), '' ORDER BY a.area_id), '')) AS txt
         FROM alert_stocks s JOIN part ON p_partkey = s.stock_id LEFT JOIN areas a ON a.alert_stock_id = s.alert_stock_id
         GROUP BY s.user_id, s.alert_stock_id, p_name)
       SELECT user_id, CAST(0 AS BIGINT) AS part, string_agg(txt, chr(10) ORDER BY alert_stock_id) AS digest FROM lines GROUP BY user_id""",
    ("alert_stocks", "areas"),
)
def a14(t: Tables) -> DataFrame:
    stocks = t.alert_stocks.join(t.part, F.col("p_partkey") == F.col("stock_id")).select(
        "user_id", "alert_stock_id", F.col("p_name").alias("stock")
    )
    analysis = F.concat(F.lit("About "), "description")
    rows = stocks.join(t.areas, "alert_stock_id", "left").withColumn("analysis", analysis)
    return digests.alert_digest(rows)


@query(
    "a15_interests_by_stock",
    """SELECT s.alert_stock_id, s.stock_id, CAST(0 AS BIGINT) AS part,
              coalesce(string_agg(a.description, '; ' ORDER BY a.area_id), 'No areas specified') AS interests
       FROM alert_stocks s LEFT JOIN areas a ON a.alert_stock_id = s.alert_stock_id GROUP BY s.alert_stock_id, s.stock_id""",
    ("alert_stocks", "areas"),
)
def a15(t: Tables) -> DataFrame:
    return digests.interests_by_stock(t.alert_stocks.select("alert_stock_id", "stock_id"), t.areas)


@query(
    "a16_chat_transcript",
    f"""SELECT conv_id, CAST(0 AS BIGINT) AS part, concat('Human: {GREETING[0]}', chr(10), 'AI Assistant: {GREETING[1]}', chr(10),
         string_agg(concat(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'AI Assistant: ' END, text), chr(10) ORDER BY turn)) AS transcript
       FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""",
)
def a16(t: Tables) -> DataFrame:
    return digests.chat_transcript(t.conversations)


@query(
    "a17_constraint_audits",
    """SELECT 'positions' AS rule, l_partkey AS key, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey HAVING count(*) > 1
       UNION ALL SELECT 'alert_stocks', l_suppkey, count(*) FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1
       UNION ALL SELECT 'areas', l_orderkey, count(*) FROM lineitem GROUP BY l_orderkey, l_returnflag HAVING count(*) > 1
       UNION ALL SELECT 'too_many', l_orderkey, count(*) FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5""",
)
def a17(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    found = [
        ("positions", "stock_id", audits.duplicate_positions(lines.select(F.col("o_custkey").alias("portfolio_id"), F.col("l_partkey").alias("stock_id")))),
        ("alert_stocks", "stock_id", audits.duplicate_alert_stocks(t.lineitem.select(F.col("l_orderkey").alias("alert_id"), F.col("l_suppkey").alias("stock_id")))),
        ("areas", "alert_stock_id", audits.duplicate_areas(t.lineitem.select(F.col("l_orderkey").alias("alert_stock_id"), F.col("l_returnflag").alias("description")))),
        ("too_many", "alert_stock_id", audits.too_many_areas(t.lineitem.select(F.col("l_orderkey").alias("alert_stock_id")))),
    ]
    rows = [df.select(F.lit(rule).alias("rule"), F.col(key).alias("key"), "n") for rule, key, df in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("a18_row_counts", "SELECT call_id, count(*) AS n FROM articles GROUP BY call_id", ("articles",))
def a18(t: Tables) -> DataFrame:
    return aggregates.row_counts(t.articles)


# -- windows ---------------------------------------------------------------------------------


@query(
    "w1_latest_call",
    """SELECT user_id AS stock_id, event_id AS call_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS call_time FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def w1(t: Tables) -> DataFrame:
    return windows.latest_call(_calls(t)).select(
        "stock_id", "call_id", F.date_format("call_time", "yyyy-MM-dd HH:mm:ss").alias("call_time")
    )


@query(
    "w1_latest_call_today",
    """SELECT user_id AS stock_id, event_id AS call_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-17'
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def w1_today(t: Tables) -> DataFrame:
    return windows.latest_call(_calls(t), dt.date(2024, 1, 17)).select("stock_id", "call_id")


@query(
    "w2_latest_filing",
    """SELECT ticker, accessionNo, formType FROM filings WHERE formType IN ('10-K', '10-Q', '8-K')
       QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filedAt DESC, accessionNo DESC) = 1""",
    ("filings",),
)
def w2(t: Tables) -> DataFrame:
    return windows.latest_filing(t.filings).select("ticker", "accessionNo", "formType")


@query(
    "w3_filings_dashboard",
    """SELECT 'T7' AS board, accessionNo, formType FROM filings WHERE ticker = 'T7' UNION ALL
       SELECT * FROM (SELECT 'newest', accessionNo, formType FROM filings ORDER BY filedAt DESC, accessionNo DESC LIMIT 10)""",
    ("filings",),
)
def w3(t: Tables) -> DataFrame:
    one = windows.filings_dashboard(t.filings, "T7").select(F.lit("T7").alias("board"), "accessionNo", "formType")
    newest = windows.filings_dashboard(t.filings).select(F.lit("newest").alias("board"), "accessionNo", "formType")
    return one.unionByName(newest)


@query(
    "w4_top_events",
    f"""WITH {STATS_SQL} SELECT call_id, cluster, rank, round(score, 6) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY score DESC NULLS FIRST, cluster) AS rank FROM (
           SELECT *, 0.5 * size_importance + 0.3 * cohesiveness + (1 - time_variance) * (-0.2) AS score FROM ranked))
       WHERE rank <= 5""",
    ("clustered",),
)
def w4(t: Tables) -> DataFrame:
    events = aggregates.rank_clusters(t.clustered, keys=KEYS)
    return windows.top_events(events, 5, tie="cluster").select(*KEYS, "rank", F.round("score", 6).alias("score"))


@query(
    "w5_first_articles",
    """SELECT call_id, cluster, article_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY call_id, cluster ORDER BY ts, article_id) AS rank
       FROM clustered) WHERE rank <= 3""",
    ("clustered",),
)
def w5(t: Tables) -> DataFrame:
    return aggregates.first_articles(t.clustered, 3, keys=KEYS).select(*KEYS, "article_id", "rank")


@query(
    "w7_top_clusters",
    """SELECT article_id, cluster FROM clustered WHERE cluster IN (
         SELECT cluster FROM clustered GROUP BY cluster ORDER BY count(*) DESC, cluster LIMIT 3)""",
    ("clustered",),
)
def w7(t: Tables) -> DataFrame:
    rows = t.clustered.select("article_id", "cluster")
    return windows.top_clusters(rows, aggregates.cluster_sizes(rows), 3, "size")


@query(
    "w9_first_fact",
    """SELECT accessionNo, item, value FROM facts QUALIFY row_number() OVER (PARTITION BY accessionNo, item ORDER BY rank_key, price_key, l_suppkey) = 1""",
    ("facts",),
)
def w9(t: Tables) -> DataFrame:
    facts = t.facts.select("accessionNo", "item", "value", F.struct("rank_key", "price_key", "l_suppkey").alias("pos"))
    return windows.first_fact(facts, ["accessionNo", "item"]).drop("pos")


# -- table maintenance -----------------------------------------------------------------------


@query("o1_add_rows", "SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents")
def o1(t: Tables) -> DataFrame:
    return maintenance.add_rows(t.benchmark.select(F.col("item_id").alias("doc_id"), "text"), t.documents.select("doc_id", "text"))


@query("o2_delete_rows", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def o2(t: Tables) -> DataFrame:
    return maintenance.delete_rows(t.documents.select("doc_id", "lang"), t.labels.where("quality = 0"), "doc_id")


@query(
    "o3_upsert_rows",
    """SELECT item_id AS doc_id, text FROM benchmark UNION ALL
       SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)""",
)
def o3(t: Tables) -> DataFrame:
    changes = t.benchmark.select(F.col("item_id").alias("doc_id"), "text")
    return maintenance.upsert_rows(t.documents.select("doc_id", "text"), changes, "doc_id")


@query(
    "o4_remove_stock",
    """WITH gone AS (SELECT user_id, stock_id FROM alert_stocks WHERE first_line > 4)
       SELECT 'bridge' AS tab, user_id, stock_id FROM positions ANTI JOIN gone USING (user_id, stock_id) UNION ALL
       SELECT 'alert_stocks', user_id, stock_id FROM alert_stocks ANTI JOIN gone USING (user_id, stock_id) UNION ALL
       SELECT 'positions', user_id, stock_id FROM positions ANTI JOIN gone USING (user_id, stock_id)""",
    ("alert_stocks", "positions"),
)
def o4(t: Tables) -> DataFrame:
    # Written, so that no task adds up the pairs of two inputs and sorts them for the join as well.
    alert_stocks = write_once(t.alert_stocks.select("user_id", "stock_id", "first_line"), "alert-stocks")
    pairs = write_once(t.positions.select("user_id", "stock_id"), "pairs")
    left = maintenance.remove_stock(alert_stocks.where("first_line > 4"), pairs, alert_stocks.select("user_id", "stock_id"), pairs)
    rows = [df.select(F.lit(name).alias("tab"), "user_id", "stock_id") for name, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "o5_get_or_create",
    """SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, 1, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def o5(t: Tables) -> DataFrame:
    return maintenance.get_or_create(t.documents, t.labels, ["doc_id"], {"quality": F.lit(1), "toxic": F.lit(0)})


@query(
    "o6_flag_events",
    "SELECT doc_id AS event_id, coalesce(lang = 'fr', FALSE) OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS irrelevant FROM documents",
)
def o6(t: Tables) -> DataFrame:
    events = t.documents.select(F.col("doc_id").alias("event_id"), (F.col("lang") == "fr").alias("irrelevant"))
    return maintenance.flag_events(events, t.labels.where("toxic = 1").select(F.col("doc_id").alias("event_id")))


@query(
    "o7_set_interest",
    """SELECT p.portfolio_id, p.stock_id, coalesce('new ' || s.first_line, 'old') AS area_of_interest,
              coalesce('p ' || s.first_line, 'old') AS processed_area_of_interest
       FROM positions p LEFT JOIN (SELECT * FROM alert_stocks WHERE first_line > 3) s ON s.user_id = p.portfolio_id AND s.stock_id = p.stock_id""",
    ("positions", "alert_stocks"),
)
def o7(t: Tables) -> DataFrame:
    held = t.positions.select(
        "portfolio_id", "stock_id", F.lit("old").alias("area_of_interest"), F.lit("old").alias("processed_area_of_interest")
    )
    line = F.col("first_line").cast("string")
    changes = t.alert_stocks.where("first_line > 3").select(
        F.col("user_id").alias("portfolio_id"), "stock_id",
        F.concat(F.lit("new "), line).alias("area_of_interest"), F.concat(F.lit("p "), line).alias("processed_area_of_interest"),
    )
    return maintenance.set_interest(held, changes)


@query(
    "o8_add_positions",
    """WITH held AS (SELECT portfolio_id, stock_id FROM positions WHERE shares > 25),
            new AS (SELECT o_custkey AS portfolio_id, l_partkey AS stock_id,
                 min(l_orderkey * 10000000000 + l_linenumber * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_no, count(*) AS n
               FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
       SELECT 'positions' AS tab, portfolio_id, stock_id, CAST(1 AS BIGINT) AS n FROM (SELECT * FROM held UNION ALL SELECT portfolio_id, stock_id FROM new ANTI JOIN held USING (portfolio_id, stock_id))
       UNION ALL SELECT 'bridge', portfolio_id, stock_id, 1 FROM (SELECT * FROM held UNION ALL SELECT portfolio_id, stock_id FROM new ANTI JOIN held USING (portfolio_id, stock_id))
       UNION ALL SELECT 'rejected', portfolio_id, stock_id, n - CASE WHEN h.stock_id IS NULL THEN 1 ELSE 0 END
         FROM new LEFT JOIN (SELECT portfolio_id, stock_id FROM held) h USING (portfolio_id, stock_id)
         WHERE n - CASE WHEN h.stock_id IS NULL THEN 1 ELSE 0 END > 0""",
    ("positions",),
)
def o8(t: Tables) -> DataFrame:
    held = t.positions.where("shares > 25").select("portfolio_id", "stock_id")
    row_no = F.col("l_orderkey") * 10000000000 + F.col("l_linenumber").cast("long") * 1000000000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    new = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("portfolio_id"), F.col("l_partkey").alias("stock_id"), row_no.alias("row_no")
    )
    positions, bridge, rejected = maintenance.add_positions(held, held, new, "row_no")
    parts = {"positions": positions, "bridge": bridge, "rejected": rejected}
    rows = [
        df.groupBy("portfolio_id", "stock_id").agg(F.count("*").alias("n")).withColumn("tab", F.lit(name))
        for name, df in parts.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
