"""Vectors, clustering, statements, graph and rate audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.checks.fixtures import Tables
from tidemark.checks.registry import query, shared_folder
from tidemark.checks.relational import INFO_SQL, KEYS, readable
from tidemark.checks.scalars import distinct_sql, sentence_sql
from tidemark.functions import vectors as vec
from tidemark.functions.mentions import MENTION_COLUMNS
from tidemark.operators import clustering, graph, statements, vectors, windows
from tidemark.operators.aggregates import cluster_info
from tidemark.operators.model_map import map_with_model
from tidemark.plans import event_processing, news_events
from tidemark.session import cut_lineage, write_once
from tidemark.sources.articles import write_articles
from tidemark.sources.events import call_row, read_calls, read_events, write_events
from tidemark.streaming import incremental, rate_limit

TERM_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
ONES = [1.0] * 64
ONES_SQL = "list_transform(range(0, 64), lambda x: 1.0::DOUBLE)"
UNIT_SQL = "list_transform({0}, lambda x: x / sqrt(list_sum(list_transform({0}, lambda y: y * y))))"


def slots_sql(table: str, text: str, key: str) -> str:
    """Named subquery ``slots`` (key, slot, n, len): the default vector of each row, before division by its length."""
    return f"""WITH term_rows AS (SELECT {key}, unnest({TERM_SQL.format(text)}) AS term FROM {table}),
      term_counts AS (SELECT {key}, term, count(*) AS n FROM term_rows GROUP BY ALL),
      term_names AS (SELECT term, CAST(('0x' || substr(md5(term), 1, 7))::BIGINT % 256 AS BIGINT) AS slot FROM (SELECT DISTINCT term FROM term_counts)),
      term_slots AS (SELECT {key}, slot, CAST(sum(n) AS BIGINT) AS n FROM term_counts JOIN term_names USING (term) GROUP BY ALL),
      slots AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY {key})) AS len FROM term_slots)"""


# -- vectors ---------------------------------------------------------------------------------


@query(
    "v1_embed",
    slots_sql("documents", "text", "doc_id") + " SELECT doc_id, slot, round(n / len, 6) AS weight FROM slots",
)
def v1(t: Tables) -> DataFrame:
    """Every weight of every vector."""
    embedded = vectors.embed(t.documents.select("doc_id", "text"), "text")
    slots = F.transform("embedding", lambda w, i: F.struct(i.cast("long").alias("slot"), F.round(w, 6).alias("weight")))
    return embedded.select("doc_id", F.inline(F.filter(slots, lambda s: s["weight"] != 0)))


def _short_only(texts: list[str]) -> list:
    return [[float(len(t))] if len(t) < 100 else None for t in texts]


def _any_length(texts: list[str]) -> list:
    return [[float(-len(t))] for t in texts]


@query("v2_embed_with_fallback", "SELECT doc_id, -length(text)::DOUBLE AS first FROM documents")
def v2(t: Tables) -> DataFrame:
    embedded = vectors.embed_with_fallback(t.documents.select("doc_id", "text"), "text", _short_only, _any_length)
    return embedded.select("doc_id", F.get("embedding", F.lit(0)).alias("first"))


@query(
    "v3_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def v3(t: Tables) -> DataFrame:
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(nxt, "vec_id").select("vec_id", F.round(vec.cosine("embedding", "other"), 6).alias("similarity"))


def knn_sql(distance: str) -> str:
    return f"""SELECT query_id, neighbour_id, rank, round(distance, 6) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM (
        SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, round({distance}, 9) AS distance
        FROM embeddings q JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.vec_id)) WHERE rank <= 5"""


def _knn(t: Tables, **options) -> DataFrame:
    found = vectors.knn(
        t.embeddings, t.embeddings, 5, ["label"], query_id="vec_id", corpus_id="vec_id", exclude_self=True, **options
    )
    return found.select("query_id", "neighbour_id", "rank", F.round("distance", 6).alias("distance"))


@query("v4_knn_l2", knn_sql("list_sum(list_transform(list_zip(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"))
def v4_l2(t: Tables) -> DataFrame:
    return _knn(t, metric="l2")


@query("v4_knn_cosine", knn_sql("1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"))
def v4_cosine(t: Tables) -> DataFrame:
    return _knn(t, metric="cosine")


@query("v4_knn_blocks", knn_sql("1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"))
def v4_blocks(t: Tables) -> DataFrame:
    # The plan for query sides that are too large to send to every task.
    return _knn(t, metric="cosine", broadcast_bytes=0, block_rows=64)


@query(
    "v4_knn_many_queries",
    """SELECT query_id, neighbour_id, rank, round(distance, 6) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM (
        SELECT q.article_id AS query_id, c.vec_id AS neighbour_id, round(1 - list_cosine_similarity(q.embedding, c.embedding::DOUBLE[]), 9) AS distance
        FROM clustered q JOIN embeddings c ON c.label = q.cluster)) WHERE rank <= 3""",
    ("clustered",),
)
def v4_many(t: Tables) -> DataFrame:
    # Many queries over a smaller corpus; the library's fixed bound decides which side is sent to the tasks.
    asked = t.clustered.select("article_id", F.col("cluster").cast("int").alias("label"), "embedding")
    found = vectors.knn(asked, t.embeddings, 3, ["label"], "cosine", "article_id", "vec_id")
    return found.select("query_id", "neighbour_id", "rank", F.round("distance", 6).alias("distance"))


@query(
    "v5_flag_irrelevant",
    f"SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {ONES_SQL}) > 0.05 AS irrelevant FROM embeddings",
)
def v5(t: Tables) -> DataFrame:
    flagged = vectors.flag_irrelevant(t.embeddings, "embedding", ONES, 0.05)
    return flagged.select("vec_id", "irrelevant")


@query(
    "v6_backfill_vectors",
    f"""SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS was_missing, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 16.0::DOUBLE
         WHEN len({TERM_SQL.format('text')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM documents""",
)
def v6(t: Tables) -> DataFrame:
    known = t.labels.select("doc_id", F.lit(True).alias("known"))
    fill = F.when(F.col("known"), F.lit(-10.0)).otherwise(F.lit(1.0))
    rows = t.documents.select("doc_id", "text").join(known, "doc_id", "left").withColumn("summary_embedding", F.array_repeat(fill, 256))
    missing = vectors.needs_vector(rows).select("doc_id", F.lit(True).alias("m"))
    filled = vectors.backfill_vectors(rows, "text")
    return filled.join(missing, "doc_id", "left").select(
        "doc_id", F.coalesce("m", F.lit(False)).alias("was_missing"),
        F.round(vec.norm(F.col("summary_embedding")), 6).alias("length"),
    )


def tfidf_sql() -> str:
    parts = [
        f"SELECT article_id, '{kind}' AS kind, unnest({TERM_SQL.format(distinct_sql(column, kind, ' '))}) AS term FROM articles"
        for kind, column in MENTION_COLUMNS.items()
    ]
    return f"""WITH tok AS ({' UNION ALL '.join(parts)}),
      tf AS (SELECT article_id, kind, term, count(*) AS tf FROM tok GROUP BY ALL),
      idf AS (SELECT kind, term, ln((1 + (SELECT count(*) FROM articles)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY ALL),
      w AS (SELECT article_id, kind, term, tf * idf AS w FROM tf JOIN idf USING (kind, term))
      SELECT article_id, kind, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY article_id, kind)), 6) AS weight FROM w"""


@query("v7_tfidf", tfidf_sql(), ("articles",))
def v7(t: Tables) -> DataFrame:
    return vectors.tfidf(t.articles, MENTION_COLUMNS).withColumn("weight", F.round("weight", 6))


@query(
    "w6_rank_by_similarity",
    f"""SELECT vec_id AS event_id, round(s, 6) AS similarity FROM (
          SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {ONES_SQL}) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 30""",
)
def w6(t: Tables) -> DataFrame:
    events = t.embeddings.select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("summary_embedding"))
    best = windows.rank_by_similarity(events, vec.as_vector(ONES), 30)
    return best.select("event_id", F.round("similarity", 6).alias("similarity"))


DIVERSE_SQL = f"""WITH u AS (SELECT vec_id, label, {UNIT_SQL.format('e')} AS u, e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)),
  cen AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]) AS m FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY label),
  near AS (SELECT u.*, round(list_cosine_similarity(e, c), 9) AS s FROM u JOIN cen USING (label)),
  p1 AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1),
  n2 AS (SELECT n.* FROM near n JOIN p1 ON p1.label = n.label WHERE n.vec_id <> p1.vec_id AND list_dot_product(n.u, p1.u) <= 0.05),
  p2 AS (SELECT * FROM n2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1),
  n3 AS (SELECT n.* FROM n2 n JOIN p2 ON p2.label = n.label WHERE n.vec_id <> p2.vec_id AND list_dot_product(n.u, p2.u) <= 0.05),
  p3 AS (SELECT * FROM n3 QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1)
  SELECT label AS cluster, 1 AS rank, vec_id FROM p1 UNION ALL SELECT label, 2, vec_id FROM p2 UNION ALL SELECT label, 3, vec_id FROM p3"""


@query("w8_diverse_top", DIVERSE_SQL)
def w8(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumnRenamed("label", "cluster")
    return clustering.diverse_top(rows, 3, 0.05, id_col="vec_id")


WANTED = "blue gear from NATION_3"


@query(
    "w10_rank_by_description",
    slots_sql(f"(SELECT article_id, {sentence_sql()} AS sentence FROM articles UNION ALL SELECT -1, '{WANTED}')", "sentence", "article_id")
    + """, wanted AS (SELECT slot, n, len FROM slots WHERE article_id = -1)
      SELECT article_id, round(coalesce(s, 0), 6) AS similarity FROM articles LEFT JOIN (SELECT a.article_id, sum(a.n * w.n) / any_value(a.len * w.len) AS s
        FROM slots a JOIN wanted w ON w.slot = a.slot WHERE a.article_id <> -1 GROUP BY a.article_id) x USING (article_id)""",
    ("articles",),
)
def w10(t: Tables) -> DataFrame:
    ranked = event_processing.rank_by_description(t.articles, WANTED, None, tie="article_id")
    return ranked.select("article_id", F.round("similarity", 6).alias("similarity"))


# -- clustering ------------------------------------------------------------------------------

# Two projections over all coordinates: signs change from one coordinate to the next, and from pair to pair.
SIGNED_SQL = "round(list_sum(list_transform(embedding, lambda v, i: CASE WHEN ({}) % 2 = 0 THEN v::DOUBLE ELSE -v::DOUBLE END)) / 8, 9)"
POINTS_SQL = f"SELECT vec_id AS id, {SIGNED_SQL.format('i - 1')} AS x, {SIGNED_SQL.format('(i - 1) // 2')} AS y FROM embeddings"


def _points(t: Tables) -> DataFrame:
    def signed(step: int) -> Column:
        signs = F.transform("embedding", lambda v, i: F.when(F.floor(i / step) % 2 == 0, v.cast("double")).otherwise(-v.cast("double")))
        return F.round(F.aggregate(signs, F.lit(0.0), lambda a, x: a + x) / 8, 9)

    return t.embeddings.select(F.col("vec_id").alias("article_id"), F.array(signed(1), signed(2)).alias("reduced"))


# The largest component of a symmetric matrix by squaring it thirty times; it is taken away for the second one.
def _powers(name: str, start: str) -> str:
    return f"""{name} AS (SELECT 0 AS k, c AS p FROM {start} UNION ALL
    SELECT k + 1, list_transform(q, lambda a: list_transform(a, lambda x: x / t)) FROM (
      SELECT k, q, list_sum(list_transform(range(1, 65), lambda i: q[i][i])) AS t FROM (
        SELECT k, list_transform(p, lambda a: list_transform(p, lambda b: list_dot_product(a, b))) AS q FROM {name} WHERE k < 30))),
  {name}_axis AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS w FROM (
    SELECT p[list_position(d, list_max(d))] AS r FROM (SELECT p, list_transform(range(1, 65), lambda i: p[i][i]) AS d FROM {name} WHERE k = 30)))"""


COMPONENTS_SQL = f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  axis AS (SELECT unnest(range(1, 65)) AS i),
  cov AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(x ORDER BY j) AS r FROM (
    SELECT a.i, b.i AS j, covar_samp(v[a.i], v[b.i]) AS x FROM e, axis a, axis b GROUP BY ALL) GROUP BY i)),
  {_powers('one', 'cov')},
  less AS (SELECT list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - l * w[i] * w[j])) AS c FROM (
    SELECT c, w, list_dot_product(list_transform(c, lambda r: list_dot_product(r, w)), w) AS l FROM cov, one_axis)),
  {_powers('two', 'less')}
  SELECT vec_id, round(abs(list_dot_product(v, one_axis.w)), 6) AS x0, round(abs(list_dot_product(v, two_axis.w)), 6) AS x1 FROM e, one_axis, two_axis"""


@query("c1_reduce_dims", COMPONENTS_SQL)
def c1(t: Tables) -> DataFrame:
    reduced = clustering.reduce_dims(t.embeddings, k=2)
    return reduced.select("vec_id", *[F.round(F.abs(F.col("reduced")[i]), 6).alias(f"x{i}") for i in range(2)])


@query(
    "c1_component_checks",
    """SELECT * FROM (VALUES ('first', 1.0::DOUBLE), ('second', 1.0::DOUBLE), ('correlation', 0.0::DOUBLE), ('in order', 1.0::DOUBLE)) x(name, value)""",
)
def c1_checks(t: Tables) -> DataFrame:
    """What makes two projections principal components, whatever their sign.

    With x = w.v for a unit eigenvector w of the covariance C, cov(v, x) = C w = var(x) w: its length is var(x). Different
    components don't correlate, and the first has the larger variance.
    """
    reduced = clustering.reduce_dims(t.embeddings, k=2)
    xs = [F.col("reduced")[i] for i in range(2)]
    each = reduced.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], F.posexplode("embedding").alias("j", "v"))
    by_coordinate = each.groupBy("j").agg(*[F.covar_pop("v", f"x{i}").alias(f"c{i}") for i in range(2)])
    lengths = by_coordinate.agg(*[F.sqrt(F.sum(F.col(f"c{i}") ** 2)).alias(f"l{i}") for i in range(2)])
    plain = reduced.agg(*[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(xs)], F.corr(*xs).alias("r"))
    one = lengths.withColumn("k", F.lit(1)).join(plain.withColumn("k", F.lit(1)), "k")
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), (F.round(v, 6) + 0.0).alias("value"))
        for n, v in (
            ("first", F.col("l0") / F.col("v0")), ("second", F.col("l1") / F.col("v1")), ("correlation", F.abs(F.col("r"))),
            ("in order", (F.col("v0") >= F.col("v1")).cast("double")),
        )
    ])
    return one.select(F.inline(rows))


@query(
    "j11_eps_neighbours",
    f"""WITH p AS ({POINTS_SQL}) SELECT a.id AS query_id, b.id AS point_id FROM p a JOIN p b
        ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.02 * 0.02""",
)
def j11(t: Tables) -> DataFrame:
    grid = clustering._grid(_points(t), 0.02, "article_id", "reduced", 2, [])
    cells = grid.groupBy("cell").agg(F.count("*").alias("n"))
    return clustering.eps_neighbours(grid, grid, cells, 0.02, 2, [])


@query(
    "c2_density_cluster",
    f"""WITH RECURSIVE p AS ({POINTS_SQL}),
      near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.02 * 0.02),
      core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
      edge AS (SELECT a, b FROM near SEMI JOIN core c1 ON c1.id = a SEMI JOIN core c2 ON c2.id = b),
      reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
      lab AS (SELECT a AS id, min(b) AS label FROM reach GROUP BY a),
      kept AS (SELECT label FROM lab GROUP BY label HAVING count(*) >= 5)
      SELECT p.id AS article_id, CAST(CASE WHEN kept.label IS NULL THEN -1 ELSE lab.label END AS BIGINT) AS cluster
      FROM p LEFT JOIN lab ON lab.id = p.id LEFT JOIN kept ON kept.label = lab.label""",
)
def c2(t: Tables) -> DataFrame:
    return clustering.density_cluster(_points(t), 0.02, min_cluster_size=5, min_samples=4).select("article_id", "cluster")


@query("c3_min_cluster_size", "SELECT CAST(greatest(5, floor(count(*) * 0.01)) AS BIGINT) AS min_cluster_size FROM articles", ("articles",))
def c3(t: Tables) -> DataFrame:
    return clustering.min_cluster_size(t.articles)


def silhouette_sql(distance: str) -> str:
    return f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN -1 ELSE label END AS c, embedding::DOUBLE[] AS v FROM embeddings),
      d AS (SELECT a.vec_id, a.c, b.c AS o, sum({distance}) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
      ab AS (SELECT vec_id, max(CASE WHEN c = o THEN s / nullif(n - 1, 0) END) AS a, max(CASE WHEN c = o THEN n END) AS n,
                    min(CASE WHEN c <> o THEN s / n END) AS b FROM d GROUP BY vec_id)
      SELECT vec_id, round(CASE WHEN n <= 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END, 6) AS silhouette FROM ab"""


SQUARED = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _labelled(t: Tables) -> DataFrame:
    return t.embeddings.withColumn("cluster", F.when(F.col("vec_id") % 13 == 0, F.lit(-1)).otherwise(F.col("label")))


@query("c4_silhouette_euclidean", silhouette_sql(f"sqrt({SQUARED})"))
def c4_euclidean(t: Tables) -> DataFrame:
    scored = clustering.silhouette(_labelled(t), id_col="vec_id", rows_per_block=128)
    return scored.select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query("c4_silhouette_sqeuclidean", silhouette_sql(SQUARED))
def c4_squared(t: Tables) -> DataFrame:
    scored = clustering.silhouette(_labelled(t), id_col="vec_id", metric="sqeuclidean")
    return scored.select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query(
    "c5_news_events",
    INFO_SQL + """ SELECT *, CAST(row_number() OVER (PARTITION BY call_id ORDER BY 0.5 * size_importance + 0.3 * cohesiveness
        + (1 - time_variance) * (-0.2) DESC NULLS FIRST, cluster) AS INTEGER) AS rank FROM info QUALIFY rank <= 30""",
    ("clustered",),
)
def c5(t: Tables) -> DataFrame:
    """Flagship: the best described events of every call by combined health."""
    info = readable(news_events.describe_clusters(write_once(t.clustered, "clustered"), keys=KEYS))
    return windows.top_events(info, 30, tie="cluster").drop("score")


@query("c5_news_events_from_text")
def c5_text(t: Tables) -> DataFrame:
    """The whole run from raw articles: summaries, vectors, reduction, clusters, events."""
    config = news_events.EventConfig(eps=0.01)
    info = news_events.news_events(t.articles, config, run=("call_id",))
    return readable(info)


@query("c6_legacy_events")
def c6(t: Tables) -> DataFrame:
    """The older run for every call at once, from raw articles to its best clusters."""
    info = news_events.legacy_events(t.articles, news_events.EventConfig(eps=0.1), run=("call_id",))
    return info.select(
        "call_id", "cluster", F.round("health", 6).alias("health"), F.array_join("top_articles", ",").alias("top_articles"),
        F.size("top_themes").alias("n_themes"), F.date_format("median_date", "yyyy-MM-dd").alias("median_date"),
    )


SILHOUETTE_SQL = """WITH e AS (SELECT call_id, article_id, cluster AS c, embedding AS v, list_sum(list_transform(embedding, lambda x: x * x)) AS vv FROM clustered),
      u AS (SELECT call_id, c, i, sum(v[i]) AS s FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
      st AS (SELECT call_id, c, list(s ORDER BY i) AS s FROM u GROUP BY ALL),
      sz AS (SELECT call_id, c, count(*) AS n, sum(vv) AS q FROM e GROUP BY ALL),
      ok AS (SELECT call_id, (count(*) > 1 AND max(CAST(c = -1 AS INT)) = 1) OR (count(*) = 2 AND max(CAST(c = -1 AS INT)) = 0) AS allowed FROM sz GROUP BY call_id),
      d AS (SELECT e.call_id, e.article_id, e.c, sz.c AS o, sz.n, greatest(sz.n * e.vv - 2 * list_dot_product(e.v, st.s) + sz.q, 0) AS total
            FROM e JOIN sz ON sz.call_id = e.call_id JOIN st ON st.call_id = sz.call_id AND st.c = sz.c),
      ab AS (SELECT call_id, article_id, c, max(CASE WHEN c = o THEN total / nullif(n - 1, 0) END) AS a, max(CASE WHEN c = o THEN n END) AS n,
                    min(CASE WHEN c <> o THEN total / n END) AS b FROM d GROUP BY ALL),
      sil AS (SELECT call_id, article_id, c, CASE WHEN allowed THEN CASE WHEN n <= 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END END AS s
              FROM ab JOIN ok USING (call_id)),
      mean AS (SELECT call_id, c AS cluster, avg(s) AS m, count(*) AS size FROM sil GROUP BY ALL),
      ranked AS (SELECT *, m / nullif(max(m) OVER (PARTITION BY call_id), 0) AS rank, size / max(size) OVER (PARTITION BY call_id) AS norm_size FROM mean)"""


@query(
    "c6_legacy_choice",
    SILHOUETTE_SQL + """ SELECT call_id, cluster, round(rank, 6) AS health, round(norm_size, 6) AS norm_size FROM (
        SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY rank DESC NULLS LAST, cluster) AS place FROM ranked)
      WHERE place <= 3 AND rank > 0 AND cluster <> -1""",
    ("clustered",),
)
def c6_choice(t: Tables) -> DataFrame:
    """The older run's choice among given clusters: silhouettes, ranks and the best three of every call."""
    info = news_events.legacy_choice(t.clustered, news_events.EventConfig(top_n=3), ["call_id"])
    return info.select("call_id", "cluster", F.round("health", 6).alias("health"), F.round("norm_size", 6).alias("norm_size"))


@query(
    "c5_company_run",
    """WITH fetched AS (SELECT *, CASE WHEN article_id % 17 = 0 THEN concat('x', DATE) ELSE DATE END AS written FROM articles
        WHERE date_trunc('month', partition_date) >= TIMESTAMP '2001-08-01' - INTERVAL 700 DAY AND contains(lower(V2Organizations), 'brand#2'))
      SELECT 'quarantined' AS kind, article_id FROM fetched WHERE article_id % 17 = 0 UNION ALL SELECT 'call', 77""",
    ("articles",),
)
def c5_run(t: Tables) -> DataFrame:
    """One company's call from stored articles to stored events and quarantined articles; events may only hold good rows."""
    folder = shared_folder(t.spark, "company-run")
    bad = F.when(F.col("article_id") % 17 == 0, F.concat(F.lit("x"), "DATE")).otherwise(F.col("DATE"))
    # One folder a month, so that small tables don't fall into thousands of files.
    month = F.trunc("partition_date", "month")
    write_articles(t.articles.withColumn("DATE", bad).withColumn("partition_date", month), f"{folder}/articles")
    events, rejected = news_events.company_run(
        t.spark, f"{folder}/articles", f"{folder}/store", "Brand#2", 77, 5, dt.datetime(2001, 8, 1), news_events.EventConfig(interval=700, eps=0.01)
    )
    links = events.select(F.explode(F.split("top_articles", ",")).alias("url"))
    unread = rejected.select(F.col("DocumentIdentifier").alias("url"))
    wrong = links.join(unread, "url").select(F.lit("taken").alias("kind"), F.lit(-1).cast("long").alias("article_id"))
    quarantined = rejected.select(F.lit("quarantined").alias("kind"), "article_id")
    calls = read_calls(t.spark, f"{folder}/store").select(F.lit("call").alias("kind"), F.col("call_id").alias("article_id"))
    return quarantined.unionByName(calls).unionByName(wrong)


ONE_RUN_SQL = "WITH one_run AS (SELECT * REPLACE (CAST(77 AS BIGINT) AS call_id) FROM clustered), " + INFO_SQL.strip()[5:].replace(
    "clustered", "one_run"
) + ", means AS (SELECT cluster, round(sum(i * a), 6) AS mean_sum, round(sum(a * a), 6) AS mean_square FROM (SELECT cluster, i, avg(embedding[i]) AS a FROM one_run, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY cluster)"


@query(
    "s3_write_events",
    ONE_RUN_SQL + """ SELECT concat(call_id, '-', cluster) AS event_id, call_id, cluster AS cluster_id, top_articles, top_themes, top_persons,
        top_orgs, top_locs, FALSE AS irrelevant, size_importance, cohesiveness, time_variance, median_date, 7 AS event_window, 5 AS stock_id,
        mean_sum, mean_square FROM info JOIN means USING (cluster)""",
    ("clustered",),
)
def s3(t: Tables) -> DataFrame:
    """The call and its events are written twice and read back."""
    path, info = shared_folder(t.spark, "events"), cut_lineage(cluster_info(write_once(t.clustered, "clustered")))
    call = call_row(t.spark, 77, 5, dt.datetime(2001, 8, 1), 7, 10, {})
    for _ in range(2):
        write_events(info, call, path)
    rows = read_events(t.spark, path, 77).join(read_calls(t.spark, path).select("call_id"), "call_id")
    return rows.select(
        "event_id", "call_id", "cluster_id", "top_articles", "top_themes", "top_persons", "top_orgs", "top_locs", "irrelevant",
        *[F.round(F.col("cluster_health")[i], 6).alias(n) for i, n in enumerate(("size_importance", "cohesiveness", "time_variance"))],
        F.col("event_window"), F.col("stock_id"),
        # All coordinates of the mean vector: their weighted sum and their squares.
        F.round(F.aggregate(F.transform("mean_embedding", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("mean_sum"),
        F.round(F.aggregate("mean_embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("mean_square"),
        F.date_format("median_date", "yyyy-MM-dd HH:mm:ss").alias("median_date"),
    )


# -- statements ------------------------------------------------------------------------------


def _facts(t: Tables) -> DataFrame:
    return t.facts.withColumn("pos", F.struct("rank_key", "price_key", "l_suppkey"))


def statement_sql(name: str, period: str, value: str) -> str:
    return f"""SELECT '{name}' AS statement, i.accessionNo, i.item, f.period, f.value, CAST(f.value AS DOUBLE) AS amount FROM
      (SELECT DISTINCT accessionNo, item FROM facts WHERE statement = '{name}') i LEFT JOIN
      (SELECT accessionNo, item, {period} AS period, {value} AS value FROM facts WHERE statement = '{name}' AND segment IS NULL AND {period} IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY accessionNo, item, {period} ORDER BY rank_key, price_key, l_suppkey) = 1) f
      ON f.accessionNo = i.accessionNo AND f.item = i.item"""


RANGE_SQL = "concat(startDate, '-', endDate)"
INCOME_SQL = statement_sql("StatementsOfIncome", RANGE_SQL, "value")
BALANCE_SQL = statement_sql("BalanceSheets", "instant", "coalesce(value, '0')")
CASH_SQL = statement_sql("StatementsOfCashFlows", f"coalesce(instant, {RANGE_SQL})", "coalesce(value, '0')")
BY = ("accessionNo",)


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", F.col("amount").cast("double"))


@query("x1_income_statement", INCOME_SQL, ("facts",))
def x1(t: Tables) -> DataFrame:
    return _plain(statements.income_statement(_facts(t), BY)).withColumn("statement", F.lit(statements.INCOME))


@query("x2_balance_sheet", BALANCE_SQL, ("facts",))
def x2(t: Tables) -> DataFrame:
    return _plain(statements.balance_sheet(_facts(t), BY)).withColumn("statement", F.lit(statements.BALANCE))


@query("x3_cash_flow", CASH_SQL, ("facts",))
def x3(t: Tables) -> DataFrame:
    return _plain(statements.cash_flow(_facts(t), BY)).withColumn("statement", F.lit(statements.CASH_FLOW))


# Every year in which lines are shipped.
PERIODS = {f"y{y}": f"{y}-01-01-{y}-12-31" for y in range(1995, 2002)}


@query(
    "x1_income_pivot",
    f"WITH l AS ({INCOME_SQL}) SELECT accessionNo, item"
    + "".join(f", max(CASE WHEN period = '{p}' THEN value END) AS {n}" for n, p in PERIODS.items()) + " FROM l GROUP BY ALL",
    ("facts",),
)
def x1_pivot(t: Tables) -> DataFrame:
    wide = statements.statement_table(statements.income_statement(_facts(t), BY), list(PERIODS.values()), BY)
    return wide.withColumnsRenamed({p: n for n, p in PERIODS.items()})


@query(
    "x4_statements_of_latest_filing",
    f"""WITH newest AS (SELECT ticker, accessionNo FROM filings WHERE formType = '10-K'
            QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filedAt DESC, accessionNo DESC) = 1),
        every AS ({INCOME_SQL} UNION ALL {BALANCE_SQL} UNION ALL {CASH_SQL})
        SELECT ticker, every.* FROM every JOIN newest USING (accessionNo)""",
    ("facts", "filings"),
)
def x4(t: Tables) -> DataFrame:
    return _plain(statements.statements_of_latest_filing(t.filings, _facts(t)))


# -- graph -----------------------------------------------------------------------------------

# One relation row per supplied part type of a supplier; a few suppliers are themselves entities.
RELATIONS = """SELECT l_suppkey * 10000000 + l_orderkey AS seq, s_name AS stock, p_brand AS entity, max(p_type) AS description
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY l_suppkey, l_orderkey, s_name, p_brand
  UNION ALL SELECT 900000000000 + s_suppkey, s_name, concat('Supplier#', substr(s_name, 10)), 'itself' FROM supplier"""

GRAPH_SQL = f"""WITH rel AS ({RELATIONS}),
  edges AS (SELECT least(stock, entity) AS src, greatest(stock, entity) AS dst, arg_max(description, (seq, description)) AS description FROM rel GROUP BY ALL),
  marks AS (SELECT stock AS node, 'stock' AS type, seq * 2 AS pos FROM rel UNION ALL SELECT entity, 'entity', seq * 2 + 1 FROM rel),
  nodes AS (SELECT node, arg_max(type, pos) AS type FROM marks GROUP BY node)"""


def _relations(t: Tables) -> DataFrame:
    rows = t.sql(RELATIONS)
    return rows.select("seq", "stock", F.create_map("entity", "description").alias("entities"))


@query(
    "g1_build_graph",
    GRAPH_SQL + " SELECT 'edge' AS kind, src AS a, dst AS b, description FROM edges UNION ALL SELECT 'node', node, type, NULL FROM nodes",
)
def g1(t: Tables) -> DataFrame:
    nodes, edges = graph.build_graph(_relations(t))
    return edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "description").unionByName(
        nodes.select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.col("type").alias("b"), F.lit(None).cast("string").alias("description"))
    )


@query(
    "g2_degree_centrality",
    GRAPH_SQL + """, deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node)
      SELECT node, type, degree, round(centrality, 6) AS centrality FROM (
        SELECT node, type, coalesce(degree, 0) AS degree, coalesce(degree, 0) / ((SELECT count(*) FROM nodes) - 1) AS centrality
        FROM nodes LEFT JOIN deg USING (node)) WHERE centrality >= 0.1""",
)
def g2(t: Tables) -> DataFrame:
    nodes, edges = graph.build_graph(_relations(t))
    scored = graph.degree_centrality(nodes, edges, 0.1)
    return scored.withColumn("centrality", F.round("centrality", 6))


# -- model calls and rate audits -------------------------------------------------------------


def _count_letters(texts: list[str]) -> list[str]:
    return [str(len(t)) for t in texts]


@query("u1_map_with_model", "SELECT doc_id, CAST(length(text) AS VARCHAR) AS answer FROM documents")
def u1(t: Tables) -> DataFrame:
    asked = map_with_model(t.documents.select("doc_id", "text"), "text", "answer", _count_letters)
    return asked.select("doc_id", "answer")


RATE_SQL = """SELECT user_id, strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M:%S') AS window_start, '{per}' AS per, count(*) AS requests
  FROM events GROUP BY user_id, date_trunc('{unit}', ts) HAVING count(*) > {limit}"""
LIMITS = (("1 minute", 1), ("1 day", 4))
RATES_SQL = RATE_SQL.format(unit="minute", per="1 minute", limit=1) + " UNION ALL " + RATE_SQL.format(unit="day", per="1 day", limit=4)


@query("st1_rate_limit_audit", RATES_SQL)
def st1(t: Tables) -> DataFrame:
    found = rate_limit.rate_limit_audit(t.events, LIMITS)
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("st2_incremental_events", "SELECT doc_id AS event_id, length(text) AS n_chars FROM documents WHERE lang <> 'fr'")
def st2(t: Tables) -> DataFrame:
    """Documents arrive as files, in three batches with repeats; the stream is started again, and then by another run.

    French documents count as flagged.
    """
    folder = shared_folder(t.spark, "st2")
    events = t.documents.select(F.col("doc_id").alias("event_id"), "text", (F.col("lang") == "fr").alias("irrelevant"))

    def process(new: DataFrame) -> DataFrame:
        return new.select("event_id", F.length("text").alias("n_chars"))

    def run(marks: str) -> None:
        arrivals = incremental.read_arrivals(t.spark, f"{folder}/in", events.schema)
        job = incremental.incremental_events(arrivals, process, f"{folder}/out", f"{folder}/{marks}").trigger(availableNow=True).start()
        job.awaitTermination()

    for part in (events.where("event_id % 3 = 0"), events.where("event_id % 3 < 2"), events):
        part.write.mode("append").parquet(f"{folder}/in")
        run("one")
    run("two")
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "n_chars")
