"""Text cleaning, chunking, retrieval, event processing and alert digests."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.checks.fixtures import Tables
from tidemark.checks.registry import query
from tidemark.checks.scalars import HTML_SQL, question_rows_sql
from tidemark.operators import chunking, prompts, retrieval
from tidemark.operators.ordering import concat_in_order
from tidemark.plans import event_processing as processing
from tidemark.plans import filings_qa
from tidemark.session import write_once

SIZE, OVERLAP = 500, 50
ONES = [1.0] * 64
ONES_SQL = "list_transform(range(0, 64), lambda x: 1.0::DOUBLE)"


def template_sql(template: str, **columns: str) -> str:
    """A prompt template as an SQL expression; NULL when an argument is NULL."""
    text = "'" + template.replace("'", "''") + "'"
    for name, column in columns.items():
        text = text.replace("{" + name + "}", f"' || {column} || '")
    return "(" + text + ")"


# -- cleaning and chunking -------------------------------------------------------------------


@query(
    "t1_clean_doc",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(text, chr(10), '\n'), '\n', chr(10)), '#[0-9]+', '', 'g'),
         '[^a-zA-Z0-9 .,\n]', '', 'g')) AS digest FROM documents""",
)
def t1(t: Tables) -> DataFrame:
    escaped = F.replace("text", F.lit("\n"), F.lit("\\n"))
    return t.documents.select("doc_id", F.md5(chunking.clean_doc(escaped)).alias("digest"))


CHUNKS_SQL = f"""SELECT section_no, ticker, filing_type, filing_date, filing_section, filing_description, CAST(i AS INTEGER) AS chunk_index,
    substring(text, i * {SIZE - OVERLAP} + 1, {SIZE}) AS original_content
  FROM (SELECT *, unnest(range(0, CAST(floor(greatest(length(text) - {OVERLAP} - 1, 0) / {SIZE - OVERLAP}) AS BIGINT) + 1)) AS i FROM sections WHERE length(text) > 0)"""
INDEX_SQL = f"""SELECT *, sha256(concat(ticker, '|', filing_type, '|', filing_date, '|', filing_section, '|', filing_description, '|', chunk_index, '|', original_content)) AS doc_id
  FROM ({CHUNKS_SQL})"""


@query("t2_chunk_chars", f"SELECT section_no, chunk_index, original_content AS content FROM ({CHUNKS_SQL})", ("sections",))
def t2(t: Tables) -> DataFrame:
    return chunking.chunk_chars(t.sections.select("section_no", "text"), "text", SIZE, OVERLAP)


@query("t2_chunk_by_separator", "SELECT doc_id, md5(text) AS digest, TRUE AS in_bounds FROM documents WHERE text <> ''")
def t2_separator(t: Tables) -> DataFrame:
    chunks = write_once(chunking.chunk_text(t.documents.select("doc_id", "text"), "text", SIZE), "chunks")
    bounds = chunks.groupBy("doc_id").agg((F.max(F.length("content")) <= SIZE).alias("in_bounds"))
    # Chunks put together again are the text.
    whole = concat_in_order(chunks, ["doc_id"], "chunk_index", F.col("content"), "whole", part_size=1_000_000)
    return whole.join(bounds, "doc_id").select("doc_id", F.md5("whole").alias("digest"), "in_bounds")


TOKENS_SQL = "list_filter(string_split_regex({}, '[ \\t\\r\\n\\f]+'), lambda x: x <> '')"


def token_chunks_sql(source: str, text: str, keep: str, size: int) -> str:
    return f"""SELECT {keep}, CAST(i AS INTEGER) AS chunk_index, array_to_string(tok[i * {size} + 1 : (i + 1) * {size}], ' ') AS content
      FROM (SELECT *, unnest(range(0, CAST(ceil(len(tok) / {size}) AS BIGINT))) AS i FROM (SELECT {keep}, {TOKENS_SQL.format(text)} AS tok FROM {source}))"""


@query("t4_chunk_tokens", token_chunks_sql("documents", "text", "doc_id", 100))
def t4(t: Tables) -> DataFrame:
    return chunking.chunk_tokens(t.documents.select("doc_id", "text"), "text", 100)


# -- index and retrieval ---------------------------------------------------------------------


def _given_vectors(df: DataFrame, t: Tables, number) -> DataFrame:
    """Vector of each row taken from the embeddings table by a row number."""
    vectors = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = t.embeddings.agg(F.count("*")).scalar()
    return df.withColumn("_number", number).withColumn("vec_id", F.col("_number") % n).join(vectors, "vec_id").drop("vec_id", "_number")


def _index(t: Tables) -> DataFrame:
    indexed = retrieval.index_sections(t.sections, size=SIZE, overlap=OVERLAP).drop("embedding")
    return _given_vectors(indexed, t, F.col("section_no") + F.col("chunk_index"))


def _questions(t: Tables, bank: DataFrame) -> DataFrame:
    number = F.col("question_no") * 17 + F.length("ticker")
    numbered = bank.withColumn("query_id", F.concat_ws("#", "ticker", "question_no"))
    return _given_vectors(numbered, t, number.cast("long"))


def hits_sql(questions: dict[str, str]) -> str:
    return f"""q AS (SELECT x.*, concat(ticker, '#', question_no) AS query_id, embedding::DOUBLE[] AS v FROM
        (SELECT *, (question_no * 17 + length(ticker)) % (SELECT count(*) FROM embeddings) AS k FROM ({question_rows_sql('SELECT DISTINCT source AS ticker FROM documents', questions)})) x
        JOIN embeddings ON vec_id = k),
      c AS (SELECT x.*, embedding::DOUBLE[] AS v FROM (SELECT *, (section_no + chunk_index) % (SELECT count(*) FROM embeddings) AS k FROM ({INDEX_SQL})) x
        JOIN embeddings ON vec_id = k),
      hit AS (SELECT * FROM (SELECT q.query_id, q.question, q.ticker, q.topic, q.question_no, c.doc_id, c.original_content AS page_content, c.filing_section AS source,
          d AS distance, row_number() OVER (PARTITION BY q.query_id ORDER BY d, c.doc_id) AS rank
        FROM q JOIN c ON c.ticker = q.ticker AND c.filing_type = 'en', LATERAL (SELECT round(list_sum(list_transform(list_zip(q.v, c.v),
          lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d)) WHERE rank <= 5)"""


@query(
    "r1_index_sections",
    f"SELECT doc_id, ticker, filing_type, filing_section, chunk_index, original_content AS content, original_content FROM ({INDEX_SQL})",
    ("sections",),
)
def r1(t: Tables) -> DataFrame:
    indexed = retrieval.index_sections(t.sections, size=SIZE, overlap=OVERLAP)
    return indexed.select("doc_id", "ticker", "filing_type", "filing_section", "chunk_index", "content", "original_content")


@query(
    "r2_retrieve",
    f"WITH {hits_sql(prompts.COMPANY_QUESTIONS)} SELECT query_id, doc_id, rank, round(distance, 6) AS distance, page_content, source FROM hit",
    ("sections",),
)
def r2(t: Tables) -> DataFrame:
    asked = _questions(t, retrieval.question_bank(t.sections))
    hits = retrieval.retrieve(asked, _index(t), 5, ["ticker"], {"filing_type": "en"})
    return hits.withColumn("distance", F.round("distance", 6))


def answers_sql(questions: dict[str, str], question_prompt: str, combine_prompt: str = prompts.COMBINE_PROMPT, with_sources: bool = False) -> str:
    part = template_sql(question_prompt, context="page_content", question="question")
    if with_sources:
        part = f"'Content: ' || {part} || chr(10) || 'Source: ' || source"
    combined = template_sql(combine_prompt, summaries="s", question="question")
    return f"""WITH {hits_sql(questions)},
      s AS (SELECT query_id, ticker, topic, question_no, question, string_agg({part}, chr(10) || chr(10) ORDER BY rank) AS s FROM hit GROUP BY ALL),
      a AS (SELECT query_id, ticker, topic, question_no, question, {combined} AS answer FROM s)"""


@query(
    "r3_answer_inputs",
    answers_sql(prompts.COMPANY_QUESTIONS, prompts.QUESTION_PROMPT) + " SELECT query_id, question, md5(answer) AS digest FROM a",
    ("sections",),
)
def r3(t: Tables) -> DataFrame:
    asked = _questions(t, retrieval.question_bank(t.sections))
    hits = retrieval.retrieve(asked, _index(t), 5, ["ticker"], {"filing_type": "en"})
    return retrieval.answer_inputs(asked, hits).select("query_id", "question", F.md5("answer").alias("digest"))


@query(
    "r3_answers_with_sources",
    answers_sql(prompts.COMPANY_QUESTIONS, prompts.QUESTION_PROMPT, prompts.CHAT_COMBINE_PROMPT, True) + " SELECT query_id, question, md5(answer) AS digest FROM a",
    ("sections",),
)
def r3_sources(t: Tables) -> DataFrame:
    asked = _questions(t, retrieval.question_bank(t.sections))
    hits = retrieval.retrieve(asked, _index(t), 5, ["ticker"], {"filing_type": "en"})
    made = retrieval.answer_inputs(asked, hits, combine_prompt=prompts.CHAT_COMBINE_PROMPT, with_sources=True)
    return made.select("query_id", "question", F.md5("answer").alias("digest"))


def _answered(t: Tables, bank: DataFrame, template: str) -> DataFrame:
    asked = _questions(t, bank)
    hits = retrieval.retrieve(asked, _index(t), 5, ["ticker"], {"filing_type": "en"})
    answers = retrieval.answer_inputs(asked, hits, question_prompt=template).select("query_id", F.col("answer").alias("result"))
    long_form = asked.select("query_id", "ticker", "question_no", "topic", F.col("question").alias("query")).join(answers, "query_id")
    filed = filings_qa.processed_filings(long_form)
    entries = filed.select("ticker", F.explode("processed_data").alias("topic", "entry"))
    return entries.select("ticker", "topic", F.col("entry.query").alias("query"), F.md5("entry.result").alias("digest"))


@query(
    "r4_question_bank",
    answers_sql(prompts.COMPANY_QUESTIONS, prompts.QUESTION_PROMPT) + " SELECT ticker, topic, question AS query, md5(answer) AS digest FROM a",
    ("sections",),
)
def r4(t: Tables) -> DataFrame:
    return _answered(t, retrieval.question_bank(t.sections), prompts.QUESTION_PROMPT)


@query(
    "r5_entity_questions",
    answers_sql(prompts.ENTITY_QUESTIONS, prompts.ENTITY_QUESTION_PROMPT) + " SELECT ticker, topic, question AS query, md5(answer) AS digest FROM a",
    ("sections",),
)
def r5(t: Tables) -> DataFrame:
    return _answered(t, retrieval.entity_questions(t.sections), prompts.ENTITY_QUESTION_PROMPT)


@query("r4_answer_bank_from_text")
def r4_text(t: Tables) -> DataFrame:
    """The bank over the default text vectors, from filings to answers."""
    chunks = retrieval.index_sections(t.sections)
    answers = filings_qa.answer_bank(t.sections.select("ticker").distinct(), chunks, filing_type="en")
    return answers.select("ticker", "topic", "query", F.length("result").alias("n_chars"))


# -- event processing ------------------------------------------------------------------------

PAGE_TOKENS = 200


def _linked_events(t: Tables) -> DataFrame:
    """Customers as events with two linked pages each; the segment is the company."""
    n = t.pages.agg(F.count("*")).scalar()
    pages = t.pages.select("page_id", "url")
    rows = t.customer.select(
        F.col("c_custkey").alias("event_id"), F.col("c_mktsegment").alias("company"),
        (F.col("c_custkey") % n).alias("p1"), ((F.col("c_custkey") * 7 + 3) % n).alias("p2"),
    )
    first = rows.join(pages.withColumnsRenamed({"page_id": "p1", "url": "u1"}), "p1")
    both = first.join(pages.withColumnsRenamed({"page_id": "p2", "url": "u2"}), "p2")
    # Commas separate links, so they are escaped inside a link.
    links = F.concat(F.replace("u1", F.lit(","), F.lit("%2C")), F.lit(","), F.replace("u2", F.lit(","), F.lit("%2C")))
    return both.select("event_id", "company", links.alias("top_articles"))


def summaries_sql() -> str:
    part = template_sql(prompts.ARTICLE_PART_PROMPT, company="company", docs="content")
    reduced = template_sql(prompts.ARTICLE_REDUCE_PROMPT, company="company", docs="docs")
    event = template_sql(prompts.EVENT_PROMPT, company="company", docs="docs")
    chunks = token_chunks_sql("page", "page_text", "page_id", PAGE_TOKENS)
    return f"""WITH page AS (SELECT page_id, {HTML_SQL} AS page_text FROM pages),
      chunk AS ({chunks}),
      link AS (SELECT c_custkey AS event_id, c_mktsegment AS company, 0 AS link_no, c_custkey % (SELECT count(*) FROM pages) AS page_id FROM customer
        UNION ALL SELECT c_custkey, c_mktsegment, 1, (c_custkey * 7 + 3) % (SELECT count(*) FROM pages) FROM customer),
      perpage AS (SELECT page_id, company, {reduced} AS summary FROM (
        SELECT page_id, company, string_agg({part}, chr(10) || chr(10) ORDER BY chunk_index) AS docs
        FROM chunk JOIN (SELECT DISTINCT page_id, company FROM link) USING (page_id) GROUP BY ALL)),
      perevent AS (SELECT event_id, company, string_agg(coalesce(summary, 'Error in loading doc'), chr(10) || chr(10) ORDER BY link_no) AS docs
        FROM link LEFT JOIN perpage USING (page_id, company) GROUP BY ALL)
      SELECT event_id, company, md5({event}) AS digest FROM perevent"""


@query("r6_summarize_articles", summaries_sql())
def r6(t: Tables) -> DataFrame:
    pages = t.pages.withColumn("url", F.replace("url", F.lit(","), F.lit("%2C")))
    made = processing.summarize_articles(_linked_events(t), pages, chunk_size=PAGE_TOKENS)
    return made.select("event_id", "company", F.md5("summary").alias("digest"))


def _events(t: Tables) -> DataFrame:
    """Documents as events: flag from the toxic label, rank by length."""
    flags = t.labels.select("doc_id", (F.col("toxic") == 1).alias("irrelevant"))
    return t.documents.select("doc_id", F.col("n_chars").alias("rank")).join(flags, "doc_id", "left").withColumnRenamed("doc_id", "event_id")


def _processed(t: Tables) -> DataFrame:
    """Documents of good quality count as processed before."""
    done = t.labels.where("quality = 1").join(t.documents.select("doc_id", "lang"), "doc_id")
    rows = done.select(
        F.col("doc_id").cast("string").alias("processed_id"), F.col("doc_id").alias("event_id"), F.col("lang").alias("summary"),
        F.col("doc_id").alias("_k"),
    )
    return _given_vectors(rows, t, F.col("_k")).drop("_k").withColumnRenamed("embedding", "summary_embedding")


def _summaries(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("event_id"), F.col("source").alias("summary"))
    return _given_vectors(rows, t, F.col("event_id")).withColumnRenamed("embedding", "summary_embedding")


PROCESS_SQL = f"""WITH ev AS (SELECT d.doc_id, d.n_chars, d.lang, d.source, coalesce(l.toxic = 1, FALSE) AS off, coalesce(l.quality = 1, FALSE) AS done,
      list_cosine_similarity(e.embedding::DOUBLE[], {ONES_SQL}) AS s, e.embedding::DOUBLE[] AS v
    FROM (SELECT *, doc_id % (SELECT count(*) FROM embeddings) AS k FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN embeddings e ON e.vec_id = d.k),
  fin AS (SELECT *, off OR (NOT done AND NOT off AND s > 0.05) AS off2, done OR (NOT off AND s <= 0.05) AS done2 FROM ev)"""


@query(
    "r7_process_events",
    PROCESS_SQL + """ SELECT 'flag' AS kind, doc_id AS event_id, CAST(off2 AS VARCHAR) AS value FROM fin
      UNION ALL SELECT 'processed', doc_id, CASE WHEN done THEN lang ELSE source END FROM fin WHERE done2
      UNION ALL SELECT 'order', doc_id, CAST(n_chars AS VARCHAR) FROM fin WHERE done2""",
)
def r7(t: Tables) -> DataFrame:
    everything, flagged, in_order = processing.process_events(_events(t), _processed(t), _summaries(t), ONES, 0.05)
    parts = [
        flagged.select(F.lit("flag").alias("kind"), "event_id", F.col("irrelevant").cast("string").alias("value")),
        everything.select(F.lit("processed").alias("kind"), "event_id", F.col("summary").alias("value")),
        in_order.select(F.lit("order").alias("kind"), "event_id", F.col("rank").cast("string").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DIGEST_BLOCK = "concat(' ' || chr(10) || '        Summary: \"', {}, '\" ' || chr(10))"


@query(
    "r8_rank_for_interest",
    PROCESS_SQL + f""", best AS (SELECT *, row_number() OVER (ORDER BY list_cosine_similarity(v, list_reverse({ONES_SQL}).list_transform(lambda x, i: 1.0 / i)) DESC, doc_id) AS rank
        FROM fin WHERE done2),
      dig AS (SELECT 'Acme' AS company, 'supply' AS context, string_agg({DIGEST_BLOCK.format('CASE WHEN done THEN lang ELSE source END')}, '' ORDER BY rank) AS events FROM best WHERE rank <= 30)
      SELECT company, {template_sql(prompts.ANALYST_ROLE, company='company')} AS system, {template_sql(prompts.RELEVANCE_PROMPT, context='context', events='events')} AS prompt FROM dig""",
)
def r8(t: Tables) -> DataFrame:
    _, _, in_order = processing.process_events(_events(t), _processed(t), _summaries(t), ONES, 0.05)
    wanted = F.lit([1.0 / i for i in range(1, 65)]).cast("array<double>")
    return processing.rank_for_interest(in_order, "Acme", "supply", wanted, 30).select("company", "system", "prompt")


# Events of brands: every document is an event of one brand and one call per language.
BRAND_EVENTS = """SELECT doc_id AS event_id, concat('Brand#', CAST(doc_id % 25 + 1 AS {string})) AS stock_id, lang AS call_id,
    CAST(n_chars AS DOUBLE) / 50000 AS size_importance, CAST(doc_id % 7 AS DOUBLE) / 7 AS cohesiveness, CAST(doc_id % 5 AS DOUBLE) / 5 AS time_variance
  FROM documents"""


def _alert_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    events = t.sql(BRAND_EVENTS.replace("{string}", "STRING"))
    day = F.when(F.col("call_id") == "en", 4).when(F.col("call_id") == "fr", 3).when(F.col("call_id") == "es", 2).otherwise(1)
    calls = events.select("stock_id", "call_id").distinct().withColumn("call_time", F.make_timestamp_ntz(F.lit(2024), F.lit(1), day, F.lit(0), F.lit(0), F.lit(0)))
    rows = t.documents.select(
        F.col("doc_id").alias("event_id"), F.col("doc_id").cast("string").alias("processed_id"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("summary"),
    )
    processed = _given_vectors(rows, t, F.col("event_id")).withColumnRenamed("embedding", "summary_embedding")
    brand = t.part.select(F.col("p_partkey").alias("stock_id"), F.col("p_brand").alias("brand"))
    t.write("alert_stocks")
    mine = t.alert_stocks.select("user_id", "alert_stock_id", "stock_id").join(brand, "stock_id").drop("stock_id")
    wanted = mine.join(t.areas, "alert_stock_id").select(
        F.col("area_id").alias("interest_id"), "user_id", "alert_stock_id", F.col("brand").alias("stock_id"), F.col("brand").alias("stock"),
        "area_id", F.col("description").alias("area"),
    )
    # Written without vectors: they are added where the rows lie.
    wanted = write_once(wanted, "interests")
    interests = _given_vectors(wanted, t, F.col("area_id")).withColumnRenamed("embedding", "interest_embedding")
    return interests, calls, events, processed


ALERTS_SQL = f"""WITH ev AS ({BRAND_EVENTS.replace('{string}', 'VARCHAR')}),
  newest AS (SELECT stock_id, max_by(call_id, CASE call_id WHEN 'en' THEN 4 WHEN 'fr' THEN 3 WHEN 'es' THEN 2 ELSE 1 END) AS call_id FROM ev GROUP BY stock_id),
  best AS (SELECT * FROM (SELECT ev.*, row_number() OVER (PARTITION BY ev.stock_id, ev.call_id ORDER BY 0.5 * size_importance + 0.3 * cohesiveness + (1 - time_variance) * (-0.2) DESC, event_id) AS hr
     FROM ev JOIN newest USING (stock_id, call_id)) WHERE hr <= 30),
  pe AS (SELECT best.*, concat('doc ', event_id) AS summary, embedding::DOUBLE[] AS v FROM (SELECT *, event_id % (SELECT count(*) FROM embeddings) AS k FROM best) best JOIN embeddings ON vec_id = k),
  it AS (SELECT x.* FROM (SELECT a.area_id, s.user_id, s.alert_stock_id, p_brand AS stock, a.description AS area, a.area_id % (SELECT count(*) FROM embeddings) AS k
     FROM areas a JOIN alert_stocks s ON s.alert_stock_id = a.alert_stock_id JOIN part ON p_partkey = s.stock_id) x),
  need AS (SELECT DISTINCT k, stock FROM it),
  sims AS (SELECT need.k, need.stock, pe.summary, row_number() OVER (PARTITION BY need.k, need.stock ORDER BY round(1 - list_cosine_similarity(e.embedding::DOUBLE[], pe.v), 9), pe.event_id) AS r
    FROM need JOIN embeddings e ON e.vec_id = need.k JOIN pe ON pe.stock_id = need.stock),
  digs AS (SELECT k, stock, string_agg({DIGEST_BLOCK.format('summary')}, '' ORDER BY r) AS digest FROM sims WHERE r <= 30 GROUP BY k, stock),
  dig AS (SELECT area_id, digest FROM it JOIN digs USING (k, stock)),
  an AS (SELECT it.user_id, it.alert_stock_id, it.stock, it.area_id, {template_sql(prompts.RELEVANCE_PROMPT, context='area', events="coalesce(digest, '')")} AS analysis
     FROM it LEFT JOIN dig USING (area_id))"""


@query("r9_alert_analysis", ALERTS_SQL + " SELECT user_id, alert_stock_id, stock, area_id, md5(analysis) AS digest FROM an", ("alert_stocks", "areas"))
def r9(t: Tables) -> DataFrame:
    made = processing.alert_analyses(*_alert_inputs(t))
    return made.select("user_id", "alert_stock_id", "stock", "area_id", F.md5("analysis").alias("digest"))


@query(
    "r9_alert_mails",
    ALERTS_SQL + """, per AS (SELECT user_id, alert_stock_id, concat(stock, chr(10), string_agg(analysis || chr(10), '' ORDER BY area_id)) AS txt FROM an GROUP BY user_id, alert_stock_id, stock)
      SELECT user_id, CAST(0 AS BIGINT) AS part, md5(string_agg(txt, chr(10) ORDER BY alert_stock_id)) AS digest FROM per GROUP BY user_id""",
    ("alert_stocks", "areas"),
)
def r9_mails(t: Tables) -> DataFrame:
    interests, calls, events, processed = _alert_inputs(t)
    made = processing.alert_analyses(interests, calls, events, processed)
    mails = processing.alert_mails(made, interests.select("user_id", "alert_stock_id", "stock").distinct())
    return mails.withColumn("digest", F.md5("digest"))


# One day of alerts: customers are events of their market segment, each nation follows one segment.
DAY_EVENTS = """SELECT c_custkey AS event_id, c_mktsegment AS stock_id, CASE WHEN c_custkey % 3 = 0 THEN 'early' ELSE 'late' END AS call_id,
    CAST(c_custkey * 37 % 1009 AS DOUBLE) / 1009 AS size_importance, CAST(c_custkey % 7 AS DOUBLE) / 7 AS cohesiveness,
    CAST(c_custkey % 5 AS DOUBLE) / 5 AS time_variance, c_custkey % 13 = 0 AS irrelevant, c_custkey % 11 = 0 AS done FROM customer"""
DAY_INTERESTS = """SELECT n_nationkey AS area_id, n_regionkey AS user_id, n_nationkey AS alert_stock_id, n_name AS area, n_nationkey % 5 AS k FROM nation"""


def _lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model that SQL can compute as well."""
    return [[float(len(t) % 97), float(len(t) % 89), 1.0] for t in texts]


def daily_sql() -> str:
    summaries = summaries_sql()
    summaries = summaries[: summaries.rindex("SELECT event_id, company, md5(")]
    event = template_sql(prompts.EVENT_PROMPT, company="company", docs="docs")
    angle = "list_cosine_similarity({}, {})"
    return summaries + f""", made AS (SELECT event_id, {event} AS summary FROM perevent),
      ev AS ({DAY_EVENTS}),
      best AS (SELECT * FROM ev WHERE call_id = 'late' AND stock_id <> 'MACHINERY' QUALIFY row_number() OVER (PARTITION BY stock_id
        ORDER BY 0.5 * size_importance + 0.3 * cohesiveness + (1 - time_variance) * (-0.2) DESC, event_id) <= 30),
      told AS (SELECT event_id, stock_id, irrelevant, done, summary, [CAST(length(summary) % 97 AS DOUBLE), CAST(length(summary) % 89 AS DOUBLE), 1.0::DOUBLE] AS v
        FROM best JOIN made USING (event_id)),
      fin AS (SELECT event_id, stock_id, CASE WHEN done THEN 'told before' ELSE summary END AS summary,
          CASE WHEN done THEN [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE] ELSE v END AS v, done,
          NOT done AND NOT irrelevant AND {angle.format('v', '[1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]')} > 0.8 AS off, irrelevant FROM told),
      ready AS (SELECT * FROM fin WHERE done OR (NOT irrelevant AND NOT off)),
      stocks AS (SELECT DISTINCT stock_id, CAST(dense_rank() OVER (ORDER BY stock_id) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT c_mktsegment AS stock_id FROM customer)),
      it AS (SELECT i.*, stock_id FROM ({DAY_INTERESTS}) i JOIN stocks USING (k)),
      sims AS (SELECT it.area_id, r.summary, row_number() OVER (PARTITION BY it.area_id ORDER BY
          round(1 - {angle.format('r.v', '[CAST(it.area_id + 1 AS DOUBLE), 5.0::DOUBLE, 1.0::DOUBLE]')}, 9), r.event_id) AS n FROM it JOIN ready r USING (stock_id)),
      dig AS (SELECT area_id, string_agg({DIGEST_BLOCK.format('summary')}, '' ORDER BY n) AS digest FROM sims WHERE n <= 30 GROUP BY area_id)
      SELECT 'analysis' AS kind, CAST(area_id AS VARCHAR) AS key, md5({template_sql(prompts.RELEVANCE_PROMPT, context='area', events="coalesce(digest, '')")}) AS value
        FROM it LEFT JOIN dig USING (area_id) WHERE stock_id <> 'MACHINERY'
      UNION ALL SELECT 'missing', stock_id, NULL FROM (SELECT DISTINCT stock_id FROM it WHERE stock_id = 'MACHINERY')
      UNION ALL SELECT 'processed', CAST(event_id AS VARCHAR), CASE WHEN done THEN 'told before' ELSE md5(summary) END FROM fin WHERE NOT done AND NOT irrelevant AND NOT off
      UNION ALL SELECT 'processed', CAST(event_id AS VARCHAR), 'told before' FROM ev WHERE done
      UNION ALL SELECT 'flag', CAST(event_id AS VARCHAR), CAST(irrelevant OR off AS VARCHAR) FROM fin"""


@query("r9_daily_alerts", daily_sql())
def r9_daily(t: Tables) -> DataFrame:
    """From raw events and pages to the day's analyses; one stock has no call that day."""
    events = t.sql(DAY_EVENTS).join(_linked_events(t), "event_id")
    calls = events.select("stock_id", "call_id").distinct()
    late = (F.col("call_id") == "late") & (F.col("stock_id") != "MACHINERY")
    calls = calls.withColumn("call_time", F.when(late, F.lit(dt.datetime(2024, 1, 5, 9))).otherwise(F.lit(dt.datetime(2024, 1, 4, 9))))
    processed = events.where("done").select(
        F.col("event_id").cast("string").alias("processed_id"), "event_id", F.lit("told before").alias("summary"),
        F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0)]).alias("summary_embedding"),
    )
    # There are five market segments.
    order = W.partitionBy(F.lit(0)).orderBy("stock_id")
    stocks = events.select("stock_id").distinct().withColumn("k", F.row_number().over(order) - 1)
    interests = t.sql(DAY_INTERESTS).join(stocks, "k").select(
        F.col("area_id").alias("interest_id"), "user_id", "alert_stock_id", "stock_id", F.col("stock_id").alias("stock"), "area_id", "area",
        F.array(F.col("area_id").cast("double") + 1, F.lit(5.0), F.lit(1.0)).alias("interest_embedding"),
    )
    pages = t.pages.withColumn("url", F.replace("url", F.lit(","), F.lit("%2C")))
    made = processing.daily_alerts(
        interests, calls, events.drop("done"), processed, pages, dt.date(2024, 1, 5), embedder=_lengths, anchor=[1.0, 0.0, 0.0], chunk_size=PAGE_TOKENS
    )
    told = F.when(F.col("summary") == "told before", F.col("summary")).otherwise(F.md5("summary"))
    parts = [
        made.analyses.select(F.lit("analysis").alias("kind"), F.col("area_id").cast("string").alias("key"), F.md5("analysis").alias("value")),
        made.missing.select(F.lit("missing").alias("kind"), F.col("stock_id").alias("key"), F.lit(None).cast("string").alias("value")),
        made.processed.select(F.lit("processed").alias("kind"), F.col("event_id").cast("string").alias("key"), told.alias("value")),
        made.flagged.select(F.lit("flag").alias("kind"), F.col("event_id").cast("string").alias("key"), F.col("irrelevant").cast("string").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def prompt_rows_sql() -> str:
    parts = []
    for kind, (role, message) in prompts.ANALYSIS_KINDS.items():
        args = {"company": "source", "context": "ctx", "events": "text", "query": "ctx", "analysis": "text"}
        system = template_sql(role, **args) if role else "NULL"
        text = template_sql(message, **args) if message else "NULL"
        parts.append(f"SELECT doc_id, '{kind}' AS kind, md5({system}) AS system, md5({text}) AS prompt FROM d WHERE ctx IS NOT NULL")
    every = " UNION ALL ".join(parts)
    return f"""WITH d AS (SELECT *, CASE WHEN lang <> 'fr' THEN lang END AS ctx FROM documents)
      {every} UNION ALL SELECT doc_id, 'quarantined', NULL, NULL FROM d WHERE ctx IS NULL"""


# Arguments of each analysis kind.
KIND_ARGUMENTS = {
    "ranking": ("company", "context", "events"),
    "relevance": ("company", "context", "events"),
    "alert": ("company", "context", "events"),
    "query": ("query",),
    "query_message": ("query",),
    "chat": ("context", "analysis"),
}


@query("r10_analysis_prompts", prompt_rows_sql())
def r10(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("ctx", F.when(F.col("lang") != "fr", F.col("lang")))
    source = {"company": "source", "context": "ctx", "events": "text", "query": "ctx", "analysis": "text"}
    out = []
    for kind, arguments in KIND_ARGUMENTS.items():
        ready, missing = prompts.analysis_prompts(rows, kind, **{a: source[a] for a in arguments})
        out.append(ready.select("doc_id", F.lit(kind).alias("kind"), F.md5("system").alias("system"), F.md5("prompt").alias("prompt")))
    nothing = F.lit(None).cast("string")
    found = missing.select("doc_id", F.lit("quarantined").alias("kind"), nothing.alias("system"), nothing.alias("prompt"))
    for part in out:
        found = found.unionByName(part)
    return found


def refine_sql() -> str:
    contexts = ", ".join(f"max(CASE WHEN rank = {i} THEN page_content END) AS c{i}" for i in range(1, 6))
    first = template_sql(prompts.QUESTION_PROMPT, context="c1", question="question")
    steps = f"w AS (SELECT query_id, question, {contexts} FROM hit GROUP BY ALL), a1 AS (SELECT *, {first} AS answer FROM w)"
    for i in range(2, 6):
        nxt = template_sql(retrieval.REFINE_PROMPT, question="question", answer="answer", context=f"c{i}")
        steps += f", a{i} AS (SELECT * REPLACE (coalesce({nxt}, answer) AS answer) FROM a{i - 1})"
    return f"WITH {hits_sql(prompts.ENTITY_QUESTIONS)}, {steps} SELECT query_id, md5(answer) AS digest FROM a5"


@query("r3_refine_inputs", refine_sql(), ("sections",))
def r3_refine(t: Tables) -> DataFrame:
    asked = _questions(t, retrieval.entity_questions(t.sections))
    hits = retrieval.retrieve(asked, _index(t), 5, ["ticker"], {"filing_type": "en"})
    return retrieval.refine_inputs(asked, hits).select("query_id", F.md5("answer").alias("digest"))
