"""Sources, scalar columns and filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.checks.fixtures import Tables
from tidemark.checks.registry import query, shared_folder
from tidemark.functions import articles as art
from tidemark.functions import health, mentions
from tidemark.operators import filters
from tidemark.operators.chunking import html_to_text
from tidemark.operators.joins import question_pairs
from tidemark.operators.prompts import COMPANY_QUESTIONS
from tidemark.session import write_once
from tidemark.sources import articles as article_source
from tidemark.sources.filings import parse_xbrl, read_filings, read_pages, section_rows

AS_OF = dt.datetime(2001, 8, 1)
CALL_TIMES = "SELECT event_id AS call_id, user_id AS stock_id, ts AS call_time, 7 AS n FROM events"


def names_sql(column: str, kind: str = "other") -> str:
    """List of names in the checking dialect."""
    if kind == "locations":
        return f"list_transform(string_split({column}, ';'), lambda m: string_split(m, '#')[3])"
    return f"list_transform(string_split({column}, ';'), lambda m: replace(string_split(m, ',')[1], ' ', '_'))"


def distinct_sql(column: str, kind: str = "other", sep: str = ", ") -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct({names_sql(column, kind)})), '{sep}'), '')"


def clean_sql(text: str) -> str:
    return rf"regexp_replace({text}, '[\p{{Nd}}_]', ' ', 'g')"


SUMMARY_SQL = f"""concat('This article talks about these people (', {clean_sql(distinct_sql('V2Persons'))},
  '), these organizations (', {clean_sql(distinct_sql('V2Organizations'))},
  '), these locations (', {clean_sql(distinct_sql('V2Locations', 'locations'))},
  '). It took place on ', strftime(strptime(DATE, '%Y%m%d%H%M%S'), '%dth %B %Y'),
  ' and includes these themes (', {clean_sql('lower(' + distinct_sql('V2Themes') + ')')}, ').')"""


# -- sources ---------------------------------------------------------------------------------


@query(
    "s1_read_articles",
    """SELECT article_id, DATE, V2Organizations, DocumentIdentifier FROM articles
       WHERE partition_date >= TIMESTAMP '2001-08-01' - INTERVAL 700 DAY AND contains(lower(V2Organizations), 'brand#2 ')""",
    ("articles",),
)
def s1(t: Tables) -> DataFrame:
    found = article_source.select_articles(t.articles, "Brand#2 ", 700, AS_OF, "partition_date")
    return found.select("article_id", "DATE", "V2Organizations", "DocumentIdentifier")


@query(
    "s1_article_table",
    """SELECT article_id, DATE, V2Organizations, DocumentIdentifier FROM articles
       WHERE date_trunc('month', partition_date) >= TIMESTAMP '2001-08-01' - INTERVAL 700 DAY AND contains(lower(V2Organizations), 'brand#2 ')""",
    ("articles",),
)
def s1_table(t: Tables) -> DataFrame:
    """The articles are stored by date (here one folder a month) and read back through the folders that are asked for."""
    path = shared_folder(t.spark, "articles")
    article_source.write_articles(t.articles.withColumn("partition_date", F.trunc("partition_date", "month")), path)
    found = article_source.read_articles(t.spark, path, "Brand#2 ", 700, AS_OF)
    return found.select("article_id", "DATE", "V2Organizations", "DocumentIdentifier")


@query(
    "s2_append_entries",
    """SELECT CAST(77 AS BIGINT) AS call_id, DATE AS date, V2Themes AS themes, V2Tone AS tone, V2Locations AS locations,
              V2Persons AS persons, V2Organizations AS organizations, DocumentIdentifier AS document_identifier,
              AllNames AS all_names, Amounts AS amounts FROM articles""",
    ("articles",),
)
def s2(t: Tables) -> DataFrame:
    """Two runs are written, one of them twice; the table read back holds each run once."""
    path, day = shared_folder(t.spark, "entries"), dt.date(2001, 8, 1)
    articles = write_once(t.articles, "articles")
    for call in (77, 78, 77):
        article_source.append_entries(articles, call, path, day)
    return article_source.read_entries(t.spark, path, 77).drop("call_date")


# Every field of a filing record; dates that can't be read become null.
FILING_TEXTS = {
    "cik": "concat('C', accessionNo)", "companyName": "concat(ticker, ' Inc')", "companyNameLong": "concat(ticker, ' Incorporated (', ticker, ')')",
    "linkToFilingDetails": "concat('http://d/', accessionNo)", "linkToTxt": "concat('http://t/', accessionNo)", "linkToHtml": "concat('http://h/', accessionNo)",
    "linkToXbrl": "CASE WHEN formType = '10-K' THEN concat('http://x/', accessionNo) END",
    "registrationForm": "CASE WHEN formType = '8-K' THEN concat('R', accessionNo) END", "referenceAccessionNo": "CASE WHEN formType = '4' THEN concat('Z', accessionNo) END",
}


@query(
    "s4_read_filings",
    "SELECT accessionNo, ticker, formType, description, " + ", ".join(f"{text} AS {name}" for name, text in FILING_TEXTS.items())
    + """, strftime(filedAt, '%Y-%m-%d %H:%M:%S') AS filed, CASE WHEN formType <> '4' THEN strftime(filedAt, '%Y-%m-%d') END AS period,
         CASE WHEN formType = '8-K' THEN strftime(filedAt, '%Y-%m-%d') END AS effective FROM filings""",
    ("filings",),
)
def s4(t: Tables) -> DataFrame:
    """All sixteen fields, written as JSON lines and read back."""
    day = F.date_format("filedAt", "yyyy-MM-dd")
    record = t.filings.select(
        "accessionNo", "ticker", "formType", "description", *[F.expr(text).alias(name) for name, text in FILING_TEXTS.items()],
        F.date_format("filedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("filedAt"),
        F.when(F.col("formType") != "4", day).alias("periodOfReport"),
        F.when(F.col("formType") == "8-K", day).when(F.col("formType") == "10-K", F.lit("soon")).alias("effectivenessDate"),
    )
    path = shared_folder(t.spark, "filings")
    record.write.json(path)
    return read_filings(t.spark, path).select(
        "accessionNo", "ticker", "formType", "description", *FILING_TEXTS,
        F.date_format("filedAt", "yyyy-MM-dd HH:mm:ss").alias("filed"),
        F.col("periodOfReport").cast("string").alias("period"), F.col("effectivenessDate").cast("string").alias("effective"),
    )


@query(
    "s5_read_xbrl",
    """SELECT accessionNo, statement, item, startDate, endDate, instant, segment, value, CAST(row_number() OVER (
         PARTITION BY accessionNo, statement, item ORDER BY rank_key, price_key, l_suppkey) - 1 AS INTEGER) AS pos FROM facts""",
    ("facts",),
)
def s5(t: Tables) -> DataFrame:
    """One JSON document per filing and statement, with the list of facts of every item."""
    fact = F.struct(F.struct("startDate", "endDate", "instant").alias("period"), "segment", "value")
    ordered = F.sort_array(F.collect_list(F.struct("rank_key", "price_key", "l_suppkey", fact.alias("fact"))))
    # A filing has as many facts as its order has lines.
    lists = t.facts.groupBy("accessionNo", "statement", "item").agg(F.transform(ordered, lambda f: f["fact"]).alias("facts"))
    items = F.map_from_entries(F.collect_list(F.struct("item", "facts")))
    docs = lists.groupBy("accessionNo", "statement").agg(items.alias("items"))
    doc = F.to_json(F.create_map("statement", "items"))
    return parse_xbrl(docs.select("accessionNo", doc.alias("json")), "json", ("accessionNo",))


HTML_SQL = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
    '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#34;', '"'), '&#39;', ''''),
  '&apos;', ''''), '&amp;', '&'), '[ \\t\\r\\n\\f]+', ' ', 'g'))"""


@query("s6_read_pages", f"SELECT page_id, url, {HTML_SQL} AS page_text FROM pages")
def s6(t: Tables) -> DataFrame:
    return read_pages(t.pages)


@query("t3_html_to_text", f"SELECT page_id, length({HTML_SQL}) AS n_chars, md5({HTML_SQL}) AS digest FROM pages")
def t3(t: Tables) -> DataFrame:
    text = html_to_text("html")
    return t.pages.select("page_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


# -- scalars ---------------------------------------------------------------------------------


@query(
    "p1_split_mentions",
    """SELECT article_id, coalesce(len(string_split(V2Persons, ';')), 0) AS n_persons,
              len(string_split(V2Locations, ';')) AS n_locations, string_split(V2Persons, ';')[-1] AS last_person FROM articles""",
    ("articles",),
)
def p1(t: Tables) -> DataFrame:
    persons = mentions.split_mentions("V2Persons")
    return t.articles.select(
        "article_id", F.size(persons).cast("long").alias("n_persons"),
        F.size(mentions.split_mentions("V2Locations")).cast("long").alias("n_locations"),
        F.try_element_at(persons, F.lit(-1)).alias("last_person"),
    )


@query(
    "p2_entity_name",
    "SELECT article_id, replace(string_split(unnest(string_split(V2Organizations, ';')), ',')[1], ' ', '_') AS name FROM articles",
    ("articles",),
)
def p2(t: Tables) -> DataFrame:
    names = F.transform(mentions.split_mentions("V2Organizations"), mentions.entity_name)
    return t.articles.select("article_id", F.explode(names).alias("name"))


@query(
    "p3_location_name",
    "SELECT article_id, string_split(unnest(string_split(V2Locations, ';')), '#')[3] AS name FROM articles",
    ("articles",),
)
def p3(t: Tables) -> DataFrame:
    names = F.transform(mentions.split_mentions("V2Locations"), mentions.location_name)
    return t.articles.select("article_id", F.explode(names).alias("name"))


@query(
    "p4_distinct_names",
    f"""SELECT article_id, {distinct_sql('V2Persons')} AS persons, {distinct_sql('V2Organizations', sep=' ')} AS orgs,
               {distinct_sql('V2Locations', 'locations')} AS locations FROM articles""",
    ("articles",),
)
def p4(t: Tables) -> DataFrame:
    return t.articles.select(
        "article_id", mentions.distinct_names("V2Persons").alias("persons"),
        mentions.distinct_names("V2Organizations", sep=" ").alias("orgs"),
        mentions.distinct_names("V2Locations", "locations").alias("locations"),
    )


@query(
    "p5_strip_digits",
    f"SELECT doc_id, md5({clean_sql('text')}) AS digest, length({clean_sql('text')}) AS n FROM documents",
)
def p5(t: Tables) -> DataFrame:
    text = mentions.strip_digits("text")
    return t.documents.select("doc_id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("n"))


@query(
    "p6_lower_themes",
    f"SELECT article_id, {clean_sql('lower(' + distinct_sql('V2Themes') + ')')} AS themes FROM articles",
    ("articles",),
)
def p6(t: Tables) -> DataFrame:
    return t.articles.select("article_id", mentions.lower_themes("V2Themes").alias("themes"))


@query(
    "p7_parse_gkg_ts",
    """SELECT article_id, strftime(try_strptime(d, '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS parsed FROM (
         SELECT article_id, CASE WHEN V2Persons IS NULL THEN concat(DATE, 'x') ELSE DATE END AS d FROM articles)""",
    ("articles",),
)
def p7(t: Tables) -> DataFrame:
    # Some dates are spoiled, so the NULL branch is exercised too.
    raw = F.when(F.col("V2Persons").isNull(), F.concat("DATE", F.lit("x"))).otherwise(F.col("DATE"))
    return t.articles.select(
        "article_id", F.date_format(art.parse_gkg_ts(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


@query("p8_display_date", "SELECT event_id, strftime(ts, '%dth %B %Y') AS shown FROM events")
def p8(t: Tables) -> DataFrame:
    return t.events.select("event_id", art.display_date("ts").alias("shown"))


@query("p9_article_summary", f"SELECT article_id, {SUMMARY_SQL} AS summary FROM articles", ("articles",))
def p9(t: Tables) -> DataFrame:
    return art.article_summary(t.articles).select("article_id", F.col("Summary").alias("summary"))


@query(
    "p10_require_columns",
    "SELECT count(*) AS n, count(V2Persons) AS with_persons FROM articles",
    ("articles",),
)
def p10(t: Tables) -> DataFrame:
    checked = art.require_columns(t.articles, art.SUMMARY_SOURCES)
    return checked.agg(F.count("*").alias("n"), F.count("V2Persons").alias("with_persons"))


@query(
    "p11_links",
    """SELECT article_id, array_to_string(string_split(V2Persons, ';'), ',') AS joined,
              len(string_split(array_to_string(string_split(V2Persons, ';'), ','), ',')) AS n_parts
       FROM articles WHERE V2Persons IS NOT NULL""",
    ("articles",),
)
def p11(t: Tables) -> DataFrame:
    rows = t.articles.where("V2Persons IS NOT NULL")
    joined = mentions.join_links(mentions.split_mentions("V2Persons"))
    return rows.select(
        "article_id", joined.alias("joined"), F.size(mentions.split_links(joined)).cast("long").alias("n_parts")
    )


@query(
    "p12_health_component",
    "SELECT l_orderkey, l_linenumber, l_quantity AS size, l_discount AS coh, l_tax AS var, CAST(NULL AS DOUBLE) AS beyond FROM lineitem",
)
def p12(t: Tables) -> DataFrame:
    text = F.to_json(F.array("l_quantity", "l_discount", "l_tax"))
    parts = {n: health.health_component("health", i) for i, n in enumerate(("size", "coh", "var", "beyond"))}
    return t.lineitem.withColumn("health", text).select(
        "l_orderkey", "l_linenumber", *[c.alias(n) for n, c in parts.items()]
    )


@query(
    "p13_combined_health",
    """SELECT l_orderkey, l_linenumber, round(0.5 * l_quantity + 0.3 * l_discount + (1 - l_tax) * (-0.2), 6) AS score FROM lineitem""",
)
def p13(t: Tables) -> DataFrame:
    score = health.combined_health("l_quantity", "l_discount", "l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query(
    "p14_normalize_tickers",
    """SELECT c_custkey, concat_ws('|', upper(trim(c_name)), upper(trim(c_mktsegment)), '') AS tickers,
              concat_ws('|', c_name, c_mktsegment) AS sections FROM customer""",
)
def p14(t: Tables) -> DataFrame:
    csv = F.concat(F.lit(" "), "c_name", F.lit(" ,"), F.lower("c_mktsegment"), F.lit(", "))
    sections = F.concat(F.lit(" "), "c_name", F.lit(" , ,"), "c_mktsegment", F.lit(","))
    return t.customer.select(
        "c_custkey", F.array_join(mentions.normalize_tickers(csv), "|").alias("tickers"),
        F.array_join(mentions.normalize_sections(sections), "|").alias("sections"),
    )


@query(
    "p15_event_window_label",
    """SELECT event_id, concat(CAST(CAST(ts AS DATE) - 7 AS VARCHAR), ' to ', CAST(CAST(ts AS DATE) AS VARCHAR)) AS label FROM events""",
)
def p15(t: Tables) -> DataFrame:
    return t.events.select("event_id", art.event_window_label("ts", 7).alias("label"))


# Every column of the article input, in order.
ARTICLE_FIELDS = (
    "article_id call_id DATE partition_date V2Persons V2Organizations V2Themes V2Locations V2Tone AllNames Amounts DocumentIdentifier"
).split()


def sentence_sql() -> str:
    named = "".join(f", '{f}: ', coalesce(CAST({f} AS VARCHAR), 'None'), ' '" for f in ARTICLE_FIELDS)
    return f"concat('This is an event where '{named})"


@query(
    "p16_metadata_sentence",
    f"SELECT article_id, {sentence_sql()} AS sentence FROM articles",
    ("articles",),
)
def p16(t: Tables) -> DataFrame:
    return t.articles.select("article_id", art.metadata_sentence(t.articles.columns).alias("sentence"))


def question_rows_sql(tickers: str, questions: dict[str, str]) -> str:
    rows = ", ".join(
        "({}, '{}', '{}')".format(i, topic.replace("'", "''"), q.replace("'", "''"))
        for i, (topic, q) in enumerate(questions.items())
    )
    return f"""SELECT ticker, CAST(question_no AS INTEGER) AS question_no, topic, replace(template, '{{company}}', ticker) AS question
      FROM ({tickers}) x, (VALUES {rows}) q(question_no, topic, template)"""


@query("p17_template_questions", question_rows_sql("SELECT DISTINCT s_name AS ticker FROM supplier", COMPANY_QUESTIONS))
def p17(t: Tables) -> DataFrame:
    return question_pairs(t.supplier.select(F.col("s_name").alias("ticker")), COMPANY_QUESTIONS)


# -- filters ---------------------------------------------------------------------------------


@query("f1_recent", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def f1(t: Tables) -> DataFrame:
    return filters.recent(t.events, "ts", dt.datetime(2024, 1, 31), 7).select("event_id")


@query("f2_mentions_company", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red w')")
def f2(t: Tables) -> DataFrame:
    return filters.mentions_company(t.part, "RED W", "p_name").select("p_partkey")


@query("f3_drop_noise", "SELECT article_id, cluster FROM clustered WHERE cluster <> -1", ("clustered",))
def f3(t: Tables) -> DataFrame:
    return filters.drop_noise(t.clustered).select("article_id", "cluster")


@query("f4_health_cutoff", "SELECT l_orderkey, l_linenumber, l_discount AS score FROM lineitem WHERE l_discount > 0.05")
def f4(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("score"))
    return filters.health_cutoff(rows, "score", 0.05)


@query(
    "f5_drop_irrelevant",
    """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT coalesce(l.toxic = 1, FALSE)""",
)
def f5(t: Tables) -> DataFrame:
    events = t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("irrelevant", F.col("toxic") == 1)
    return filters.drop_irrelevant(events).select("doc_id")


@query(
    "f6_median_between",
    "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'",
)
def f6(t: Tables) -> DataFrame:
    return filters.median_between(t.events, dt.date(2024, 1, 5), dt.date(2024, 1, 12), "ts").select("event_id")


@query(
    "f7_clamp_range",
    """SELECT event_id,
         CAST(CASE WHEN DATE '2024-01-05' < CAST(ts AS DATE) - 7 OR DATE '2024-01-12' > CAST(ts AS DATE)
              THEN CAST(ts AS DATE) - 7 ELSE DATE '2024-01-05' END AS VARCHAR) AS start_date,
         CAST(CASE WHEN DATE '2024-01-05' < CAST(ts AS DATE) - 7 OR DATE '2024-01-12' > CAST(ts AS DATE)
              THEN CAST(ts AS DATE) ELSE DATE '2024-01-12' END AS VARCHAR) AS end_date FROM events""",
)
def f7(t: Tables) -> DataFrame:
    start, end = filters.clamp_range(
        F.lit(dt.date(2024, 1, 5)), F.lit(dt.date(2024, 1, 12)), F.col("ts"), F.lit(7), clamp=True
    )
    return t.events.select("event_id", start.cast("string").alias("start_date"), end.cast("string").alias("end_date"))


@query("f8_form_types", "SELECT accessionNo, formType FROM filings WHERE formType IN ('10-K', '10-Q', '8-K')", ("filings",))
def f8(t: Tables) -> DataFrame:
    return filters.form_types(t.filings).select("accessionNo", "formType")


@query(
    "f9_where_metadata",
    """SELECT section_no, ticker, filing_type, EXISTS (SELECT 1 FROM documents WHERE lang = 'fr' AND source = 'src4') AS any_found
       FROM sections WHERE filing_type = 'fr' AND ticker = 'src4'""",
    ("sections",),
)
def f9(t: Tables) -> DataFrame:
    wanted = {"filing_type": "fr", "ticker": "src4"}
    found = filters.has_metadata(t.sections, wanted).scalar()
    return filters.where_metadata(t.sections, wanted).select(
        "section_no", "ticker", "filing_type", found.alias("any_found")
    )


@query("f10_unsegmented", "SELECT accessionNo, item, value, price_key FROM facts WHERE segment IS NULL", ("facts",))
def f10(t: Tables) -> DataFrame:
    return filters.unsegmented(t.facts).select("accessionNo", "item", "value", "price_key")


@query(
    "f11_active_alerts",
    """SELECT DISTINCT alert_id, user_id FROM alert_stocks JOIN customer ON c_custkey = user_id WHERE c_acctbal > 0""",
    ("alert_stocks",),
)
def f11(t: Tables) -> DataFrame:
    alerts = t.alert_stocks.select("alert_id", "user_id").distinct()
    profiles = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("alert_status"))
    return filters.active_alerts(alerts, profiles)


@query(
    "s7_read_sections",
    """SELECT concat('file:/filings/', source, '/section', CAST(doc_id AS VARCHAR), '.txt') AS source,
              concat('section', CAST(doc_id AS VARCHAR)) AS filing_section, text FROM documents""",
)
def s7(t: Tables) -> DataFrame:
    path = F.concat(F.lit("file:/filings/"), "source", F.lit("/section"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return section_rows(t.documents.select(path.alias("path"), F.col("text").alias("value")))
