"""Filing records, reported-facts JSON, web pages and section files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.chunking import html_to_text

# Fields of a filing record; the last four may be absent.
FILING_FIELDS = (
    "accessionNo", "cik", "ticker", "companyName", "companyNameLong", "formType", "description",
    "linkToFilingDetails", "linkToTxt", "linkToHtml", "filedAt", "linkToXbrl", "periodOfReport",
    "effectivenessDate", "registrationForm", "referenceAccessionNo",
)
FILING_SCHEMA = ", ".join(f"{f} string" for f in FILING_FIELDS)

FACT_SCHEMA = (
    "map<string, map<string, array<struct<value: string, segment: string, "
    "period: struct<startDate: string, endDate: string, instant: string>>>>>"
)


def typed_filings(records: DataFrame) -> DataFrame:
    """Dates parsed; an unreadable optional date becomes NULL."""
    return records.withColumns(
        {
            "filedAt": F.try_to_timestamp(F.col("filedAt")),
            "periodOfReport": F.expr("try_cast(periodOfReport AS DATE)"),
            "effectivenessDate": F.expr("try_cast(effectivenessDate AS DATE)"),
        }
    )


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of filing records, read with a fixed schema."""
    return typed_filings(spark.read.schema(FILING_SCHEMA).json(path))


def parse_filings(df: DataFrame, json_col: str) -> DataFrame:
    """Filing records held as JSON text in a column."""
    return typed_filings(df.select(F.from_json(json_col, FILING_SCHEMA).alias("_f")).select("_f.*"))


def parse_xbrl(df: DataFrame, json_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Facts (by, statement, item, pos, startDate, endDate, instant, segment, value).

    ``pos`` is the place in the item's list; an item without facts keeps one row
    with NULL ``pos``. A JSON null segment reads as absent.
    """
    statements = df.select(*by, F.explode(F.from_json(json_col, FACT_SCHEMA)).alias("statement", "_items"))
    items = statements.select(*by, "statement", F.explode("_items").alias("item", "_facts"))
    facts = items.select(*by, "statement", "item", F.posexplode_outer("_facts").alias("pos", "_fact"))
    return facts.select(
        *by, "statement", "item", "pos",
        "_fact.period.startDate", "_fact.period.endDate", "_fact.period.instant", "_fact.segment", "_fact.value",
    )


def read_xbrl(spark: SparkSession, path: str) -> DataFrame:
    """Facts of whole-file JSON documents; ``source_file`` names the document."""
    files = spark.read.text(path, wholetext=True).withColumn("source_file", F.input_file_name())
    return parse_xbrl(files, "value", ("source_file",))


def read_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages with their visible text."""
    return pages.withColumn("page_text", html_to_text("html")).drop("html")


def section_rows(files: DataFrame) -> DataFrame:
    """Sections of text files (path, value): the file name names the section."""
    name = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    return files.select(F.col("path").alias("source"), name.alias("filing_section"), F.col("value").alias("text"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Section text files, one row per file."""
    files = spark.read.text(path, wholetext=True)
    return section_rows(files.select(F.input_file_name().alias("path"), "value"))
