"""Newest filing of a company to answered question bank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import prompts
from tidemark.operators.retrieval import TOP_K, answer_inputs, answers_map, entity_questions, index_sections, question_bank, retrieve
from tidemark.operators.vectors import embed
from tidemark.operators.windows import latest_filing


def sections_of_latest(filings: DataFrame, sections: DataFrame, form_type: str = "10-K") -> DataFrame:
    """Section rows (accessionNo, filing_section, text) of each ticker's newest filing."""
    newest = latest_filing(filings, (form_type,)).select(
        "accessionNo", "ticker", F.col("formType").alias("filing_type"),
        F.col("filedAt").cast("string").alias("filing_date"), F.col("description").alias("filing_description"),
    )
    return sections.join(newest, "accessionNo").drop("accessionNo")


def missing_from_index(companies: DataFrame, chunks: DataFrame, filing_type: str) -> DataFrame:
    """Companies whose filing of this type is not indexed yet."""
    held = chunks.where(F.col("filing_type") == filing_type).select("ticker").distinct()
    return companies.join(held, "ticker", "left_anti")


def extend_index(companies: DataFrame, chunks: DataFrame, filings: DataFrame, sections: DataFrame, form_type: str = "10-K", **options) -> DataFrame:
    """Chunk table with the newest filing of every company that had none."""
    todo = missing_from_index(companies, chunks, form_type)
    new = sections_of_latest(filings.join(todo.select("ticker"), "ticker", "left_semi"), sections, form_type)
    return chunks.unionByName(index_sections(new, **options))


def answer_bank(
    companies: DataFrame,
    chunks: DataFrame,
    model: Callable | None = None,
    embedder: Callable | None = None,
    entities: bool = False,
    filing_type: str = "10-K",
    k: int = TOP_K,
    **options,
) -> DataFrame:
    """Question bank answered for all companies; long form (ticker, topic, query, result)."""
    bank = entity_questions(companies) if entities else question_bank(companies)
    asked = embed(bank.withColumn("query_id", F.concat_ws("#", "ticker", "question_no")), "question", embedder)
    hits = retrieve(asked, chunks, k, ["ticker"], {"filing_type": filing_type})
    template = prompts.ENTITY_QUESTION_PROMPT if entities else prompts.QUESTION_PROMPT
    answers = answer_inputs(asked, hits, model, template, **options)
    return asked.select("query_id", "ticker", "question_no", "topic", F.col("question").alias("query")).join(
        answers.select("query_id", F.col("answer").alias("result")), "query_id", "left"
    ).drop("query_id")


def processed_filings(answers: DataFrame) -> DataFrame:
    """One row per company with the answers map."""
    return answers_map(answers)
