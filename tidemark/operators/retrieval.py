"""Index, retrieve and assemble question inputs over filing sections."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import prompts
from tidemark.operators.chunking import CHUNK_CHARS, CHUNK_OVERLAP, chunk_chars, chunk_text
from tidemark.operators.filters import where_metadata
from tidemark.operators.joins import parent_chunks, question_pairs
from tidemark.operators.model_map import ask
from tidemark.operators.ordering import concat_in_order, join_parts
from tidemark.operators.vectors import embed, knn
from tidemark.session import write_once

TOP_K = 5
# Wording of this library's own.
REFINE_PROMPT = "Question: {question}\nAnswer so far: {answer}\nMore context:\n{context}\nImproved answer:"
METADATA = ("ticker", "filing_type", "filing_date", "filing_section", "filing_description")


def explode_sections(filings: DataFrame, sections: str = "text") -> DataFrame:
    """One row per section of a map column of section texts."""
    rest = [c for c in filings.columns if c != sections]
    return filings.select(*rest, F.explode(sections).alias("filing_section", "text"))


def chunk_id(columns: Sequence[str]) -> Column:
    """Deterministic id of a chunk, so a repeated load gives the same ids; its text is part of it, so filings with
    equal fields keep their chunks apart."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def index_sections(
    sections: DataFrame,
    model: Callable[[list[str]], list[str]] | None = None,
    embedder: Callable | None = None,
    size: int = CHUNK_CHARS,
    overlap: int = CHUNK_OVERLAP,
    by_separator: bool = False,
    **model_options,
) -> DataFrame:
    """Chunk table of section rows (five metadata fields and ``text``).

    Chunks are summarised by the model (without one the summary is the chunk) and
    the summary is embedded; the chunk itself stays as ``original_content``.
    """
    if by_separator:
        chunks = chunk_text(sections, "text", size, "original_content")
    else:
        chunks = chunk_chars(sections, "text", size, overlap, "original_content")
    chunks = chunks.withColumn("doc_id", chunk_id([*METADATA, "chunk_index", "original_content"]))
    if model is None:
        summarised = chunks.withColumn("content", F.col("original_content"))
    else:
        prompt = prompts.fill(prompts.SECTION_PROMPT, ticker="ticker", filing_type="filing_type", doc="original_content")
        summarised = ask(chunks, prompt, "content", model, **model_options)
    return embed(summarised, "content", embedder)


def retrieve(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, where: Sequence[str] = (), metadata: Mapping[str, str] | None = None,
    metric: str = "l2",
) -> DataFrame:
    """Nearest chunks of each query with the original text and its section.

    The chunks that fit the filter are written once: the search reads their vectors, the hits their texts.
    """
    pool = write_once(where_metadata(chunks, metadata or {}), "chunks")
    hits = knn(queries, pool, k, where, metric).withColumnRenamed("neighbour_id", "doc_id")
    return parent_chunks(hits, pool)


def answer_inputs(
    questions: DataFrame,
    hits: DataFrame,
    model: Callable[[list[str]], list[str]] | None = None,
    question_prompt: str = prompts.QUESTION_PROMPT,
    combine_prompt: str = prompts.COMBINE_PROMPT,
    with_sources: bool = False,
    **model_options,
) -> DataFrame:
    """Map-reduce question answering over retrieved chunks.

    ``questions`` (query_id, question); ``hits`` (query_id, rank, page_content,
    source). One prompt per chunk, answers in rank order, then one combine prompt
    per question. Output: query_id, question, combine prompt and ``answer``.
    Without a model answers are the prompts.
    """
    asked = hits.join(questions.select("query_id", "question"), "query_id")
    prompt = prompts.fill(question_prompt, context="page_content", question="question")
    answered = ask(asked, prompt, "part_answer", model, **model_options)
    text = F.col("part_answer")
    if with_sources:
        # Fixed value: layout of an answer with its source.
        text = F.concat(F.lit("Content: "), text, F.lit("\nSource: "), F.col("source"))
    parts = concat_in_order(
        answered.withColumn("_pos", F.col("rank") - 1), ["query_id", "question"], "_pos", text, "summaries", "\n\n"
    )
    summaries = join_parts(parts, ["query_id", "question"], "summaries", "\n\n")
    combined = summaries.withColumn(
        "combine_prompt", prompts.fill(combine_prompt, summaries="summaries", question="question")
    )
    return ask(combined, F.col("combine_prompt"), "answer", model, **model_options).drop("summaries")


def refine_inputs(
    questions: DataFrame,
    hits: DataFrame,
    model: Callable[[list[str]], list[str]] | None = None,
    k: int = TOP_K,
    first_prompt: str = prompts.QUESTION_PROMPT,
    refine_prompt: str = REFINE_PROMPT,
    **model_options,
) -> DataFrame:
    """Question answering that folds the chunks in one after the other."""
    asked = hits.join(questions.select("query_id", "question"), "query_id")
    prompt = prompts.fill(first_prompt, context="page_content", question="question")
    state = ask(asked.where("rank = 1"), prompt, "answer", model, **model_options).select("query_id", "question", "answer")
    for rank in range(2, k + 1):
        more = hits.where(F.col("rank") == rank).select("query_id", "page_content")
        prompt = prompts.fill(refine_prompt, question="question", answer="answer", context="page_content")
        # A question with fewer hits has no prompt here and keeps its answer.
        state = ask(state.join(more, "query_id", "left"), prompt, "_next", model, **model_options).select(
            "query_id", "question", F.coalesce("_next", "answer").alias("answer")
        )
    return state


def question_bank(companies: DataFrame, ticker: str = "ticker") -> DataFrame:
    """The 24 topic questions for every company."""
    return question_pairs(companies, prompts.COMPANY_QUESTIONS, ticker)


def entity_questions(companies: DataFrame, ticker: str = "ticker") -> DataFrame:
    """The two competitor questions for every company."""
    return question_pairs(companies, prompts.ENTITY_QUESTIONS, ticker)


def answers_map(answers: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Per company a map of topic to (query, result); the bank bounds its size."""
    ordered = F.sort_array(F.collect_list(F.struct("question_no", "topic", "query", "result")))
    entries = F.transform(
        ordered, lambda e: F.struct(e["topic"].alias("key"), F.struct(e["query"].alias("query"), e["result"].alias("result")).alias("value"))
    )
    return answers.groupBy(ticker).agg(F.map_from_entries(entries).alias("processed_data"))
