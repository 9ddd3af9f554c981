"""Corpus pipeline: the stages a raw crawl goes through before it is training data.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; its rows are written as Parquet and
read again as the next stage's documents. All but the last return the columns of ``documents``. Columns that
``documents`` has besides are kept, an empty table goes through all stages as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontamination, quality, sentence_spans, simhash
from tidemark.llm.common import shared_table
from tidemark.session import tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise-ranking classifier scores at or above its threshold, empty ones among the judged."""
    tune(spark)
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links (runs of three words, two bits); see ``simhash.keep_one``."""
    tune(spark)
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences of passages that an earlier document has; n_chars follows.

    Null and empty texts, repeated rows and an empty table are as in ``sentence_spans.remove_repeats``.
    """
    tune(spark)
    cleaned = sentence_spans.remove_repeats(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; see ``decontamination.drop_contaminated``."""
    tune(spark)
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def byte_bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (packed) and the number of tokens, and whether decoding gives the text back.

    A null or empty text has no tokens; repeated rows stay.
    """
    tune(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, ranks, pattern), ranks, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.withColumn("round_trip", same).drop("decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe_encoding", byte_bpe_encoding),
]

#: SQL can't express the classifier, the copies' groups or the merges; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over all documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
