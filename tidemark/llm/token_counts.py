"""Token counts through a digest cache.

A text's key is the digest of its normalised content and the digest of the tokenizer file. Keys are
joined to the stored counts; each distinct miss is encoded once and appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fields, shared_path, shared_table, slices

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"
#: Distinct words a task remembers before it starts its memory anew.
MEMORY_WORDS = 400_000
#: Words given to the tokenizer in one call.
CALL_WORDS = 20_000


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class WordCounts:
    """Token counts of words, remembered; a text's count is the sum over its words.

    The tokenizer's pieces never hold white space, its normaliser works on each side of white space
    alone, and added tokens hold none, so the count is additive over ASCII white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text (UTF-8)."""
        split = [t.split() for t in texts]
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        missing = list({w for words in split for w in words if w not in self.known})
        for i in range(0, len(missing), CALL_WORDS):
            part = missing[i : i + CALL_WORDS]
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.known.update(zip(part, map(len, coded)))
        known = self.known.__getitem__
        return [sum(map(known, words)) for words in split]


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counts = WordCounts(path)
        # Equal rows come to one task, which encodes the first of them.
        seen: set[bytes] = set()
        for batch in slices(batches, 4096):
            fresh = [i for i, d in enumerate(batch.column("digest").to_pylist()) if not (d in seen or seen.add(d))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n = pa.array(counts.count(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), n], names=["digest", "n_tokens"])

    return encode


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, whole texts.

    ``cache`` is a Parquet folder in a store that all executors share; it is created or appended to, and
    without it a new folder in the shared checkpoint folder is used. Counts are those of the tokenizer
    library without begin, end or added special tokens; a special string inside a text counts as the
    library reads it. The content is normalised by making each run of ASCII white space one space, which
    no count depends on. A null text is empty and has no tokens; repeated rows stay; an empty table gives
    none; other columns are not read. A count stored twice (two jobs at once) is read once.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache = cache or shared_path(spark, "token-cache")
    rows = fields(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    content = F.btrim(F.regexp_replace("text", "[ \\t-\\r]+", " "), F.lit(" "))
    keyed = shared_table(
        rows.select("doc_id", "mark", F.octet_length("text").cast("bigint").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest")),
        "digests",
    )
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    # The first row of a digest stands for all; the join keys keep the copies of one text apart.
    firsts = keyed.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("first")).join(stored, "digest", "left_anti")
    firsts = firsts.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"))
    texts = rows.join(
        firsts.hint("shuffle_hash"), (F.col("mark") == F.col("first_mark")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    )
    new = texts.select("digest", "text").mapInArrow(_encoder(tokenizer_path), "digest binary, n_tokens bigint")
    once = new.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    once.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    # Written first, so that the join's sides are plain exchanges and Spark can split a hot digest.
    counts = shared_table(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest-counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
