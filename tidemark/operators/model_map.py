"""Apply an external text function to a column in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tidemark.session import cut_lineage

# Calls at the same time, attempts and waits between them.
CONCURRENCY = 5
RETRIES = 3
WAITS = (5.0, 10.0)


def identity_model(texts: list[str]) -> list[str]:
    """Stub model: the answer is the prompt."""
    return texts


def map_with_model(
    df: DataFrame,
    prompt_col: str,
    out_col: str,
    fn: Callable[[list[str]], list],
    retries: int = RETRIES,
    waits: Sequence[float] = WAITS,
    concurrency: int | None = CONCURRENCY,
    batch_size: int = 64,
    result_type: T.DataType | None = None,
) -> DataFrame:
    """Add ``out_col`` with the answers of ``fn(list of prompts)``.

    A batch that keeps failing after ``retries`` attempts is sent in halves, down to single
    prompts, and only a prompt that fails alone gets NULL. A model that returns another number of
    answers than it got prompts is an error. NULL prompts are not sent. ``concurrency`` bounds the
    calls at the same time by the number of partitions (``CONCURRENCY``, the usual limit of a
    remote service, by default); None keeps the partitioning, for models inside the tasks.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, result_type or T.StringType())])

    def ask(texts: list[str], attempts: int = retries) -> list:
        answers = None
        for attempt in range(attempts):
            try:
                answers = list(fn(texts))
                break
            except Exception:  # any failure of the remote side is retried
                if attempt < attempts - 1:
                    time.sleep(waits[min(attempt, len(waits) - 1)])
        if answers is None:
            if len(texts) == 1:
                return [None]
            # One attempt each for the halves: a bad prompt is found in a few calls, and a service that is down costs no
            # more waits.
            middle = len(texts) // 2
            return ask(texts[:middle], 1) + ask(texts[middle:], 1)
        if len(answers) != len(texts):
            raise ValueError(f"the model gave {len(answers)} answers to {len(texts)} prompts")
        return answers

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers: list = [None] * len(batch)
            asked = [i for i, p in enumerate(batch[prompt_col]) if p is not None]
            for start in range(0, len(asked), batch_size):
                part = asked[start : start + batch_size]
                for i, answer in zip(part, ask([batch[prompt_col].iloc[i] for i in part])):
                    answers[i] = answer
            yield batch.assign(**{out_col: pd.Series(answers, index=batch.index, dtype="object")})

    # Coalescing moves no rows; what was computed before the call keeps its tasks, as it is cut off from them.
    source = df if concurrency is None else cut_lineage(df).coalesce(concurrency)
    return source.mapInPandas(apply, schema)


def ask(df: DataFrame, prompt: Column, out_col: str, model: Callable[[list[str]], list] | None, **options) -> DataFrame:
    """Answers to a prompt column; without a model the answer is the prompt.

    Model answers are written once (checkpoint), so later steps and lost
    executors do not ask again.
    """
    if model is None or model is identity_model:
        return df.withColumn(out_col, prompt)
    asked = map_with_model(df.withColumn("_prompt", prompt), "_prompt", out_col, model, **options)
    return cut_lineage(asked.drop("_prompt"))
