"""Registry of named queries and their checking SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.checks.fixtures import Tables, with_inputs
from tidemark.session import ensure_checkpoint_dir, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, inputs: tuple[str, ...] = ()):
    """Register a function of ``Tables`` as a query; ``sql`` is its check."""

    def register(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(Tables(tune(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_inputs(sql, *inputs) if inputs else sql.strip()
        return make

    return register


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes, where all executors see it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
