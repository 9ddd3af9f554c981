"""Latest-row and top-k operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.health import combined_health
from tidemark.functions.vectors import cosine
from tidemark.operators.filters import FORM_TYPES, form_types
from tidemark.operators.ordering import first_per_key, latest_per_key, top_per_key


def latest_call(calls: DataFrame, on_day: dt.date | None = None) -> DataFrame:
    """Newest call per stock; with ``on_day`` only among that day's calls."""
    if on_day is not None:
        calls = calls.where(F.col("call_time").cast("date") == F.lit(on_day))
    return latest_per_key(calls, ["stock_id"], ["call_time", "call_id"])


def latest_filing(filings: DataFrame, types: tuple[str, ...] = FORM_TYPES) -> DataFrame:
    """Newest filing per ticker among the accepted form types."""
    return latest_per_key(form_types(filings, types=types), ["ticker"], ["filedAt", "accessionNo"])


def filings_dashboard(filings: DataFrame, ticker: str = "", size: int = 10) -> DataFrame:
    """All filings of one ticker, newest first; without a ticker the newest few."""
    newest = [F.desc("filedAt"), F.desc("accessionNo")]
    if ticker:
        return filings.where(F.col("ticker") == F.lit(ticker)).orderBy(*newest)
    return filings.orderBy(*newest).limit(size)


def health_order(events: DataFrame, variance_weight: float | None = None) -> DataFrame:
    """Add the combined health score."""
    extra = {} if variance_weight is None else {"variance_weight": variance_weight}
    return events.withColumn(
        "score", combined_health("size_importance", "cohesiveness", "time_variance", **extra)
    )


def top_events(events: DataFrame, n: int = 50, keys: Sequence[str] = ("call_id",), tie: str = "event_id") -> DataFrame:
    """Best ``n`` events of each call by combined health; NULL scores come first."""
    order = [F.col("score").desc_nulls_first(), F.asc(tie)]
    return top_per_key(health_order(events), keys, order, n)


def rank_by_similarity(
    events: DataFrame, query: Column, n: int | None, vec: str = "summary_embedding", tie: str = "event_id"
) -> DataFrame:
    """Top ``n`` events by cosine to one query vector; None keeps all, in no order."""
    scored = events.withColumn("similarity", cosine(F.col(vec), query))
    if n is None:
        return scored
    return scored.orderBy(F.col("similarity").desc_nulls_last(), F.asc(tie)).limit(n)


def top_clusters(df: DataFrame, ranks: DataFrame, n: int = 10, rank_col: str = "rank", cluster: str = "cluster", run: Sequence[str] = ()) -> DataFrame:
    """Article rows of the ``n`` best-ranked clusters."""
    order = [F.col(rank_col).desc_nulls_last(), F.asc(cluster)]
    if run:
        best = top_per_key(ranks, run, order, n, "_place")
    else:
        best = ranks.orderBy(*order).limit(n)
    return df.join(best.select(*run, cluster), [*run, cluster], "left_semi")


def first_fact(facts: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    """First fact of each key in document order, NULL values included."""
    return first_per_key(facts, keys, [position])
