"""Set joins between runs, events, filings, portfolios and alerts.

No side is forced to be broadcast: Spark does that by itself below its size
threshold and splits hot keys of larger sides at run time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import first_per_key


def enrich_events(events: DataFrame, stocks: DataFrame, calls: DataFrame) -> DataFrame:
    """Events with the name and ticker of their stock and the time of their call."""
    return events.join(stocks, "stock_id").join(calls.select("call_id", "call_time", "interval"), "call_id")


def unprocessed(events: DataFrame, processed: DataFrame) -> DataFrame:
    """Events without a processed row."""
    return events.join(processed.select("event_id"), "event_id", "left_anti")


def processed_in_order(events: DataFrame, processed: DataFrame, tie: str = "processed_id") -> DataFrame:
    """First processed row of each event, carrying the event's rank."""
    first = first_per_key(processed, ["event_id"], [tie])
    return events.select("event_id", "rank").join(first, "event_id")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, tie: str) -> DataFrame:
    """Existing rows plus incoming rows with unknown keys, one per key."""
    fresh = first_per_key(incoming.join(existing.select(key), key, "left_anti"), [key], [tie])
    return existing.unionByName(fresh)


def available_stocks(stocks: DataFrame, portfolio: DataFrame, user_id: int) -> DataFrame:
    """Stocks not yet in the user's portfolio."""
    owned = portfolio.where(F.col("user_id") == F.lit(user_id)).select("stock_id")
    return stocks.join(owned, "stock_id", "left_anti")


def alert_fan_out(alerts: DataFrame, users: DataFrame, alert_stocks: DataFrame, stocks: DataFrame, areas: DataFrame) -> DataFrame:
    """One row per (alert, stock, area); stocks without areas keep a NULL area."""
    return (
        alerts.join(users, "user_id")
        .join(alert_stocks, "alert_id")
        .join(stocks, "stock_id")
        .join(areas, "alert_stock_id", "left")
    )


def outside_portfolio(alert_stocks: DataFrame, alerts: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Alert stocks that their owner does not hold."""
    owned = alert_stocks.join(alerts.select("alert_id", "user_id"), "alert_id")
    return owned.join(portfolio.select("user_id", "stock_id"), ["user_id", "stock_id"], "left_anti")


def parent_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Original chunk and section behind each summary hit."""
    parents = chunks.select("doc_id", F.col("original_content").alias("page_content"),
                            F.col("filing_section").alias("source"))
    return hits.join(parents, "doc_id")


def question_pairs(companies: DataFrame, questions: Mapping[str, str], ticker: str = "ticker") -> DataFrame:
    """Every question of the bank for every company.

    The bank is a short literal list, so this is one ``explode`` per company row
    and needs no join.
    """
    bank = F.array(
        *[
            F.struct(F.lit(i).alias("question_no"), F.lit(t).alias("topic"), F.lit(q).alias("template"))
            for i, (t, q) in enumerate(questions.items())
        ]
    )
    rows = companies.select(ticker).distinct().withColumn("_q", F.explode(bank))
    return rows.select(
        ticker, "_q.question_no", "_q.topic",
        F.replace(F.col("_q.template"), F.lit("{company}"), F.col(ticker)).alias("question"),
    )


def position_of(positions: DataFrame, portfolios: DataFrame, stocks: DataFrame) -> DataFrame:
    """Position rows with owner and ticker, looked up by (portfolio, stock)."""
    return positions.join(portfolios.select("portfolio_id", "user_id"), "portfolio_id").join(
        stocks.select("stock_id", "ticker"), "stock_id"
    )
