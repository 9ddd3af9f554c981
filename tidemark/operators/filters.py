"""Row filters. Every predicate is a built-in expression that can be pushed down."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form types the filing views accept.
FORM_TYPES = ("10-K", "10-Q", "8-K")
NOISE = -1


def recent(df: DataFrame, time_col: str, as_of: dt.datetime, interval_days: int) -> DataFrame:
    """Rows not older than ``interval_days`` before ``as_of`` (inclusive)."""
    start = as_of - dt.timedelta(days=interval_days)
    return df.where(F.col(time_col) >= F.lit(start))


def mentions_company(df: DataFrame, name: str, column: str = "V2Organizations") -> DataFrame:
    """Rows whose organisations contain the name, ignoring case; no wildcards."""
    return df.where(F.lower(F.col(column)).contains(name.lower()))


def drop_noise(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.where(F.col(cluster) != F.lit(NOISE))


def health_cutoff(df: DataFrame, score: str, cutoff: float = 0.0) -> DataFrame:
    """Clusters whose score lies above the cutoff."""
    return df.where(F.col(score) > F.lit(cutoff))


def drop_irrelevant(df: DataFrame, flag: str = "irrelevant") -> DataFrame:
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def median_between(
    df: DataFrame, start: dt.date, end: dt.date, column: str = "median_date"
) -> DataFrame:
    """Inclusive range; the end bound is midnight at the start of the end day."""
    return df.where(F.col(column).cast("timestamp").between(F.lit(start).cast("timestamp"),
                                                            F.lit(end).cast("timestamp")))


def clamp_range(
    start: Column, end: Column, call_time: Column, interval_days: Column, clamp: bool = False
) -> tuple[Column, Column]:
    """Requested date range, reset to the call's whole window when it leaves it."""
    if not clamp:
        return start, end
    last = call_time.cast("date")
    first = F.date_sub(last, interval_days.cast("int"))
    outside = (start < first) | (end > last)
    return F.when(outside, first).otherwise(start), F.when(outside, last).otherwise(end)


def form_types(df: DataFrame, column: str = "formType", types: tuple[str, ...] = FORM_TYPES) -> DataFrame:
    unknown = set(types) - set(FORM_TYPES)
    if unknown:
        raise ValueError(f"Invalid form type provided: {sorted(unknown)}")
    return df.where(F.col(column).isin(*types))


def where_metadata(df: DataFrame, metadata: Mapping[str, str]) -> DataFrame:
    """All of the given equalities."""
    for name, value in metadata.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def has_metadata(df: DataFrame, metadata: Mapping[str, str]) -> DataFrame:
    """One row telling whether any document matches; reads until the first hit."""
    hit = where_metadata(df, metadata).select(F.lit(1).alias("_hit")).limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def unsegmented(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("segment").isNull())


def active_alerts(alerts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Alerts of users whose profile has alerts switched on."""
    on = profiles.where("alert_status").select("user_id")
    return alerts.join(on, "user_id", "left_semi")
