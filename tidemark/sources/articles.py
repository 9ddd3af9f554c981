"""Article-metadata source and the entries sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.filters import mentions_company, recent

# Article columns, and their names in the entries table.
ARTICLE_COLUMNS = {
    "DATE": "date",
    "V2Themes": "themes",
    "V2Tone": "tone",
    "V2Locations": "locations",
    "V2Persons": "persons",
    "V2Organizations": "organizations",
    "DocumentIdentifier": "document_identifier",
    "AllNames": "all_names",
    "Amounts": "amounts",
}


def select_articles(df: DataFrame, org: str, interval_days: int, as_of: dt.datetime, time_col: str = "partition_time") -> DataFrame:
    """Recent articles that name the company; only the nine article columns are read."""
    kept = mentions_company(recent(df, time_col, as_of, interval_days), org)
    return kept.select(*[c for c in df.columns if c in (*ARTICLE_COLUMNS, "article_id")])


def read_articles(spark: SparkSession, path: str, org: str, interval_days: int, as_of: dt.datetime, time_col: str = "partition_date") -> DataFrame:
    """Articles of a table partitioned by day: folders older than the interval are not listed."""
    return select_articles(spark.read.parquet(path), org, interval_days, as_of, time_col)


def tag_entries(df: DataFrame, call_id: int) -> DataFrame:
    """Entry rows: run id first, columns renamed."""
    return df.select(
        F.lit(call_id).cast("long").alias("call_id"),
        *[F.col(raw).cast("string").alias(name) for raw, name in ARTICLE_COLUMNS.items()],
    )


def write_articles(df: DataFrame, path: str, day: str = "partition_date") -> None:
    """Store articles by day; days that the rows have replace those of the table, so a repeated load changes nothing.

    Rows of a day come together and a large day is split into several files.
    """
    df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append_entries(df: DataFrame, call_id: int, path: str, call_date: dt.date) -> None:
    """Add the tagged rows of a run, partitioned by call date and run.

    A run that is written again replaces its own rows and no others.
    """
    tagged = tag_entries(df, call_id).withColumn("call_date", F.lit(call_date))
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("call_date", "call_id").parquet(path)


def read_entries(spark: SparkSession, path: str, call_id: int | None = None) -> DataFrame:
    """Entry rows as ``tag_entries`` made them, with their call date; of one run, only its folders are listed."""
    rows = spark.read.parquet(path)
    if call_id is not None:
        rows = rows.where(F.col("call_id") == call_id)
    return rows.select(F.col("call_id").cast("long"), *ARTICLE_COLUMNS.values(), F.col("call_date").cast("date"))
