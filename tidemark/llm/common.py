"""Helpers the operators of this package share."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ensure_checkpoint_dir

#: Rows (or row weights) a range of a sorted sweep is meant to hold, and the bounds on the number of ranges.
ROWS_PER_RANGE = 200_000
MIN_RANGES, MAX_RANGES = 64, 16_384
#: Sampled keys per range; the sample is at most MAX_RANGES times this.
SAMPLES_PER_RANGE = 24
#: Characters of a text key that a splitter keeps: any value between two keys may split them.
SPLITTER_CHARS = 128

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet into the shared checkpoint folder and read again.

    Cuts the lineage, can be read by column and survives the loss of executors.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that a task holds few texts at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def keep_freed_memory(size: int = 16 << 20) -> None:
    """From now on the process keeps freed arrays of up to this size for the next ones.

    The C library hands freed blocks back to the system, which clears each page anew, until a block as large as
    this was freed. Loops over arrays of a few hundred KB spend half of their time in that.
    """
    np.empty(size, np.uint8)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_024) -> Iterator[None]:
    """What runs in this block hands at most so many rows at once to Python: texts are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lower_ascii(text: Column) -> Column:
    """The text with A to Z in lower case and all else as it is."""
    return F.translate(text, UPPER, LOWER)


def fields(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, whatever else the table holds."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def n_ranges(rows: int) -> int:
    """Ranges for a sorted sweep over so many rows."""
    return min(MAX_RANGES, max(MIN_RANGES, -(-rows // ROWS_PER_RANGE)))


def splitters(df: DataFrame, key: dict[str, Column], weight: Column, total: float, ranges: int) -> list[dict]:
    """Boundaries that cut the rows, sorted by ``key``, into ranges of about equal weight.

    A row of weight w is drawn about ``SAMPLES_PER_RANGE * ranges * w / total`` times, by a hash of its
    key, so the same rows give the same boundaries; only this bounded sample reaches the driver.
    """
    if total <= 0 or ranges < 2:
        return []
    rate = SAMPLES_PER_RANGE * ranges / total
    point = (F.xxhash64(F.lit(7919), *key.values()).bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))).cast("double")
    drawn = df.select(
        *[_short(df, c).alias(n) for n, c in key.items()],
        F.floor(weight * F.lit(float(rate)) + point).alias("copies_"),
    ).where("copies_ > 0")
    sample = drawn.orderBy(*key).collect()
    heavy = sum(min(r["copies_"], 2**31) for r in sample)
    out: list[dict] = []
    step, seen, due = heavy / ranges, 0.0, 1
    for row in sample:
        seen += row["copies_"]
        if seen >= due * step and due < ranges:
            value = {n: row[n] for n in key}
            if not out or out[-1] != value:
                out.append(value)
            due = int(seen / step) + 1
    return out


def _short(df: DataFrame, column: Column) -> Column:
    kind = df.select(column.alias("c")).schema["c"].dataType
    return F.substring(column, 1, SPLITTER_CHARS) if isinstance(kind, T.StringType) else column


def range_of(key: dict[str, Column], kinds: str, cuts: list[dict]) -> Column:
    """Number of boundaries at or below the key: the range it falls in, by binary search."""
    if not cuts:
        return F.lit(0)
    sorted_cuts = F.from_json(F.lit(json.dumps(cuts)), f"array<struct<{kinds}>>")
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    own = F.struct(*[c.alias(n) for n, c in key.items()])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(F.get(sorted_cuts, low + step - 1) <= own, low + step).otherwise(low),
    )


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of ``shared_table`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
