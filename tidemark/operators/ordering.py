"""Order-aware building blocks that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

# Rows concatenated into one text value. Longer groups come out as several
# numbered parts whose concatenation is the whole text.
PART_SIZE = 1000
# Rows of one key that may be ordered by a single task.
SLICE_ROWS = 200_000
# Most slices of a key, and sampled rows of a slice.
MAX_SLICES = 4_096
SAMPLES = 48


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key: the greatest by ``order``, NULLs last.

    ``max`` over a struct combines before the shuffle, so a hot key sends one
    row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key: the smallest by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key. Spark cuts to ``n`` before the shuffle as well."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def ordered_positions(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), position: str = "position"
) -> DataFrame:
    """Exact 0-based position of each row inside its key, by ``order`` and ``ties`` (NULLs first).

    A key with more than ``SLICE_ROWS`` rows is cut into slices at quantiles of a sample of its own rows, so slices are
    about equal however the values lie, and rows that are equal in ``order`` are parted by their ties, then by a hash.
    Slices are numbered separately and shifted by the rows before them, so one key uses many tasks. The rows are read
    several times, so they are written once first. A key's sample is one row of at most ``MAX_SLICES`` cuts.
    """
    keys, columns = list(keys), df.columns
    # Rows that agree in all of these are alike; which of them comes first doesn't matter.
    place = F.struct(F.col(order).alias("o"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)], F.xxhash64(*columns).alias("h"))
    rows = cut_lineage(df.withColumn("_place", place))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    large = counts.where(F.col("_rows") > SLICE_ROWS).withColumn(
        "_slices", F.least(F.ceil(F.col("_rows") / F.lit(SLICE_ROWS)), F.lit(MAX_SLICES))
    )
    found = large.limit(MAX_SLICES + 1).count()
    if not found:
        number = F.row_number().over(W.partitionBy(*keys).orderBy("_place")).cast("long")
        return rows.select(*columns, (number - 1).alias(position))
    # A row is drawn by its hash; a slice gets about SAMPLES rows of the sample.
    share = F.col("_slices") * F.lit(float(SAMPLES)) / F.col("_rows")
    drawn = rows.join(F.broadcast(large) if found <= MAX_SLICES else large, keys).where(
        F.pmod(F.xxhash64(F.lit(17), "_place.h"), F.lit(1 << 30)) < share * F.lit(float(1 << 30))
    )
    numbered = drawn.select(
        *keys, "_slices", "_place", F.row_number().over(W.partitionBy(*keys).orderBy("_place")).alias("_i"),
        F.count("*").over(W.partitionBy(*keys)).alias("_drawn"),
    )
    due = F.floor((F.col("_i") - 1) * F.col("_slices") / F.col("_drawn"))
    cuts = numbered.where((due > F.floor((F.col("_i") - 2) * F.col("_slices") / F.col("_drawn"))) & (F.col("_i") > 1))
    cuts = cut_lineage(cuts.groupBy(*keys).agg(F.sort_array(F.collect_list("_place")).alias("_cuts")))
    sliced = rows.join(cuts, keys, "left").withColumn("_slice", _cuts_below("_cuts", "_place")).drop("_cuts")
    before = (
        sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(W.partitionBy(*keys).orderBy("_slice")))
        .select(*keys, "_slice", (F.col("_end") - F.col("_n")).alias("_before"))
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy("_place"))
    return (
        sliced.withColumn("_inside", inside)
        .join(before, [*keys, "_slice"])
        .select(*columns, (F.col("_before") + F.col("_inside") - F.lit(1)).alias(position))
    )


def _cuts_below(cuts: str, place: str) -> Column:
    """Number of sorted cuts at or below the place, by binary search; 0 without cuts."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(MAX_SLICES.bit_length()))])
    below = F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.get(F.col(cuts), low + step - 1) <= F.col(place), low + step).otherwise(low)
    )
    return F.when(F.col(cuts).isNull(), F.lit(0)).otherwise(below)


def concat_in_order(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    text: Column,
    out: str,
    sep: str = "",
    part_size: int = PART_SIZE,
) -> DataFrame:
    """Text of each key joined by position, in parts of ``part_size`` rows.

    ``position`` counts from 0 without large gaps, so a part is bounded. Output:
    keys, ``part`` and the text; most keys have the single part 0.
    """
    part = F.floor(F.col(position) / F.lit(part_size)).cast("long")
    rows = df.select(*keys, part.alias("part"), F.col(position).alias("_pos"), text.alias("_text"))
    pairs = F.sort_array(F.collect_list(F.struct("_pos", "_text")))
    return rows.groupBy(*keys, "part").agg(
        F.array_join(F.transform(pairs, lambda p: p["_text"]), sep).alias(out)
    )


def join_parts(parts: DataFrame, keys: Sequence[str], out: str, sep: str = "") -> DataFrame:
    """One row per key: the parts of ``concat_in_order`` joined again, in part order.

    For texts that are one value by their use (a prompt), whatever the number of parts.
    """
    pairs = F.sort_array(F.collect_list(F.struct("part", out)))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p[out]), sep).alias(out))
