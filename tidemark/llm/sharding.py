"""Sharding by sampled splitters.

Keys are drawn with weights in proportion to sizes, quantiles of the sample become range boundaries, and
overfull ranges are divided again by keys drawn from them. Sizes are then added up range by range in key
order, and a record's shard is where its middle byte falls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fields, n_ranges, range_of, shared_table, splitters

KINDS = "digest string, tie string, row bigint"
#: Times the mean rows or bytes at which a range is overfull, and rounds of dividing such ranges.
OVERFULL, ROUNDS = 2.0, 4


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size and text_crc32 of each row, and its sort key: the text's digest, the id as text, then a row number.

    The number only parts rows that are equal in both, so that they need not be in one range.
    """
    rows = fields(docs, doc_id=doc_id, text=text).withColumn("body", F.coalesce("text", F.lit("")))
    return rows.select(
        "doc_id", (F.octet_length("body") + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(F.col("body").cast("binary")).alias("text_crc32"), F.md5(F.col("body").cast("binary")).alias("digest"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("tie"), F.monotonically_increasing_id().alias("row"),
    )


def _key() -> dict[str, Column]:
    return {name: F.col(name) for name in ("digest", "tie", "row")}


def _loads(rows: DataFrame, cuts: list[dict]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Rows with their range (``part``), and the bounded list of each range's rows and bytes."""
    parted = rows.withColumn("part", range_of(_key(), KINDS, cuts))
    sums = parted.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    return parted, {r["part"]: (r["n"], r["b"]) for r in sums}


def assign_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is ``bytes``: in key order a row belongs to the shard in whose equal part of all bytes its middle
    lies, so a shard differs from the mean by less than the largest row, whatever the number of copies of
    one text. Equal texts are neighbours in key order; only the ``shards`` - 1 cuts part them, each at most one text.
    ``slot`` numbers the rows of a shard in key order; ``grown_shard`` is null (the law makes no promise for
    it). A null text has size 1 and the checksum of an empty one; a null id is an empty key. Rows equal in
    id and text take neighbouring slots. An empty table gives no rows; other columns are not read.
    """
    rows = shared_table(measured(docs, doc_id, text), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    key = _key()
    ranges = n_ranges(n)
    cuts = splitters(rows, key, F.col("size"), float(total), ranges)
    parted, loads = _loads(rows, cuts)
    for _ in range(ROUNDS):
        full = [p for p, (k, b) in loads.items() if k > OVERFULL * n / ranges + 1 or b > OVERFULL * total / ranges + 1]
        if not full:
            break
        inside = parted.where(F.col("part").isin(full))
        k, b = (sum(loads[p][i] for p in full) for i in (0, 1))
        weight = F.lit(1.0 / k) + F.col("size") / F.lit(float(b))
        pieces = int(ranges * (k / n + b / total)) + 2 * len(full)
        more = {tuple(c.values()) for c in cuts} | {tuple(c.values()) for c in splitters(inside, key, weight, 2.0, pieces)}
        if len(more) == len(cuts):
            break
        cuts = [dict(zip(key, c)) for c in sorted(more)]
        parted, loads = _loads(rows, cuts)
    starts, at_row, at_byte = [], 0, 0
    for part in sorted(loads):
        starts.append((part, at_row, at_byte))
        at_row, at_byte = at_row + loads[part][0], at_byte + loads[part][1]
    # One row for each range, whose number is bounded.
    begun = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, rows_before bigint, bytes_before bigint"))
    order = Window.partitionBy("part").orderBy("digest", "tie", "row")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parted.withColumns({"inside": before, "nth": F.row_number().over(order)}).join(begun, "part")
    placed = placed.select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("nth")).alias("rank"),
        F.least(F.lit(shards - 1), F.expr(f"CAST((2 * (bytes_before + inside) + size) * {shards} DIV {2 * max(1, total)} AS INT)")).alias("shard"),
    )
    placed = shared_table(placed, "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
