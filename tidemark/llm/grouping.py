"""Union-find grouping of links: forests inside each task, then star steps between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_tables, shared_table


class UnionFind(dict):
    """Disjoint sets of comparable values; a set is known by its smallest member."""

    def find(self, x):
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x], x = root, up
        return root

    def union(self, a, b) -> bool:
        """Join two sets; False if they were one."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self[high] = low
        self.setdefault(low, low)
        return True


#: Links a task joins before it hands on its forest.
FOREST_LINKS = 1 << 18


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): every node of these links under the smallest node that they connect it to."""
    for batch in batches:
        for i in range(0, batch.num_rows, FOREST_LINKS):
            part, sets = batch.slice(i, FOREST_LINKS), UnionFind()
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                sets.union(a, b)
            rows = [(u, sets.find(u)) for u in list(sets)]
            rows = [r for r in rows if r[0] != r[1]]
            kind = part.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k in (0, 1)], names=["u", "v"])


def grouped(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``links (src, dst)``; the root is the smallest node that links reach.

    Tasks turn their links into forests. Alternating large-star and small-star steps (Kiveris et al. 2014) join
    these: minima per node, which combine before the shuffle, and a join on the node, whose hot keys are split at run
    time. The rounds are logarithmic in the longest chain; each one's links are written and the last one's deleted.
    """
    kind = links.schema["src"].dataType.simpleString()
    state = shared_table(links.select("src", "dst").mapInArrow(_forests, f"u {kind}, v {kind}").distinct(), "forest")
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = shared_table(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star"
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = shared_table(small.where("u <> v").distinct(), "small-star")
        done = _same(state, after)
        drop_tables(state, large)
        state = after
        if done:
            roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of links without repeats are equal."""
    digest = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")]
    return a.agg(*digest).first() == b.agg(*digest).first()
