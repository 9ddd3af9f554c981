"""Hard-negative mining through a GNAT-style multiway hyperplane tree (Brin 1995).

Split points are chosen from a bounded sample of rows, far apart from each other; a row goes to the child of the
nearest split point, so hyperplanes between split points bound the children. For every split point and every sibling
subtree the tree stores the range of distances from the point to the subtree's rows, taken over all rows. A search
asks for a window of scores. Vectors carry one more component that makes all of them equally long, so that a window
of inner products is an annulus of distances around the anchor. With the distance to one split point, the triangle
inequality bounds the distances from that point to all rows in the annulus; a sibling whose range doesn't meet these
bounds is eliminated. The leaves that are left are scanned exactly, in integers, so nothing is missed.

Leaves are stored in blocks of bounded size, and anchors that reach a leaf come in packs, so that one block and one
pack meet in a task at a time, however many rows a leaf or a label has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_tables, shared_table, slices
from tidemark.llm.vector_codes import finite, matrix, padded, scaled
from tidemark.operators.ordering import top_per_key

SCALE = 256.0
#: Positives of an anchor, negatives of a positive, and the share of the positive's score (in hundredths) to reach.
POSITIVES, NEGATIVES, SHARE = 5, 5, 80
#: Rows whose vectors split points are taken from; children of a node; rows a leaf is meant to hold; most levels.
SAMPLE_ROWS, FANOUT, LEAF_ROWS, LEVELS = 4096, 8, 2048, 4
#: Components of a block of leaf rows, and anchors of a pack.
BLOCK_CELLS, PACK_ROWS = 1 << 17, 128
#: Distances give way by this share of the longest vector, for rounding.
SLACK = 1e-6


@dataclass
class Node:
    """An inner node: split points (lifted), children (nodes or leaf numbers) and ranges[child, point] = (low, high)."""

    number: int
    points: np.ndarray
    children: list = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Tree:
    """The root, the squared length all lifted vectors have, and the numbers of nodes and leaves."""

    root: Node | int
    square: float
    nodes: list[Node]
    leaves: int


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    """The vectors with one more component that gives all the same length."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0.0))])


def asking(x: np.ndarray) -> np.ndarray:
    """Anchors as they ask: nothing in the added component, so that it takes no part in inner products."""
    return np.column_stack([x.astype(np.float64), np.zeros(len(x))])


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0.0))


def grow(sample: np.ndarray, square: float, leaves: int, fanout: int = FANOUT) -> Tree:
    """A tree with about so many leaves over the sampled vectors (lifted)."""
    tree = Tree(0, square, [], 0)

    def build(rows: np.ndarray, wanted: float, level: int) -> Node | int:
        distinct = np.unique(rows, axis=0) if wanted > 1 and level < LEVELS else rows[:0]
        if len(distinct) < 2:
            tree.leaves += 1
            return tree.leaves - 1
        count = min(fanout, len(distinct), max(2, math.ceil(wanted)))
        # Points far from each other: each next one is the farthest from those chosen.
        chosen = [0]
        away = distances(distinct, distinct[:1])[:, 0]
        while len(chosen) < count:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, distances(distinct, distinct[chosen[-1:]])[:, 0])
        node = Node(len(tree.nodes), distinct[chosen])
        tree.nodes.append(node)
        own = distances(rows, node.points).argmin(1)
        for c in range(count):
            node.children.append(build(rows[own == c], wanted * (own == c).sum() / len(rows), level + 1))
        return node

    tree.root = build(sample, leaves, 0)
    return tree


def descend(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, list[tuple[Node, np.ndarray, np.ndarray, np.ndarray]]]:
    """Leaf of each lifted vector, and for each node that was passed: the rows, their distances and their children."""
    leaf, passed = np.zeros(len(x), np.int64), []
    todo: list[tuple[Node | int, np.ndarray]] = [(tree.root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            leaf[rows] = node
            continue
        away = distances(x[rows], node.points)
        own = away.argmin(1)
        passed.append((node, rows, away, own))
        todo += [(child, rows[own == c]) for c, child in enumerate(node.children)]
    return leaf, passed


def reached(tree: Tree, x: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) of the anchors (``asking``) whose annuli (inner, outer: row x window) no sibling range eliminates."""
    slack = SLACK * math.sqrt(tree.square) + 1e-9
    todo: list[tuple[Node | int, np.ndarray]] = [(tree.root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield node, rows
            continue
        away = distances(x[rows], node.points)[:, None, :]
        least = np.maximum(np.maximum(away - outer[rows][:, :, None], inner[rows][:, :, None] - away), 0.0) - slack
        most = away + outer[rows][:, :, None] + slack
        for c, child in enumerate(node.children):
            meets = ((least <= node.high[c]) & (most >= node.low[c])).all(2).any(1)
            todo.append((child, rows[meets]))


def _leaves_of(tree: Tree, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            leaf, _ = descend(tree, lifted(matrix(batch.column("v"), width), tree.square))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return run


def _ranges_of(tree: Tree, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.full((len(n.points),) * 2, np.inf) for n in tree.nodes]
        high = [np.full((len(n.points),) * 2, -np.inf) for n in tree.nodes]
        for batch in slices(batches, 4096):
            for node, _, away, own in descend(tree, lifted(matrix(batch.column("v"), width), tree.square))[1]:
                for c in np.unique(own):
                    low[node.number][c] = np.minimum(low[node.number][c], away[own == c].min(0))
                    high[node.number][c] = np.maximum(high[node.number][c], away[own == c].max(0))
        rows = [(n.number, c, p, low[n.number][c, p], high[n.number][c, p]) for n in tree.nodes
                for c, p in np.argwhere(np.isfinite(low[n.number]))]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["node", "child", "point", "low", "high"]
        )

    return run


def _measure(tree: Tree, rows: DataFrame, width: int) -> None:
    """Set the tree's ranges, over all rows; fanout squared numbers a node reach the driver."""
    for node in tree.nodes:
        # A subtree without rows keeps an empty range, which meets nothing.
        node.low, node.high = np.full((len(node.points),) * 2, np.inf), np.full((len(node.points),) * 2, -np.inf)
    each = rows.select("v").mapInArrow(_ranges_of(tree, width), "node bigint, child bigint, point bigint, low double, high double")
    for r in each.groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.nodes[r["node"]].low[r["child"], r["point"]] = r["low"]
        tree.nodes[r["node"]].high[r["child"], r["point"]] = r["high"]


@dataclass
class Index:
    """The tree, all rows (vec_id, label, v, leaf) and the leaves' blocks (leaf, rows: sorted members)."""

    tree: Tree
    rows: DataFrame
    blocks: DataFrame
    width: int


def build_index(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = SCALE,
    sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS,
) -> Index | None:
    """Index of all rows with a label and a finite vector; None if there are none.

    Components become floor(scale * x), shorter vectors are padded with zeros. Split points come from the
    ``sample_rows`` rows with the smallest hashes of id and vector; the ranges and the leaves hold every row.
    """
    source = df.select(df[vec_id].alias("vec_id"), df[label].alias("label"), df[vector].alias("v"))
    kept = source.where(F.col("label").isNotNull() & finite(F.col("v"))).withColumn("v", scaled(F.col("v"), scale))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = kept.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(square).alias("square")).first()
    if not size["n"]:
        return None
    width = max(1, size["width"])
    rows = kept.withColumn("v", padded(F.col("v"), width))
    drawn = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h", "v").limit(sample_rows).select("v").collect()
    reach = size["square"] * (1 + SLACK)
    sample = lifted(np.array([r["v"] for r in drawn], np.int64), reach)
    tree = grow(sample, reach, -(-size["n"] // leaf_rows))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<bigint>, leaf bigint"
    placed = shared_table(rows.mapInArrow(_leaves_of(tree, width), schema), "gnat-rows")
    _measure(tree, placed, width)
    block_rows = max(1, BLOCK_CELLS // width)
    counts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).alias("slots"))
    slot = F.pmod(F.xxhash64("vec_id", "v"), "slots")
    member = F.struct(F.col("vec_id").isNull().alias("last"), "vec_id", "label", "v")
    blocks = placed.join(F.broadcast(counts), "leaf").groupBy("leaf", slot.alias("slot")).agg(F.array_sort(F.collect_list(member)).alias("rows"))
    return Index(tree, placed, shared_table(blocks.select("leaf", "rows"), "gnat-blocks"), width)


def _annuli(tree: Tree, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner and outer distances of rows whose scores with x lie between low and high (row x window)."""
    square = np.maximum(tree.square, 0) + (x.astype(np.float64) ** 2).sum(1)[:, None]
    slack = SLACK * tree.square
    return np.sqrt(np.maximum(square - 2 * high - slack, 0.0)), np.sqrt(np.maximum(square - 2 * low + slack, 0.0))


def _visits(tree: Tree, width: int, home: bool | None):
    """For each anchor the leaves to scan: its own (True), all others that its windows reach (False), or both (None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x = matrix(batch.column("v"), width)
            windows = [[(w["low"], w["high"]) for w in ws] for ws in batch.column("windows").to_pylist()]
            most = max(map(len, windows), default=1) or 1
            low, high = np.full((len(x), most), np.inf), np.full((len(x), most), -np.inf)
            for i, ws in enumerate(windows):
                for k, (a, b) in enumerate(ws):
                    low[i, k], high[i, k] = -np.inf if a is None else a, np.inf if b is None else b
            own, _ = descend(tree, lifted(x, tree.square))
            if home:
                found = [(int(leaf), np.flatnonzero(own == leaf)) for leaf in np.unique(own)]
            else:
                with np.errstate(invalid="ignore"):
                    inner, outer = _annuli(tree, x, low, high)
                empty = low > high
                inner[empty], outer[empty] = np.inf, -np.inf
                found = [(leaf, rows if home is None else rows[own[rows] != leaf]) for leaf, rows in reached(tree, asking(x), inner, outer)]
            for leaf, rows in found:
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf)), *part.columns], names=["leaf", *part.schema.names])

    return run


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both; beyond 53 bits by Python integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def _scan(width: int, k: int, same: bool, kind: pa.DataType):
    """The best k rows of a block for each anchor and window of a pack, by score and then position in id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack, block = batch.column("pack")[i].values, batch.column("rows")[i].values
                ids, a_ids = block.field("vec_id"), pack.field("anchor_id")
                table = scores(matrix(pack.field("v"), width), matrix(block.field("v"), width))
                equal = _codes(pack.field("label"), block.field("label"))
                fits = equal if same else ~equal
                fits &= ~_codes(a_ids, ids)
                windows = pack.field("windows").to_pylist()
                out: list[tuple[np.ndarray, ...]] = []
                for n in range(max(map(len, windows), default=0)):
                    low = np.array([w[n]["low"] if n < len(w) and w[n]["low"] is not None else None for w in windows], object)
                    high = np.array([w[n]["high"] if n < len(w) and w[n]["high"] is not None else None for w in windows], object)
                    held = fits & np.array([n < len(w) for w in windows])[:, None]
                    for bound, above in ((low, True), (high, False)):
                        known = np.flatnonzero([b is not None for b in bound])
                        if len(known):
                            limit = bound[known].astype(table.dtype)[:, None]
                            held[known] &= table[known] >= limit if above else table[known] <= limit
                    r, c = np.nonzero(held)
                    value = table[r, c]
                    order = np.lexsort((c, -value, r))
                    r, c, value = r[order], c[order], value[order]
                    first = np.searchsorted(r, r)
                    best = np.arange(len(r)) - first < k
                    out.append((r[best], c[best], value[best], np.full(int(best.sum()), n)))
                if not out:
                    continue
                r, c, value, n = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [a_ids.take(pa.array(r)), pa.array(n.astype(np.int64)), ids.take(pa.array(c)), pa.array([int(v) for v in value], pa.int64())],
                    names=["anchor_id", "window", "vec_id", "score"],
                )

    return run


def _codes(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Matrix of equality of two columns; nulls equal nothing."""
    both = pa.concat_arrays([a, b]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    left, right = both[: len(a)], both[len(a) :]
    return (left[:, None] == right[None, :]) & (left >= 0)[:, None]


def search(index: Index, anchors: DataFrame, k: int, same: bool, home: bool | None = None) -> DataFrame:
    """(anchor_id, window, vec_id, score): at least the best k rows of each window of each anchor.

    ``anchors`` (anchor_id, label, v, windows): windows are arrays of (low, high) scores, both ends included, null for
    no bound. ``same`` asks for rows of the anchor's label, else of another; never for its id. A block hands on k rows a
    window; the best over all blocks are for the caller to take.
    """
    ids = index.rows.schema["vec_id"].dataType
    label = index.rows.schema["label"].dataType.simpleString()
    schema = f"leaf bigint, anchor_id {ids.simpleString()}, label {label}, v array<bigint>, windows array<struct<low:bigint,high:bigint>>"
    asked = anchors.select("anchor_id", "label", "v", F.col("windows").cast("array<struct<low:bigint,high:bigint>>").alias("windows"))
    visits = shared_table(asked.mapInArrow(_visits(index.tree, index.width, home), schema), "gnat-visits")
    counts = visits.groupBy("leaf").agg(F.ceil(F.count("*") / PACK_ROWS).alias("slots"))
    slot = F.pmod(F.xxhash64("anchor_id"), "slots")
    packs = visits.join(F.broadcast(counts), "leaf").groupBy("leaf", slot.alias("slot")).agg(
        F.collect_list(F.struct("anchor_id", "label", "v", "windows")).alias("pack")
    )
    met = packs.join(index.blocks, "leaf").select("pack", "rows")
    found = met.mapInArrow(_scan(index.width, k, same, None), f"anchor_id {ids.simpleString()}, window bigint, vec_id {ids.simpleString()}, score bigint")
    out = shared_table(found, "gnat-found")
    drop_tables(visits)
    return out


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]


def mine(
    index: Index, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors.

    ``anchors`` is a condition on vec_id. The score is the integer inner product with the anchor; higher ones come
    first, ties by smaller id (null ids last). An anchor's positives are its best other rows of the same label, a
    positive's negatives the best rows of other labels whose score lies between ``share`` hundredths of the
    positive's and the positive's. A positive below zero has none. A row is another one if its id is another; rows
    that repeat an id each count, and of anchor rows that repeat an id the one with the smallest label and vector asks.
    """
    asking = index.rows.where(anchors & F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").alias("anchor_id"))
    asked = shared_table(asking.agg(F.min(F.struct("label", "v")).alias("a")).select("anchor_id", "a.label", "a.v"), "gnat-anchors")

    def window(low: Column, high: Column) -> Column:
        return F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))

    none = F.lit(None)
    # The anchor's own leaf gives a score that the best rows of all other leaves have to reach.
    near = search(index, asked.withColumn("windows", F.array(window(none, none))), positives, True, home=True)
    own = shared_table(top_per_key(near, ["anchor_id"], _order(), positives), "gnat-home")
    reach = own.groupBy("anchor_id").agg(F.when(F.count("*") == positives, F.min("score")).alias("reach"))
    wide = asked.join(reach, "anchor_id", "left").withColumn("windows", F.array(window(F.col("reach"), none)))
    far = search(index, wide, positives, True, home=False)
    best = shared_table(
        top_per_key(own.drop("rank").unionByName(far), ["anchor_id"], _order(), positives)
        .select("anchor_id", (F.col("rank") - 1).cast("bigint").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "gnat-positives",
    )
    # ceil(share * score / 100) in whole numbers; a window of a negative score is empty.
    low = -F.expr(f"(-{share} * CAST(positive_score AS DECIMAL(38,0)) - pmod(-{share} * CAST(positive_score AS DECIMAL(38,0)), 100)) / 100").cast("bigint")
    listed = F.sort_array(F.collect_list(F.struct("window", low.alias("low"), F.col("positive_score").alias("high"))))
    windows = best.groupBy("anchor_id").agg(F.transform(listed, lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    found = search(index, asked.join(windows, "anchor_id"), negatives, False)
    ranked = top_per_key(found, ["anchor_id", "window"], _order(), negatives)
    return ranked.join(best, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
