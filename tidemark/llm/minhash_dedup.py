"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A text's set is its distinct runs of ``words`` words. Texts with equal sets are one class, and only classes go on.
A signature is cut into bands; classes that agree in a band are in one list. At the least similarity of 0.85 a pair
misses all 24 bands of four slots in fewer than one case in 20 million, and every candidate is confirmed on full sets:

- in a list of up to ``LIST_ROWS`` classes all pairs are candidates;
- in a larger list every class is first held against the list's hub, the class that shares lists with most others;
- if that leaves classes of a large list in different groups, the list's sets are packed into blocks and the blocks
  that hold an ungrouped class meet all others. A pair of blocks counts all shared elements at once and hands on only
  the links that join groups, so no pair of texts is ever a row, and no link between two groups is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_tables, fields, shared_table, slices
from tidemark.llm.grouping import UnionFind, grouped
from tidemark.llm.superminhash import WordHashes, mixed, shingle_set, signatures

WORDS = 3
#: Link two sets when 100 * shared >= PERCENT * united.
PERCENT = 85
#: Slots of a band; the signature's 96 slots make 24 bands.
BAND_SLOTS = 4
#: Classes of a list up to which all its pairs are candidates.
LIST_ROWS = 12
#: Classes and set elements of a block of a large list.
BLOCK_ROWS, BLOCK_ELEMENTS = 128, 1 << 17
#: Distinct elements that two blocks count at once.
COLUMNS = 1 << 14


def _digest(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.astype("<u8").tobytes())


def _bands(signature: np.ndarray) -> np.ndarray:
    """A value for each band of each row, which differs from band to band."""
    cut = signature.reshape(len(signature), -1, BAND_SLOTS)
    out = np.broadcast_to(np.arange(cut.shape[1], dtype=np.uint64), cut.shape[:2]).copy()
    for i in range(BAND_SLOTS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return out.view(np.int64)


def _described(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, 256):
            sets = [shingle_set(t, words, known) for t in batch.column("text").to_pylist()]
            bands = _bands(signatures(sets))
            listed = [b if len(s) else None for s, b in zip(sets, bands)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(listed, pa.list_(pa.int64())),
                ],
                names=["doc_id", "mark", "node", "n", "bands"],
            )

    return run


def _packed_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, 256):
            sets = [shingle_set(t, words, known).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "elements"])

    return run


def _linked(shared, a, b):
    """Whether sets of these sizes with so many shared elements link."""
    return 100 * shared >= PERCENT * (a + b - shared)


def _near(a: str, b: str):
    """Whether sets of these sizes can link at all: they share no more than the smaller one holds."""
    return F.lit(100) * F.least(a, b) >= F.lit(PERCENT) * F.greatest(a, b)


def _members(rows: pa.Array) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Nodes, roots, sizes and all elements of a block's members."""
    elements = rows.field("elements")
    return rows.field("node").to_pylist(), rows.field("root").to_pylist(), elements.value_lengths().to_numpy(), elements.flatten().to_numpy()


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (src, dst) between a left block's members and those of both blocks that join different groups."""
    for batch in batches:
        left, right = batch.column("left"), batch.column("right")
        for k in range(batch.num_rows):
            nodes, roots, sizes, elements = _members(left[k].values)
            mine = len(nodes)
            if right[k].is_valid:
                more = _members(right[k].values)
                nodes, roots = nodes + more[0], roots + more[1]
                sizes, elements = np.concatenate([sizes, more[2]]), np.concatenate([elements, more[3]])
            owner = np.repeat(np.arange(len(nodes)), sizes)
            values, at = np.unique(elements, return_inverse=True)
            # An element counts if a left member shares it with another set.
            often = np.bincount(at, minlength=len(values)) > 1
            often[np.setdiff1d(np.arange(len(values)), at[owner < mine])] = False
            column, keep, width = np.cumsum(often) - 1, often[at], int(often.sum())
            order = np.argsort(column[at[keep]], kind="stable")
            o, c = owner[keep][order], column[at[keep]][order]
            shared = np.zeros((mine, len(nodes)), np.float32)
            for start in range(0, width, COLUMNS):
                lo, hi = np.searchsorted(c, [start, start + COLUMNS])
                held = np.zeros((len(nodes), min(COLUMNS, width - start)), np.float32)
                held[o[lo:hi], c[lo:hi] - start] = 1
                shared += held[:mine] @ held.T
            close = _linked(shared.astype(np.int64), sizes[:mine, None], sizes[None, :])
            sets, found = UnionFind(), []
            for node, root in zip(nodes, roots):
                sets.union(("root", root), ("node", node))
            for i, j in zip(*np.nonzero(np.triu(close, 1))):
                if sets.union(("node", nodes[i]), ("node", nodes[j])):
                    found.append((nodes[i], nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.binary()) for n in (0, 1)], names=["src", "dst"])


def _open_blocks(large: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of large lists (hub, node) between classes that ``roots`` leaves in different groups."""
    sided = shared_table(
        large.select("hub", "node").distinct().join(roots, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root")), "minhash-sided"
    )
    parts = sided.groupBy("hub", "root").agg(F.count("*").alias("rows"))
    mains = parts.groupBy("hub").agg(F.max(F.struct("rows", "root")).alias("top"), F.count("*").alias("parts"), F.sum("rows").alias("all_rows"))
    mains = mains.where("parts > 1").select("hub", F.col("top.root").alias("main"), "all_rows")
    open_rows = sided.join(mains, "hub").withColumn("outer", F.col("root") != F.col("main"))
    held = shared_table(open_rows.join(sets, "node"), "minhash-held")
    # Members of the main group and the others go to blocks of their own, by size: only sizes that are near can link.
    band = F.floor(F.log(F.size("elements").cast("double")) / F.log(F.lit(100.01 / PERCENT))).cast("long")
    banded = held.select("hub", "node", "root", "outer", "elements", band.alias("band"))
    counts = banded.groupBy("hub", "band", "outer").agg(F.count("*").alias("c"), F.sum(F.size("elements")).alias("e"))
    slots = F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("e") / BLOCK_ELEMENTS))
    counts = shared_table(counts.select("hub", "band", "outer", slots.alias("slots")), "minhash-slots")
    placed = banded.join(counts, ["hub", "band", "outer"]).withColumn("slot", F.pmod(F.xxhash64("node"), "slots"))
    member = F.struct("node", "root", "elements")
    blocks = shared_table(placed.groupBy("hub", "band", "outer", "slot").agg(F.collect_list(member).alias("members")), "minhash-blocks")
    listed = counts.select("hub", "band", "outer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    a = listed.where("outer").select("hub", F.col("band").alias("band"), "slot", F.explode(F.array([F.col("band") + d for d in (-1, 0, 1)])).alias("other_band"))
    b = listed.select("hub", F.col("band").alias("other_band"), F.col("outer").alias("other_outer"), F.col("slot").alias("other_slot"))
    # Two outer blocks meet once; a block meets itself.
    met = a.join(b, ["hub", "other_band"]).where(~F.col("other_outer") | (F.struct("band", "slot") <= F.struct("other_band", "other_slot")))
    left = blocks.where("outer").select("hub", "band", "slot", F.col("members").alias("left"))
    right = blocks.select(
        "hub", F.col("band").alias("other_band"), F.col("outer").alias("other_outer"), F.col("slot").alias("other_slot"), F.col("members").alias("right")
    )
    same = F.col("other_outer") & (F.col("band") == F.col("other_band")) & (F.col("slot") == F.col("other_slot"))
    pairs = met.join(left, ["hub", "band", "slot"]).join(right, ["hub", "other_band", "other_outer", "other_slot"])
    spread = pairs.select("left", F.when(~same, F.col("right")).alias("right"))
    links = shared_table(spread.mapInArrow(_block_links, "src binary, dst binary"), "minhash-block-links")
    drop_tables(sided, held, counts, blocks)
    return links


def near_links(rows: DataFrame, described: DataFrame, words: int = WORDS) -> DataFrame:
    """Links (src, dst) that connect all classes whose sets are near enough; see the module's text."""
    classes = described.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    postings = shared_table(classes.select("node", "n", F.explode("bands").alias("v")), "minhash-postings")
    lists = shared_table(postings.groupBy("v").agg(F.count("*").alias("size")).where("size > 1"), "minhash-lists")
    members = shared_table(postings.join(lists, "v"), "minhash-members")
    drop_tables(postings, lists)
    few = members.where(F.col("size") <= LIST_ROWS)
    pairs = (
        few.select("v", F.col("node").alias("src"), F.col("n").alias("src_n"))
        .join(few.select("v", F.col("node").alias("dst"), F.col("n").alias("dst_n")), "v")
        .where((F.col("src") < F.col("dst")) & _near("src_n", "dst_n"))
        .select("src", "dst")
    )
    many = members.where(F.col("size") > LIST_ROWS)
    weights = many.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = many.join(weights, "node").groupBy("v").agg(F.max(F.struct("weight", "node", "n")).alias("top"))
    large = shared_table(
        many.select("v", "node", "n").join(hubs.select("v", F.col("top.node").alias("hub"), F.col("top.n").alias("hub_n")), "v").select("hub", "node", "n", "hub_n").distinct(),
        "minhash-large",
    )
    stars = large.where((F.col("node") != F.col("hub")) & _near("n", "hub_n"))
    stars = stars.select(F.least("hub", "node").alias("src"), F.greatest("hub", "node").alias("dst"))
    candidates = shared_table(pairs.unionByName(stars).distinct(), "minhash-candidates")
    wanted = candidates.select(F.col("src").alias("node")).union(candidates.select("dst")).union(large.select("node")).distinct()
    # One row of each class brings its text.
    ids = described.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("mark", "doc_id")).alias("one"))
    texts = shared_table(ids.join(wanted, "node").select("node", F.col("one.mark").alias("w_mark"), F.col("one.doc_id").alias("w_id")), "minhash-wanted")
    bodies = rows.join(texts.hint("shuffle_hash"), (F.col("mark") == F.col("w_mark")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("node", "text")
    sets = shared_table(bodies.mapInArrow(_packed_sets(words), "node binary, elements array<bigint>").dropDuplicates(["node"]), "minhash-sets")
    met = candidates.join(sets.select(F.col("node").alias("dst"), F.col("elements").alias("b")), "dst")
    met = met.join(sets.select(F.col("node").alias("src"), F.col("elements").alias("a")), "src")
    shared = F.size(F.array_intersect("a", "b"))
    links = shared_table(met.where(_linked(shared, F.size("a"), F.size("b"))).select("src", "dst"), "minhash-links")
    roots = shared_table(grouped(links), "minhash-roots")
    more = _open_blocks(large, roots, sets)
    found = shared_table(links.unionByName(more), "minhash-all-links")
    drop_tables(members, large, candidates, texts, sets, links, roots, more)
    return found


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows link when their sets of distinct word runs (A to Z in lower case, white space as one blank) have
    ``PERCENT`` hundredths or more in common; the component's id is the smallest doc_id that links reach, and the row
    with that id is kept. A text of fewer words is one run. Null, empty and blank texts have no set and link with
    nothing: their component is their own id. A null doc_id takes part, is never the smallest and is not kept; a
    component without other ids has a null id. Repeated rows stay, an empty table gives none, other columns are not read.
    """
    rows = fields(docs, doc_id=doc_id, text=text).withColumn("mark", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    described = shared_table(
        rows.mapInArrow(_described(words), f"doc_id {kind}, mark bigint, node binary, n bigint, bands array<bigint>"), "minhash"
    )
    firsts = described.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    roots = shared_table(grouped(near_links(rows, described, words)), "minhash-groups")
    named = shared_table(firsts.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "minhash-named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = shared_table(named.join(smallest, "root").select("node", "component_id"), "minhash-ids")
    drop_tables(roots, named)
    found = described.select("doc_id", "node", "n").join(ids.withColumnRenamed("component_id", "c"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("c"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )
