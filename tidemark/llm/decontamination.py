"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some positions of a short window of tokens and ignores the others, so a window whose ignored
tokens were replaced still hashes alike. Mask hashes of documents and benchmark items are joined, and
around each hit the two token sequences are laid over each other and compared token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fields, shared_table

#: Kept positions of each mask. The first alone finds every window of WINDOW tokens with up to two replaced.
MASKS = ((0, 1, 3, 6, 7, 8), (0, 1, 2, 3, 6, 7))
SPAN = 9
#: Items of so many tokens are also looked for by an unbroken mask: one of up to ten tokens may have one replaced at
#: most, which leaves a half of four tokens whole. Shorter items count where they are a whole document.
SHORT_MASK, SHORT_TOKENS = ((0, 1, 2, 3),), (4, 10)
#: Tokens of the window in which an overlap is judged, and the share of them that must be equal.
WINDOW, LEAST_SHARE = 16, 0.875
#: Hashes of the benchmark up to which they are sent to the documents; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def token_hashes(text: Column) -> Column:
    """Hashes of the letter and digit runs of the lower-cased text, in order."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _mask_hashes(hashes: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """For every mask, the hash at each start; all in one array, mask after mask."""
    span = _span(masks)
    starts = F.when(F.size(hashes) >= span, F.sequence(F.lit(0), F.size(hashes) - span)).otherwise(F.array().cast("array<int>"))

    def under(k: int, mask: tuple[int, ...]) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + o) for o in mask]))

    return F.concat(*[under(k, mask) for k, mask in enumerate(masks)])


def _span(masks: tuple[tuple[int, ...], ...]) -> int:
    return SPAN if masks == MASKS else 1 + max(map(max, masks))


def seeds(rows: DataFrame, *carry: str, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """(carried columns, seed, at): every mask hash of rows with ``hashes`` and where its window starts."""
    n = F.greatest(F.size("hashes") - _span(masks) + 1, F.lit(1))
    return rows.select(*carry, n.alias("n"), F.posexplode(_mask_hashes(F.col("hashes"), masks)).alias("k", "seed")).select(
        *carry, "seed", (F.col("k") % F.col("n")).alias("at")
    )


def _hits(own: DataFrame, items: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(doc_id, mark, item_id, shift) of the documents and items that share a mask hash."""
    wanted = shared_table(seeds(items, "item_id", masks=masks).groupBy("seed", "item_id", "at").agg(F.lit(1).alias("one")), "item-seeds")
    wanted = wanted.select("seed", "item_id", F.col("at").alias("item_at"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return seeds(own, "doc_id", "mark", masks=masks).join(wanted, "seed").select(
        "doc_id", "mark", "item_id", (F.col("at") - F.col("item_at")).alias("shift")
    )


def overlap(doc: Column, item: Column, shift: Column) -> Column:
    """Most equal tokens in a window of the item (WINDOW tokens, or all of a shorter one) laid at ``shift``."""
    n = F.size(item)
    equal = F.transform(
        item, lambda h, i: F.coalesce((F.when(i + shift >= 0, F.get(doc, i + shift)) == h).cast("int"), F.lit(0))
    )
    width = F.least(n, F.lit(WINDOW))
    sums = F.transform(
        F.sequence(F.lit(1), n - width + 1), lambda i: F.aggregate(F.slice(equal, i, width), F.lit(0), lambda a, x: a + x)
    )
    return F.array_max(sums)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, mark, item_id, overlap) of the documents that hold a passage of a benchmark item.

    ``mark`` is the hash of the text. An item's passage is in a document if in a window of ``WINDOW`` item tokens
    (all, if it has fewer) ``LEAST_SHARE`` or more stand in the document in the same places; ``overlap`` is the
    most equal tokens. An item of fewer than four tokens, which many clean texts hold by chance, is in a document
    that consists of it. Items and documents without tokens, null texts among them, match nothing. Repeated rows
    give one row; an empty table on either side gives none.
    """
    strip = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")
    items = shared_table(
        fields(benchmark, item_id=item_id, text=item_text)
        .select("item_id", F.transform(strip, lambda t: F.xxhash64(t)).alias("hashes")).where(F.size("hashes") > 0),
        "items",
    )
    rows = fields(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    own = rows.select("doc_id", "mark", token_hashes(F.col("text")).alias("hashes"))
    least, most = SHORT_TOKENS
    hits = _hits(own, items.where(F.size("hashes") >= SPAN), MASKS)
    short = items.where(F.size("hashes").between(least, most))
    if not short.isEmpty():
        hits = hits.unionByName(_hits(own, short, SHORT_MASK))
    tiny = items.where(F.size("hashes") < least).select("item_id", F.xxhash64("hashes").alias("whole"))
    if not tiny.isEmpty():
        # The document's first token stands behind an empty one where the text starts with a separator.
        led = F.when(F.col("text").rlike("^[^\\p{L}\\p{N}]"), F.lit(1)).otherwise(F.lit(0))
        words = rows.select("doc_id", "mark", led.alias("shift"), F.transform(strip, lambda t: F.xxhash64(t)).alias("hashes"))
        whole = words.where(F.size("hashes").between(1, least - 1)).select("doc_id", "mark", "shift", F.xxhash64("hashes").alias("whole"))
        hits = hits.unionByName(whole.join(tiny, "whole").select("doc_id", "mark", "item_id", "shift"))
    hits = shared_table(hits.distinct(), "hits")
    # Only documents with a hit are looked at again.
    again = rows.join(
        hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark")).agg(F.count("*").alias("n")).hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left_semi",
    )
    bodies = again.groupBy("doc_id", "mark").agg(F.first("text").alias("text")).select(
        F.col("doc_id").alias("body_id"), F.col("mark").alias("body_mark"), token_hashes(F.col("text")).alias("doc_hashes")
    )
    laid = hits.join(bodies, F.col("doc_id").eqNullSafe(F.col("body_id")) & (F.col("mark") == F.col("body_mark"))).join(items, "item_id")
    judged = laid.select(
        "doc_id", "mark", "item_id", overlap(F.col("doc_hashes"), F.col("hashes"), F.col("shift")).alias("overlap"),
        F.least(F.size("hashes"), F.lit(WINDOW)).alias("width"),
    )
    return judged.where(F.col("overlap") >= F.ceil(F.col("width") * LEAST_SHARE)).groupBy("doc_id", "mark", "item_id").agg(
        F.max("overlap").alias("overlap")
    )


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, contaminated, item_ids (sorted) and overlap of every row; see ``contaminated``."""
    found = contaminated(docs, benchmark, doc_id, text, item_id, item_text)
    # A document has at most as many items as window starts.
    per_doc = found.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("overlap").alias("overlap"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "hit_id", "mark": "hit_mark"})
    rows = fields(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("mark"))
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    return joined.select("doc_id", F.col("hit_mark").isNotNull().alias("contaminated"), "item_ids", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without a benchmark passage, with the columns they had, whatever their names.

    Rows with a null or empty text hold no passage and stay, as do rows with a null id unless their text holds one;
    repeated rows stay or go together, items of any length count (see ``contaminated``), empty tables give what they had.
    """
    found = contaminated(docs, benchmark, doc_id, text, item_id, item_text).select(
        F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark")
    ).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("id"), F.xxhash64(docs[text]).alias("mark"))
    clean = rows.join(found.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left_anti")
    return clean.select("row.*")
