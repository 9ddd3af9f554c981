"""Document fingerprints by winnowing.

Rolling hashes of all word k-grams; of every window of consecutive k-gram hashes the smallest is kept, the
rightmost of equals, with its position. Any run of ``GRAM + WINDOW - 1`` words that two texts share leaves
a common hash in both, and the positions tell where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import MAX_RANGES, fields, n_ranges, range_of, shared_table, splitters

#: Words of a gram and grams of a window.
GRAM, WINDOW_GRAMS = 3, 4
#: Bits of a kept value that hold the position; the rest holds the hash.
POSITION_BITS = 27
LAST_POSITION = 2**POSITION_BITS - 1
#: Bytes of text that a range of documents is meant to hold.
RANGE_BYTES = 32 << 20


def word_hashes(text: Column) -> Column:
    """Hashes of the words of the lower-cased text."""
    body = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+", ""))
    return F.when(body == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(F.regexp_replace(body, "\\s+$", ""), "\\s+"), lambda w: F.xxhash64(w))
    )


def _rotated(value: Column, bits: int) -> Column:
    return value if not bits else F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


def _packed(value: Column, position: Column) -> Column:
    """Hash above, position from the end below: the smaller value is the smaller hash, then further right."""
    high = F.shiftleft(F.shiftrightunsigned(value, POSITION_BITS + 1), POSITION_BITS)
    return high.bitwiseOR(F.lit(LAST_POSITION) - position.cast("bigint"))


def gram_values(words: Column) -> Column:
    """Packed cyclic-polynomial hash of every run of GRAM words; a shorter text is one gram."""
    n = F.size(words)

    def rolled(i: Column) -> Column:
        out = _rotated(F.get(words, i), GRAM - 1)
        for k in range(1, GRAM):
            out = out.bitwiseXOR(_rotated(F.get(words, i + k), GRAM - 1 - k))
        return _packed(out, i)

    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < GRAM, F.array(_packed(F.xxhash64(words), F.lit(0))))
        .otherwise(F.transform(F.sequence(F.lit(0), n - GRAM), rolled))
    )


def selected(grams: Column) -> Column:
    """The kept values, in order of position."""
    n = F.size(grams)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - WINDOW_GRAMS + 1))
    return F.when(n == 0, grams).otherwise(
        F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(grams, i, WINDOW_GRAMS))))
    )


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """The table with the kept values of a text column added, step by step so that no step is done twice."""
    return (
        rows.withColumn(out, word_hashes(F.col(text))).withColumn(out, gram_values(F.col(out))).withColumn(out, selected(F.col(out)))
    )


def hashes(values: Column) -> Column:
    """The distinct hashes of kept values."""
    return F.array_distinct(F.transform(values, lambda v: F.shiftright(v, POSITION_BITS)))


def printed(values: Column) -> Column:
    """position:hash of each kept value, in order, separated by spaces."""
    return F.array_join(
        F.transform(
            values,
            lambda v: F.concat((F.lit(LAST_POSITION) - v.bitwiseAND(F.lit(LAST_POSITION))).cast("string"), F.lit(":"), F.hex(F.shiftright(v, POSITION_BITS))),
        ),
        " ",
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of all hashes; two empty fingerprints are alike."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with ``kept`` and the next document's ``next_text`` and ``next_kept``.

    Next in descending doc_id (null last); rows equal in id by the hash of their text; after the last comes
    the first. Documents are put into id ranges of about equal bytes, so the texts move once; the last row
    below each range comes along as a guest.
    """
    rows = docs.withColumns({"mark": F.xxhash64("text")})
    sizes = shared_table(rows.select("doc_id", "mark", F.octet_length("text").alias("size")), "doc-sizes")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("size") + 1), F.lit(0))).first()
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark bigint"
    key = {"doc_id": F.col("doc_id"), "mark": F.col("mark")}
    ranges = min(MAX_RANGES, max(n_ranges(n), total // RANGE_BYTES))
    cuts = splitters(sizes, key, F.col("size") + 1, float(total), ranges)
    part = range_of(key, kinds, cuts)
    tops = sizes.groupBy(part.alias("part")).agg(F.max(F.struct("doc_id", "mark")).alias("top")).orderBy("part").collect()
    below = [(r["part"], *tops[k - 1]["top"]) for k, r in enumerate(tops)]  # of the first range: the last of all
    guests = F.broadcast(  # a row for each range, whose number is bounded
        docs.sparkSession.createDataFrame(below, f"part int, guest_id {rows.schema['doc_id'].dataType.simpleString()}, guest_mark bigint")
    )
    visiting = rows.join(guests, F.col("doc_id").eqNullSafe(F.col("guest_id")) & (F.col("mark") == F.col("guest_mark")))
    both = rows.select("doc_id", "text", "mark", part.alias("part"), F.lit(1).alias("own")).unionByName(
        visiting.select("doc_id", "text", "mark", "part", F.lit(0).alias("own"))
    )
    printed_rows = with_fingerprint(both.repartition("part"), "text", "kept")
    order = Window.partitionBy("part").orderBy("own", "doc_id", "mark")
    return printed_rows.select(
        "*", F.lag("text").over(order).alias("next_text"), F.lag("kept").over(order).alias("next_kept")
    ).where("own = 1")


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next
    document. Null texts read as empty; an empty text has an empty fingerprint, alike only to another empty
    one. Repeated rows stay (the next document of a row may be its copy), an empty table gives none, other
    columns are not read. Positions count up to 2**27 words.
    """
    rows = fields(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = with_next(rows).withColumn("n_chars", n.cast("bigint")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    )
    both = with_fingerprint(edited.drop("text", "next_text"), "edited", "edited_kept")
    sets = both.withColumns({"a": hashes(F.col("kept")), "b": hashes(F.col("edited_kept")), "c": hashes(F.col("next_kept"))})
    return sets.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("kept")).alias("fingerprint"),
        printed(F.col("edited_kept")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
