"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed. Runs are joined over all documents, and sentences
that a non-first occurrence of a repeated run covers are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import drop_tables, fields, shared_table, slices, small_batches

#: A run has at least so many sentences and so many words, so chance repeats of short sentences don't count.
RUN_SENTENCES, RUN_WORDS = 2, 20
#: Longer sentences are cut where a word's hash is the least of so many words in a row. Two copies of a passage are
#: cut alike but for the first and the last 15 words at most, so 50 words always hold a common run.
SENTENCE_WORDS, CUT_WORDS = 15, 8

_END = re.compile(r"[.!?](?=\s)|\n")
_WORD = re.compile(r"\S+")

Sentence = tuple[int, int, list[str]]


def cuts(words: list[str]) -> list[int]:
    """Numbers of the words that a cut of a long sentence follows; no piece has more than ``CUT_WORDS`` words.

    The last of the smallest hashes in each window of ``CUT_WORDS`` words: whether a word is one depends only on the
    words around it, not on where the sentence starts.
    """
    hashes = list(map(xxhash.xxh3_64_intdigest, " ".join(words).lower().encode().split(b" ")))
    found, least = [], -1
    for end in range(CUT_WORDS - 1, len(hashes)):
        start = end - CUT_WORDS + 1
        if least < start:
            window = hashes[end:start - 1:-1] if start else hashes[end::-1]
            least = end - window.index(min(window))
        elif hashes[end] <= hashes[least]:
            least = end
        if not found or found[-1] != least:
            found.append(least)
    return [k for k in found if k < len(hashes) - 1]


def sentences(text: str) -> list[Sentence]:
    """(start, end, words) of the sentences; together they are the whole text.

    A sentence ends behind ``.``, ``!`` or ``?`` before white space or behind a line feed; one of more than
    ``SENTENCE_WORDS`` words is cut by its words (``cuts``). White space belongs to the sentence before it.
    """
    out: list[Sentence] = []
    start = 0
    for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
        piece = text[start:end]
        words = piece.split()
        if not words:
            if out and end > start:
                out[-1] = (out[-1][0], end, out[-1][2])
                start = end
            continue
        if len(words) <= SENTENCE_WORDS:
            out.append((start, end, words))
        else:
            places = [m.start() + start for m in _WORD.finditer(piece)]
            bounds = [0, *[k + 1 for k in cuts(words)], len(words)]
            for a, b in zip(bounds, bounds[1:]):
                out.append((places[a] if a else start, places[b] if b < len(words) else end, words[a:b]))
        start = end
    return out


def runs(sizes: list[int]) -> list[tuple[int, int]]:
    """(first, last) of the runs: from each sentence on, and up to each sentence, the shortest that counts.

    Both directions, so that the first and the last sentence of a repeated passage are covered as well.
    """
    return [(p >> 32, p & 0xFFFFFFFF) for p in _places(sizes)]


def _places(sizes: list[int]) -> list[int]:
    """The runs in order, the first sentence in the upper 32 bits and the last in the lower."""
    n, found = len(sizes), set()
    total = [0, *accumulate(sizes)]
    last = 0
    for first in range(n):
        last = max(last, first + RUN_SENTENCES - 1)
        while last < n and total[last + 1] - total[first] < RUN_WORDS:
            last += 1
        if last >= n:
            break
        found.add(first << 32 | last)
    first = n - 1
    for last in range(n - 1, -1, -1):
        first = min(first, last - RUN_SENTENCES + 1)
        while first >= 0 and total[last + 1] - total[first] < RUN_WORDS:
            first -= 1
        if first < 0:
            break
        found.add(first << 32 | last)
    return sorted(found)


def span_hashes(text: str) -> list[tuple[int, int, bytes]]:
    """(first, last, 128-bit hash) of each run; case and white space don't count."""
    return [(p >> 32, p & 0xFFFFFFFF, digest) for p, digest in zip(*_run_hashes(sentences(text)))]


def _run_hashes(parts: list[Sentence]) -> tuple[list[int], list[bytes]]:
    """The places of the runs (``_places``) and their hashes."""
    digest = xxhash.xxh3_128_digest
    digests = b"".join([digest(" ".join(w).lower().encode()) for _, _, w in parts])
    places = _places([len(w) for _, _, w in parts])
    return places, [digest(digests[(p >> 32) * 16 : (p & 0xFFFFFFFF) * 16 + 16]) for p in places]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, place, low) of each run, and one row without low for each document, whose place is its number of
    sentences. ``tag`` holds 32 bits of the run's hash and 32 of the text's, ``place`` the first and last sentence."""

    def rows(ids: pa.Array, tag: np.ndarray, place: list[int], low: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(tag), pa.array(place, pa.int64()), low], names=["doc_id", "tag", "place", "low"])

    for batch in slices(batches):
        marks = batch.column("mark").to_numpy() & 0xFFFFFFFF
        sizes, counts, places, digests = [], [], [], []
        for text in batch.column("text").to_pylist():
            parts = sentences(text or "")
            own, hashes = _run_hashes(parts)
            sizes.append(len(parts))
            counts.append(len(own))
            places += own
            digests += hashes
        yield rows(batch.column("doc_id"), marks, sizes, pa.nulls(len(sizes), pa.int64()))
        source = np.repeat(np.arange(len(sizes)), counts)
        hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield rows(batch.column("doc_id").take(pa.array(source)), hashes[:, 1] << 32 | marks[source], places, pa.array(hashes[:, 0].copy()))


def without(text: str, gone: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the sentences of the given runs; its number of sentences and of those removed."""
    parts = sentences(text)
    drop = bytearray(len(parts))
    for a, b in gone:
        drop[a : b + 1] = b"\1" * (b + 1 - a)
    kept = "".join(text[a:b] for (a, b, _), d in zip(parts, drop) if not d)
    return kept, len(parts), sum(drop)


def repeated_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, mark, first, last) of every non-first occurrence of a run, of the rows of ``_spans``.

    The first occurrence is the one in the smallest doc_id (null last), then mark, then place. ``mark`` has 32 bits.
    """
    # Ids and counts combine before the shuffle; places are looked at only for runs that repeat.
    # Written first, so that the join's sides are plain exchanges and Spark can split a hot run.
    runs_only = spans.where(F.col("low").isNotNull())
    counts = shared_table(runs_only.groupBy("low").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "span-counts")
    high, mark = F.shiftright("tag", 32), F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF))
    repeats = shared_table(
        runs_only.join(counts.drop("n"), "low").select("doc_id", mark.alias("mark"), "place", "low", high.alias("high"), "least"), "repeats"
    )
    drop_tables(counts)
    starts = repeats.where(F.col("doc_id").eqNullSafe(F.col("least")) | F.col("least").isNull())
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("mark").alias("c"), F.col("place").alias("d"))
    firsts = starts.groupBy("low", "high").agg(F.min(order).alias("own"))
    other = repeats.groupBy("low", "high").agg(F.min(order).alias("any"))
    firsts = other.join(firsts, ["low", "high"], "left").select("low", "high", F.coalesce("own", "any").alias("own"))
    firsts = shared_table(firsts, "first-spans")
    again = repeats.join(firsts, ["low", "high"]).where(order != F.col("own"))
    found = shared_table(
        again.select("doc_id", "mark", F.shiftright("place", 32).cast("int").alias("first"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("last")),
        "repeated-spans",
    )
    drop_tables(repeats, firsts)
    return found


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_sentences: str = "n_sentences", n_removed: str = "n_removed") -> DataFrame:
    """The table with its texts cleaned and with the numbers of sentences and of removed ones added.

    Whole texts; the first occurrence of a run stays. A null or empty text stays as it is, with no sentences.
    Rows equal in id and text count as one document and lose the same sentences. Columns named like the two
    added ones are replaced, all others stay. An empty table stays empty.
    """
    keyed = fields(docs, doc_id=doc_id, text=text).withColumn("mark", F.xxhash64("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        spans = shared_table(keyed.mapInArrow(_spans, f"doc_id {kind}, tag bigint, place bigint, low bigint"), "spans")
    totals = spans.where(F.col("low").isNull()).groupBy("doc_id", F.col("tag").alias("mark")).agg(F.first("place").alias("total"))
    totals = shared_table(totals, "span-totals")
    found = repeated_spans(spans)
    drop_tables(spans)
    # At most two runs for each sentence of the document.
    runs_of = found.groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("m")).agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    gone = totals.join(runs_of, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left").select(
        F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "total", "gone"
    )
    kept = [c for c in docs.columns if c not in (n_sentences, n_removed)]
    # The row is nested, so that its columns can have any names.
    own = F.xxhash64(docs[text]).bitwiseAND(F.lit(0xFFFFFFFF))
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), docs[doc_id].alias("id"), own.alias("mark"))
    joined = rows.join(
        gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left"
    ).select("row", "total", F.col("gone.first").alias("firsts"), F.col("gone.last").alias("lasts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row = batch.column("row")
            texts, totals, removed = [], [], []
            for value, n, a, b in zip(row.field(text).to_pylist(), *[batch.column(c).to_pylist() for c in ("total", "firsts", "lasts")]):
                # Only texts with a repeat are cut into sentences again.
                cleaned, n, k = without(value, list(zip(a, b))) if a else (value if n else value and "", n, 0)
                texts.append(cleaned)
                totals.append(n)
                removed.append(k)
            columns = [pa.array(texts, row.field(c).type) if c == text else row.field(c) for c in kept]
            columns += [pa.array(totals, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, n_sentences, n_removed])

    schema = StructType([*docs.select(*kept).schema.fields, StructField(n_sentences, LongType()), StructField(n_removed, LongType())])
    return joined.mapInArrow(run, schema)
