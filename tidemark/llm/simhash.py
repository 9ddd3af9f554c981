"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is a list of (position, byte) elements. Two fingerprints that differ in at most ``BITS`` bits
differ in at most ``BITS`` bytes, so they share at least ``N_BYTES - BITS`` elements. Lists of one element
would hold a 256th of all fingerprints, so a list is kept for every set of that many positions and the
bytes there: a pair reaching the minimum count meets in at least one list. Shared bytes are then tallied
for each pair and the bits compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_tables, fields, shared_table, slices
from tidemark.operators.clustering import connected_components

#: Differing bits up to which two fingerprints link, bytes of a fingerprint, and the guaranteed matches.
BITS = 2
N_BYTES = 8
MIN_MATCHES = N_BYTES - BITS
SEED = 42
#: Members up to which all pairs of a list are formed; larger lists are linked through their residual bits.
LIST_ROWS = 32
#: Hashes whose bits are summed at once.
BLOCK = 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of all runs of so many words, repeats included; a shorter text is one run, an empty one none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([_hash(b" ".join(w))], np.uint64)
    runs = map(b" ".join, zip(*[w[i:] for i in range(words)]))
    return np.fromiter(map(_hash, runs), np.uint64, len(w) - words + 1)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[i : i + BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fingerprint (64 bits as a signed long) of every whole text."""
    return _prints(fields(docs, doc_id=doc_id, text=text), words)


def _prints(rows: DataFrame, words: int, *carried: str) -> DataFrame:
    """doc_id, the carried columns and the fingerprint of rows (doc_id, text, ...)."""
    names = ["doc_id", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [simhash(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), signed], names=[*names, "fingerprint"])

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in names)
    return rows.mapInArrow(run, f"{kinds}fingerprint bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shared_bytes(a: Column, b: Column) -> Column:
    """Number of positions at which two fingerprints have the same byte."""
    x = a.bitwiseXOR(b)
    tally = F.lit(0)
    for i in range(N_BYTES):
        tally = tally + (x.bitwiseAND(F.lit(_signed(0xFF << (8 * i)))) == 0).cast("int")
    return tally


def links(prints: DataFrame) -> DataFrame:
    """Links (src, dst) that connect all distinct fingerprints at ``BITS`` bits or fewer.

    Every pair of a list of up to ``LIST_ROWS`` members is formed. In a larger list all members agree in
    ``MIN_MATCHES`` bytes, so the bits that differ are in the other ones: each member is put under itself
    and its one-bit changes there. Members under one value are two bits apart at most, and two members that
    close meet under a value between them, so linking each to the smallest under the value loses no connection
    and makes no false one.
    """
    sets = list(combinations(range(N_BYTES), MIN_MATCHES))
    masks = [_signed(sum(0xFF << (8 * p) for p in s)) for s in sets]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks)])
    postings = prints.select("fp", F.explode(keys).alias("e")).select("fp", F.col("e.k").alias("k"), F.col("e.v").alias("v"))
    lists = shared_table(
        postings.groupBy("k", "v").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"),
        "simhash-lists",
    )
    twos = lists.where("n = 2").select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    members = shared_table(postings.join(lists.where("n > 2").select("k", "v", "n"), ["k", "v"]), "simhash-members")
    few = members.where(F.col("n") <= LIST_ROWS)
    pairs = (
        few.select("k", "v", F.col("fp").alias("src"))
        .join(few.select("k", "v", F.col("fp").alias("dst")), ["k", "v"])
        .where("src < dst").select("src", "dst")
    )
    rest = [[p for p in range(N_BYTES) if p not in s] for s in sets]
    flips = [[0] + [_signed(1 << (8 * p + b)) for p in r for b in range(8)] for r in rest]
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in flips])
    near = members.where(F.col("n") > LIST_ROWS).select("k", "fp", F.explode(F.get(table, F.col("k"))).alias("flip"))
    near = near.select("k", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    hubs = near.groupBy("k", "value").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    hot = near.join(hubs.drop("n"), ["k", "value"]).where("fp <> hub").select(F.col("hub").alias("src"), F.col("fp").alias("dst"))
    found = twos.unionByName(pairs).unionByName(hot).distinct()
    return found.where((shared_bytes(F.col("src"), F.col("dst")) >= MIN_MATCHES) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= BITS))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Rows link if their fingerprints differ in at most ``BITS`` bits; the component's id is the smallest doc_id
    that links reach. Null, empty and blank texts have fingerprint zero and link like any other. A null doc_id
    takes part but is never the smallest (a component without other ids has a null id). Repeated rows stay,
    an empty table gives none, other columns are not read.
    """
    prints = shared_table(fingerprints(docs, doc_id, text, words), "simhash")
    firsts = shared_table(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "simhash-firsts")
    joined = connected_components(links(firsts.select("fp")))
    named = firsts.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(smallest, "component").select(F.col("fp").alias("fingerprint"), "component_id")
    return prints.join(ids, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row of each component of ``components``, the one with the smallest doc_id (null last), then text hash.

    Null, empty and blank texts share a fingerprint and so are one component at least. Of rows equal in id and text one
    stays. An empty table stays empty; all columns stay as they are, whatever their names.
    """
    keyed = fields(docs, doc_id=doc_id, text=text).withColumn("mark", F.xxhash64("text"))
    prints = shared_table(_prints(keyed, words, "mark"), "simhash")
    firsts = shared_table(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "simhash-firsts")
    joined = connected_components(links(firsts.select("fp")))
    roots = firsts.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    # One candidate for each fingerprint, then one for each component.
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("mark").alias("c"))
    least = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(order).alias("f"))
    first = least.join(roots, "fp").groupBy("component").agg(F.min("f").alias("f")).select(F.col("f.b").alias("kept_id"), F.col("f.c").alias("kept_mark"))
    again = prints.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    kept = shared_table(first.join(again, same, "left").select("kept_id", "kept_mark", F.coalesce("n", F.lit(1)).alias("n")), "simhash-kept")
    drop_tables(prints, firsts)
    # The row is nested, so that its columns can have any names.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("id"), F.xxhash64(docs[text]).alias("mark"))

    def found(wanted: DataFrame) -> DataFrame:
        return rows.join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")))

    once = found(kept.where("n = 1")).select("row.*")
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return once
    return once.unionByName(found(repeated).dropDuplicates(["id", "mark"]).select("row.*"))
