"""Vector compression by codebooks of each part, trained with norm-of-sum bounds (Newling and Fleuret 2016).

A vector is cut into parts; a part's code is the number of the nearest entry in its position's codebook. Every round
assigns all parts and moves each entry to the mean of its parts. Most assignments don't change, so a row keeps, for
each part, its entry and for each group of entries a lower bound on the distance to the nearest other one, with the
stamp of the round in which that distance was measured. All codebooks of earlier rounds are kept. An entry is now
where it was at the stamp plus the sum of its moves, and the norm of that sum (its true net displacement) is at most
the sum of the norms that accumulated drifts would subtract. A group whose bound less its largest net displacement
still exceeds the distance to the row's own entry is passed over; the others are measured again, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_tables, shared_table, slices

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Entries that share a bound.
GROUP = 32
#: Rows measured at once.
ROWS = 2048
#: Bounds give way by this share, so that rounding never hides an equal distance.
SLACK = 1e-9


@dataclass(frozen=True)
class Codes:
    """Rows (vec_id, label, whole, codes, error) and the final codebooks: part x entry x position."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components as decimal integers, by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.codebooks.ravel()).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """True where a vector has neither null nor non-finite components and is not null itself."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * component) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def padded(vector: Column, width: int) -> Column:
    """The vector with zeros behind it up to the width."""
    return F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries; beyond 53 bits by Python integers."""
    largest = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * largest * largest < 2**53:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] + (cf * cf).sum(1)[None, :] - 2 * (xf @ cf.T)).astype(np.int64)
    xo, co = x.astype(object), c.astype(object)
    return (xo * xo).sum(1)[:, None] + (co * co).sum(1)[None, :] - 2 * (xo @ co.T)


def _below(distance: np.ndarray) -> np.ndarray:
    """Square roots rounded down to 32 bits; infinity stays."""
    root = np.sqrt(distance.astype(np.float64)) * (1 - SLACK)
    low = root.astype(np.float32)
    return np.where(np.isinf(root), np.float32(np.inf), np.nextafter(low, np.float32(-np.inf)))


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """stamp x part x group: the largest norm by which a group's entries are now away from where they were."""
    now = history[-1]
    out = []
    for past in history:
        moved = np.sqrt(((now - past).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
        out.append(np.stack([moved[:, g : g + GROUP].max(1) for g in range(0, now.shape[1], GROUP)], axis=1))
    return np.stack(out)


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, own: np.ndarray | None, low: np.ndarray, stamp: np.ndarray) -> tuple:
    """(own, squared distance, low, stamp, measured) of one part of many rows after one assignment.

    ``own`` are the rows' entries so far (None at first), ``low`` and ``stamp`` the bounds of each group of entries
    and the rounds they were measured in; ``moved`` is ``displacements`` of this part. Ties go to the lower entry.
    """
    n, now = len(x), len(moved) - 1
    groups = range(0, len(book), GROUP)
    if own is None:
        own, best = np.zeros(n, np.int64), None
        need = np.ones((n, len(groups)), bool)
    else:
        best = np.empty(n, squares(x, book[:1]).dtype)
        for e in np.unique(own):
            at = np.flatnonzero(own == e)
            best[at] = squares(x[at], book[e : e + 1])[:, 0]
        reach = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        low = low - moved[stamp, np.arange(len(groups))[None, :]]
        need = low <= reach[:, None]
    was, first = own.copy(), best.copy() if best is not None else None
    stamp = np.full_like(stamp, now)
    low = low.astype(np.float64) if low.size else np.full((n, len(groups)), np.inf)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for k, g in enumerate(groups):
        at = np.flatnonzero(need[:, k])
        dist = squares(x[at], book[g : g + GROUP])
        kept.append((at, dist))
        if not len(at):
            continue
        near = dist.argmin(1)
        found = dist[np.arange(len(at)), near]
        if best is None:
            best, own = found.copy(), near + g
            continue
        better = (found < best[at]) | ((found == best[at]) & (near + g < own[at]))
        best[at[better]], own[at[better]] = found[better], near[better] + g
    for k, g in enumerate(groups):
        at, dist = kept[k]
        others = dist.astype(np.float64)
        mine = (own[at] >= g) & (own[at] < g + GROUP)
        others[np.flatnonzero(mine), own[at[mine]] - g] = np.inf
        low[at, k] = others.min(1, initial=np.inf)
        low[at, k] = np.sqrt(low[at, k])
    if first is not None:
        # The entry a row has left is now one of the others of its group.
        left = np.flatnonzero(was != own)
        group = was[left] // GROUP
        low[left, group] = np.minimum(low[left, group], np.sqrt(first[left].astype(np.float64)))
    return own, best, low, stamp, int(need.sum())


def _round_of(history: list[np.ndarray]):
    book, moved = history[-1], displacements(history)
    parts, entries, width = book.shape
    groups = -(-entries // GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            n = batch.num_rows
            x = matrix(batch.column("whole"), parts * width).reshape(n, parts, width)
            state = [np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, parts, -1) for c, t in
                     (("codes", np.uint8), ("low", np.float32), ("stamp", np.uint8))] if len(history) > 1 else None
            codes, error = np.empty((n, parts), np.uint8), np.zeros(n, object)
            low, stamp = np.empty((n, parts, groups), np.float32), np.empty((n, parts, groups), np.uint8)
            measured = 0
            for p in range(parts):
                own = None if state is None else state[0][:, p, 0].astype(np.int64)
                old = np.empty((n, 0)) if state is None else state[1][:, p].astype(np.float64)
                marks = np.zeros((n, groups), np.int64) if state is None else state[2][:, p].astype(np.int64)
                own, best, bound, marks, count = assign(x[:, p], book[p], moved[:, p], own, old, marks)
                codes[:, p], low[:, p], stamp[:, p] = own, _below(bound**2), marks
                error = error + best
                measured += count
            packed = [pa.array([row.tobytes() for row in values], pa.binary()) for values in (codes, low, stamp)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "whole")), *packed, pa.array([int(e) for e in error], pa.int64()), pa.array([measured / n] * n)],
                names=["vec_id", "label", "whole", "codes", "low", "stamp", "error", "measured"],
            )

    return run


def _sums(parts: int, entries: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch.column("whole"), parts * width).reshape(batch.num_rows, parts, width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, parts)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        at = np.argwhere(count > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(count[count > 0]), pa.array(list(total[count > 0]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"],
        )

    return run


def _moved_book(rows: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook with every used entry at the floored mean of its parts; only sums of entries reach the driver."""
    parts, entries, width = book.shape
    each = rows.select("whole", "codes").mapInArrow(_sums(parts, entries, width), "part bigint, entry bigint, n bigint, total array<bigint>")
    spread = each.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    found = spread.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = book.copy()
    for r in found.collect():
        out[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    return out


def compress(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
) -> Codes | None:
    """Codes of all vectors; None if no row has a usable one.

    Rows whose vector is null or has null or non-finite components take no part. Components become
    floor(scale * x); a vector that is shorter than the longest, or not a multiple of the parts, is padded with zeros.
    The first codebooks are the parts of the ``entries`` smallest ids (null ids last, then by vector; fewer rows make
    fewer entries). Repeated rows stay and get equal codes; null labels are one label; other columns are not read.
    An error above 64 bits (components beyond some hundred million) fails. The driver holds the codebooks alone (``entries`` vectors a round); the rows' state is written in each round.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    source = df.select(df[vec_id].alias("vec_id"), df[label].alias("label"), df[vector].alias("v"))
    kept = source.where(finite(F.col("v"))).select("vec_id", "label", scaled(F.col("v"), scale).alias("whole"))
    longest = kept.agg(F.max(F.size("whole"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    rows = kept.select("vec_id", "label", padded(F.col("whole"), parts * width).alias("whole"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    book = np.array([r["whole"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, whole array<bigint>, codes binary, low binary, stamp binary, error bigint, measured double"
    history = [book]
    state = shared_table(rows.mapInArrow(_round_of(history), schema), "codes")
    for _ in range(rounds):
        history.append(_moved_book(state, history[-1]))
        after = shared_table(state.mapInArrow(_round_of(history), schema), "codes")
        drop_tables(state)
        state = after
    return Codes(state, history[-1])


def code_rows(codes: Codes) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error (summed over equal labels), codebooks_sha256."""
    rows = codes.rows.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    errors = rows.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error"))
    return rows.join(errors, F.col("label").eqNullSafe(F.col("label_"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256")
    )


def decoded(codes: Codes) -> DataFrame:
    """vec_id and vector: what the codes stand for, in the scale of the input."""
    book = codes.codebooks
    parts, _, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, parts)
            whole = np.concatenate([book[p][own[:, p]] for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(whole), pa.list_(pa.int64()))], names=["vec_id", "vector"])

    kind = codes.rows.schema["vec_id"].dataType.simpleString()
    return codes.rows.select("vec_id", "codes").mapInArrow(run, f"vec_id {kind}, vector array<bigint>")
