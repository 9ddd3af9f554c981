"""Operators over vectors against brute force, with the edge cases of each."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, vector_codes
from tidemark.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(codes, errors, codebooks) of (id, label, vector) rows by full scans with Python integers."""
    width = -(-max(len(v) for _, _, v in rows) // parts)
    whole = np.array([[int(np.floor(scale * float(x))) for x in v] + [0] * (parts * width - len(v)) for _, _, v in rows], object)
    x = whole.reshape(len(rows), parts, width)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(whole[i])))[:entries]
    books = [[list(x[i, p]) for i in first] for p in range(parts)]

    def assigned():
        own = np.zeros((len(rows), parts), int)
        cost = np.zeros((len(rows), parts), object)
        for p in range(parts):
            b = np.array(books[p], object)
            d = ((x[:, p][:, None, :] - b[None]) ** 2).sum(2)
            own[:, p] = [min(range(len(b)), key=lambda e: (r[e], e)) for r in d]
            cost[:, p] = d[np.arange(len(rows)), own[:, p]]
        return own, cost

    for _ in range(rounds):
        own, _ = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = x[own[:, p] == e, p]
                if len(mine):
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    own, cost = assigned()
    return own, cost.sum(1), books


def hold_codes(df, rows, **options):
    own, cost, books = plain_codes(rows, **options)
    sums = {}
    for (_, label, _), c in zip(rows, cost):
        sums[label] = sums.get(label, 0) + int(c)
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    want = sorted((str(i), "".join(f"{k:02x}" for k in o), int(c), sums[label], sha) for (i, label, _), o, c in zip(rows, own, cost))
    got = vector_codes.code_rows(vector_codes.compress(df, **options)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == want


def test_codes_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    hold_codes(spark.read.parquet(f"{SF_DIR}/embeddings.parquet"), rows)
    assert QUERIES["op12_vector_codes"](spark, SF_DIR).count() == len(rows)


def test_codes_with_few_entries_and_many_moves(spark):
    """Clustered rows, few entries: assignments change from round to round, bounds of earlier stamps are used."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (60, 6))
    rows = [(i, i % 3, [float(x) for x in centres[i * 7 % 60] + rng.normal(0, 0.05, 6)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    hold_codes(df, rows, parts=2, entries=70, rounds=5, scale=100.0)


def test_net_displacement_is_tighter_than_drift_and_spares_measurements(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (3000, 4))
    history = [x[:256][None].copy()]
    own, _, low, stamp, _ = vector_codes.assign(x, history[0][0], vector_codes.displacements(history)[:, 0], None, np.empty((3000, 0)), np.zeros((3000, 8), np.int64))
    for _ in range(6):
        book = history[-1].copy()
        for e in np.unique(own):
            book[0, e] = x[own == e].sum(0) // (own == e).sum()
        history.append(book)
        moved = vector_codes.displacements(history)
        steps = [vector_codes.displacements([a, b])[0] for a, b in zip(history, history[1:])]
        for s in range(len(history) - 1):
            assert (moved[s] <= sum(steps[s:]) + 1e-6).all()
        own, best, low, stamp, measured = vector_codes.assign(x, book[0], moved[:, 0], own, low, stamp)
        full = vector_codes.squares(x, book[0])
        assert (own == full.argmin(1)).all() and (best == full.min(1)).all()
    assert measured < 0.5 * low.size


def test_codes_of_odd_rows(spark):
    """Nulls, non-finite and empty vectors, unequal lengths, repeated rows, huge components, clashing columns, no rows."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, 1, [0.5, -0.25, 0.125, 1.0, 2.0]), (3, 1, [0.5, -0.25, 0.125, 1.0, 2.0]), (None, None, [0.1, 0.2]), (1, None, []),
        (7, 2, [1e6, -1e6, 3.0, 4.0]), (8, 2, [1e6, -1e6, 3.0, 4.0]), (9, 2, [-1e-9, 0.0, 0.0, 0.0]),
    ]
    bad = [(4, 1, None), (5, 1, [0.1, None]), (6, 1, [nan, 0.1]), (10, 1, [inf, 0.1]), (11, 1, [-inf])]
    table = [(i, v, k, "x", b"y", 1, 2.0) for i, k, v in rows + bad]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int, whole string, codes binary, stamp int, error double")
    hold_codes(df, rows)
    hold_codes(df, rows, parts=3, entries=2, rounds=2)
    assert vector_codes.compress(df.where("vec_id in (4, 5, 6, 10, 11)")) is None
    assert vector_codes.compress(df.where("vec_id > 100")) is None
    with pytest.raises(ValueError):
        vector_codes.compress(df, entries=300)


def test_decoding_gives_the_entries(spark):
    codes = vector_codes.compress(spark.read.parquet(f"{SF_DIR}/embeddings.parquet"))
    own = {r["vec_id"]: r["codes"] for r in codes.rows.collect()}
    for r in vector_codes.decoded(codes).limit(20).collect():
        want = [int(x) for p, e in enumerate(own[r["vec_id"]]) for x in codes.codebooks[p][e]]
        assert r["vector"] == want


# -- hard negatives --------------------------------------------------------------------------


def plain_negatives(rows, anchors, positives=5, negatives=5, share=80, scale=256):
    """Rows (anchor, positive, rank, negative, scores) of full scans; rows are (id, label, vector)."""
    width = max(len(v) for _, _, v in rows)
    ints = [[int(np.floor(scale * float(x))) for x in v] + [0] * (width - len(v)) for _, _, v in rows]
    asked = {}
    for (i, label, _), v in zip(rows, ints):
        if i is not None and anchors(i) and (i not in asked or (label, v) < asked[i]):
            asked[i] = (label, v)
    out = []
    for a, (label, v) in asked.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j, other) for (j, other, _), w in zip(rows, ints) if j != a]
        best = sorted((s for s in scored if s[4] == label), key=lambda s: s[:3])[:positives]
        for p in best:
            fits = [s for s in scored if s[4] != label and share * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            for rank, s in enumerate(sorted(fits, key=lambda s: s[:3])[:negatives], 1):
                out.append((a, p[3], rank, s[3], -p[0], -s[0]))
    return sorted(out, key=str)


def mined(df, anchors, **options):
    index = hard_negatives.build_index(df, **{k: options.pop(k) for k in ("scale", "sample_rows", "leaf_rows") if k in options})
    return index, sorted((tuple(r) for r in hard_negatives.mine(index, anchors, **options).collect()), key=str)


def clustered(n, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, 5))
    return [(i, int(rng.integers(0, 3)), [float(x) for x in centres[i % 12] + rng.normal(0, spread, 5)]) for i in range(n)]


def test_negatives_of_a_deep_tree(spark):
    """Many small leaves and a small sample: every row is indexed, elimination loses nothing."""
    rows = clustered(1500, 3, 0.1)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    index, got = mined(df, F.col("vec_id") % 50 == 0, sample_rows=300, leaf_rows=20)
    assert got == plain_negatives(rows, lambda i: i % 50 == 0)
    assert index.tree.leaves > 40 and index.rows.count() == 1500
    assert max(len(r["rows"]) for r in index.blocks.collect()) < 400


def test_windows_eliminate_siblings(spark):
    """In clustered data most leaves are not reached, and all rows of the window are in those that are."""
    rows = clustered(3000, 4, 0.02)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    index = hard_negatives.build_index(df, leaf_rows=100)
    placed = index.rows.collect()
    x = np.array([r["v"] for r in placed], np.int64)
    leaf = np.array([r["leaf"] for r in placed])
    table = hard_negatives.scores(x[:40], x)
    high = np.sort(table, axis=1)[:, -2:-1].astype(float)
    inner, outer = hard_negatives._annuli(index.tree, x[:40], 0.98 * high, high)
    visited = {i: set() for i in range(40)}
    for number, at in hard_negatives.reached(index.tree, hard_negatives.asking(x[:40]), inner, outer):
        for i in at:
            visited[i].add(number)
    for i in range(40):
        inside = (table[i] >= 0.98 * high[i]) & (table[i] <= high[i])
        assert set(leaf[inside]) <= visited[i]
    assert sum(map(len, visited.values())) < 0.5 * 40 * index.tree.leaves


def test_negatives_of_the_table_and_few_partners(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    plain = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in rows.collect()]
    got = sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                  for r in QUERIES["op11_hard_negatives"](spark, SF_DIR).collect()), key=str)
    assert got == plain_negatives(plain, lambda i: i % 100 == 0)


def test_negatives_of_odd_rows(spark):
    """Nulls, non-finite and unequal vectors, ties, repeated rows, huge components, one vector in many rows, no rows."""
    nan = float("nan")
    rows = [(100, 1, [1.0, 0.5]), (100, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [1.0, 0.5]), (3, 2, [1.0, 0.5]), (None, 2, [1.0, 0.5]),
            (4, 2, [0.9, 0.5, 0.0]), (5, 1, []), (200, 2, [-1.0, -0.5]), (300, 3, [1e9, 2e9]), (6, 3, [0.001, 0.5]), (7, 1, [0.0, 0.9]), (8, 2, [0.0, 0.45])]
    rows += [(1000 + i, 1 + i % 2, [0.25, 0.25]) for i in range(7, 90)]
    bad = [(400, None, [1.0, 0.5]), (9, 1, None), (10, 1, [nan, 1.0]), (11, 1, [None, 1.0]), (12, 1, [float("inf")])]
    table = [(i, v, k, 1, "w", 2, 3) for i, k, v in rows + bad]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int, leaf int, window string, rank int, score int")
    _, got = mined(df, F.col("vec_id") % 100 == 0, leaf_rows=8)
    assert got == plain_negatives(rows, lambda i: i % 100 == 0)
    assert hard_negatives.build_index(df.where("vec_id in (400, 9, 10)")) is None
    assert mined(df, F.col("vec_id") < 0)[1] == []
