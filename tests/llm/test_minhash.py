"""SuperMinHash near-duplicates and union-find grouping against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from tidemark.llm import grouping, minhash_dedup, superminhash

from .conftest import passage, texts_of


def word_runs(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def plain_groups(rows):
    """(id, set size, component, kept) of (id, text) rows by comparing all pairs."""
    sets = [word_runs(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
            parent[root(b)] = root(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        component = least.get(root(k)) if sets[k] else i
        out.append((i, len(sets[k]), component, i is not None and i == component))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in minhash_dedup.near_groups(df).collect()), key=str)


def test_groups_of_odd_texts(edge_docs, no_docs):
    assert found(edge_docs) == plain_groups(texts_of(edge_docs))
    assert minhash_dedup.near_groups(no_docs).count() == 0


def test_groups_of_a_family_with_many_members(spark):
    """Edits of one text at all distances, far beyond LIST_ROWS, with sub-families and chains: no link is lost."""
    rng = random.Random(7)
    base = passage(3, 120).split(" ")
    rows = []
    for i in range(420):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 10])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    side = [w if k % 15 else f"x{k}" for k, w in enumerate(base)]
    for i in range(60):
        words = list(side)
        words[rng.randrange(120)] = f"y{rng.randrange(50)}"
        rows.append((2000 + i, " ".join(words)))
    rows += [(3000 + i, " ".join(base[i : i + 100])) for i in range(20)]
    rows += [(4000 + i, "same short text") for i in range(50)] + [(5000 + i, f"{i} b") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == plain_groups(rows)


def test_blocks_of_large_lists(spark, monkeypatch):
    """Tiny blocks and lists: links come from pairs of blocks, of one size class and of neighbouring ones."""
    monkeypatch.setattr(minhash_dedup, "LIST_ROWS", 2)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 5)
    rng = random.Random(2)
    base = passage(8, 60).split(" ")
    rows = []
    for i in range(120):
        words = base + [f"tail{k}" for k in range(rng.randrange(8))]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == plain_groups(rows)


def plain_signature(elements, slots):
    """The definition, element by element: slot order[j] of an element's own shuffle gets j and a fraction."""
    best = [None] * slots
    for e in elements:
        order = list(range(slots))
        for j in range(slots):
            draw = int(superminhash.mixed(np.array([(int(e) + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            k = j + ((draw & 0xFFFFFFFF) * (slots - j) >> 32)
            order[j], order[k] = order[k], order[j]
            value = (j << 32) | (draw >> 32)
            if best[order[j]] is None or value < best[order[j]]:
                best[order[j]] = value
    return best


def test_signatures_with_early_stops_equal_the_definition():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 7, 30, 200, 3)]
    got = superminhash.signatures(sets, 16)
    for elements, row in zip(sets, got):
        assert row.tolist() == plain_signature(elements, 16)
    empty = superminhash.signatures([np.zeros(0, np.uint64)], 16)
    assert (empty == superminhash._OPEN).all()
    big = np.unique(rng.integers(0, 2**64, 40_000, dtype=np.uint64))
    halves = np.minimum(superminhash.signatures([big[::2]]), superminhash.signatures([big[1::2]]))
    assert (superminhash.signatures([big]) == halves).all()


def test_signatures_vary_less_than_independent_minima():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        pool = rng.integers(0, 2**64, 92, dtype=np.uint64)
        a, b = superminhash.signatures([np.unique(pool[:80]), np.unique(pool[12:])])
        errors.append((a == b).mean() - 68 / 92)
    independent = np.sqrt(68 / 92 * 24 / 92 / superminhash.SLOTS)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.85 * independent


def test_grouping(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(90)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    sets = grouping.UnionFind()
    for a, b in links:
        sets.union(a, b)
    got = {r["node"]: r["root"] for r in grouping.grouped(spark.createDataFrame(links, "src bigint, dst bigint").repartition(12)).collect()}
    assert got == {n: sets.find(n) for n in sets}
    assert grouping.grouped(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
