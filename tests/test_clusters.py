"""Cluster operators against brute force, including hot cells and hot keys."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as vec
from tidemark.operators import aggregates, clustering
from tidemark.operators.vectors import knn


def brute_dbscan(xs: np.ndarray, eps: float, min_samples: int, min_size: int) -> list[int]:
    near = ((xs[:, None, :] - xs[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= min_samples
    label = [-1] * len(xs)
    for start in np.flatnonzero(core):
        if label[start] != -1:
            continue
        found, todo = {int(start)}, [int(start)]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & core):
                if int(j) not in found:
                    found.add(int(j))
                    todo.append(int(j))
        for i in found:
            label[i] = min(found)
    sizes = {v: label.count(v) for v in set(label)}
    return [v if v != -1 and sizes[v] >= min_size else -1 for v in label]


def clustered(spark, xs, eps, min_samples, min_size, **options):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "article_id long, reduced array<double>").repartition(5)
    out = clustering.density_cluster(df, eps, min_size, min_samples, k=len(xs[0]), **options)
    return [r["cluster"] for r in out.orderBy("article_id").collect()]


def points(kind: str) -> np.ndarray:
    rng = np.random.default_rng(3)
    if kind == "uniform":
        return rng.random((300, 2))
    if kind == "hot":
        # A third of all points in one tiny cell, a second dense spot near the reach limit.
        hot = 0.5 + rng.random((150, 2)) * 0.01
        rim = np.array([0.5 + 0.05, 0.5]) + rng.random((100, 2)) * 0.01
        return np.vstack([hot, rim, rng.random((150, 2))])
    if kind == "copies":
        return np.vstack([np.full((120, 2), 0.25), np.full((60, 2), 0.3), rng.random((100, 2))])
    if kind == "chain":
        return np.array([[i * 0.045, math.sin(i / 9.0)] for i in range(150)])
    return rng.random((250, 3)) * 0.5


@pytest.mark.parametrize("kind", ["uniform", "hot", "copies", "chain", "cube"])
def test_density_cluster_equals_brute_force(spark, kind):
    xs = points(kind)
    eps, min_samples = (0.05, 4) if kind != "chain" else (0.2, 3)
    assert clustered(spark, xs, eps, min_samples, 5) == brute_dbscan(xs, eps, min_samples, 5)


def test_crowded_borders_are_refined(spark, monkeypatch):
    # With tiny leaves and salts every branch of the plan is used.
    monkeypatch.setattr(clustering, "LEAF_PAIRS", 4)
    monkeypatch.setattr(clustering, "SALT_ROWS", 10)
    xs = points("hot")
    assert clustered(spark, xs, 0.05, 4, 5) == brute_dbscan(xs, 0.05, 4, 5)


def test_runs_are_clustered_apart(spark):
    xs = points("uniform")
    rows = [(i, i % 3, [float(v) for v in x]) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "article_id long, call_id int, reduced array<double>")
    out = clustering.density_cluster(df, 0.09, 3, run=["call_id"]).collect()
    for call in range(3):
        ids = [i for i in range(len(xs)) if i % 3 == call]
        expected = [ids[v] if v >= 0 else -1 for v in brute_dbscan(xs[ids], 0.09, 3, 3)]
        assert [r["cluster"] for r in sorted(out, key=lambda r: r["article_id"]) if r["call_id"] == call] == expected


def test_only_noise(spark):
    assert clustered(spark, np.array([[0.0, 0.0], [5.0, 5.0], [9.0, 0.0]]), 0.1, 2, 2) == [-1, -1, -1]


def test_connected_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4999)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in clustering.connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(201))
    assert all(got[1000 + i] == 1000 for i in range(300))
    assert got[5000] == got[4999] == 4999


def cluster_frame(spark, rows):
    return spark.createDataFrame(rows, "article_id long, cluster int, ts timestamp, embedding array<double>")


def test_health_of_edge_clusters(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [
        (1, 0, day, [1.0, 0.0]), (2, 0, day, [1.0, 0.0]), (3, 0, day, [0.0, 0.0]),
        (4, 1, day, [1.0, 1.0]),
        (5, -1, day, [1.0, 0.0]), (6, -1, day, [0.0, 1.0]), (7, -1, day, [0.0, 1.0]), (8, -1, day, [0.0, 1.0]),
    ]
    got = {r["cluster"]: r for r in aggregates.rank_clusters(cluster_frame(spark, rows)).collect()}
    assert set(got) == {0, 1}
    # The size maximum counts noise; equal dates have no variance share.
    assert got[0]["size_importance"] == 0.75 and got[1]["size_importance"] == 0.25
    assert got[0]["cohesiveness"] == 1.0 and got[1]["cohesiveness"] == 0.0
    assert got[0]["time_variance"] is None


def test_cohesiveness_matches_the_full_matrix(spark):
    xs = np.random.default_rng(1).normal(size=(40, 8))
    unit = xs / np.linalg.norm(xs, axis=1)[:, None]
    full = unit @ unit.T
    np.fill_diagonal(full, 0.0)
    df = spark.createDataFrame([(0, [float(v) for v in x]) for x in xs], "cluster int, embedding array<double>")
    assert aggregates.cohesiveness(df).first()["cohesiveness"] == pytest.approx(full.mean(), abs=1e-12)


def test_only_noise_gives_no_cluster(spark):
    rows = [(1, -1, dt.datetime(2024, 1, 1), [1.0])]
    assert aggregates.rank_clusters(cluster_frame(spark, rows)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_median_date(spark, n):
    rng = np.random.default_rng(n)
    stamps = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 400_000, n)]
    df = spark.createDataFrame([(0, s) for s in stamps], "cluster int, ts timestamp")
    ordered = sorted(stamps)
    lo, hi = ordered[(n - 1) // 2], ordered[n // 2]
    assert aggregates.median_date(df).first()["median_date"] == lo + (hi - lo) / 2


def brute_silhouette(xs, labels, squared):
    d = ((xs[:, None, :] - xs[None, :, :]) ** 2).sum(axis=2)
    d = d if squared else np.sqrt(d)
    out = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == other].mean() for other in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return out


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean"])
def test_silhouette(spark, metric):
    rng = np.random.default_rng(5)
    xs, labels = rng.normal(size=(60, 4)), rng.integers(-1, 3, 60)
    labels[0] = 7
    rows = [(i, int(c), [float(v) for v in x]) for i, (c, x) in enumerate(zip(labels, xs))]
    df = spark.createDataFrame(rows, "article_id long, cluster int, embedding array<double>")
    out = clustering.silhouette(df, metric=metric, rows_per_block=16, clusters_per_block=2).orderBy("article_id")
    got = [r["silhouette"] for r in out.collect()]
    assert got == pytest.approx(brute_silhouette(xs, labels, metric == "sqeuclidean"), abs=1e-9)


def test_silhouette_needs_noise_or_exactly_two_labels(spark):
    rows = [(i, i % 3, [float(i)]) for i in range(9)]
    df = spark.createDataFrame(rows, "article_id long, cluster int, embedding array<double>")
    for metric in ("euclidean", "sqeuclidean"):
        assert clustering.silhouette(df, metric=metric).where("silhouette IS NOT NULL").count() == 0
    two = df.where("cluster < 2")
    assert clustering.silhouette(two, metric="sqeuclidean").where("silhouette IS NULL").count() == 0


def test_diverse_top(spark):
    rng = np.random.default_rng(2)
    xs = rng.normal(size=(50, 3))
    rows = [(i, i % 2, [float(v) for v in x]) for i, x in enumerate(xs)]
    rows += [(100 + i, 2, [1.0, 0.001 * i, 0.0]) for i in range(5)] + [(200, -1, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "article_id long, cluster int, embedding array<double>")
    got = clustering.diverse_top(df, 4, 0.6).collect()
    vec = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows}
    for c in (0, 1):
        ids = [r["article_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["cluster"] == c]
        assert 1 <= len(ids) <= 4
        assert all(vec[a] @ vec[b] <= 0.6 for a in ids for b in ids if a != b)
    assert [r["article_id"] for r in got if r["cluster"] == 2] == [100]
    assert not [r for r in got if r["cluster"] == -1]


def test_alike_in_the_undecided_band(spark):
    # All within 0.9 of the first article; in cluster 1 two others are further apart than that.
    def at(degrees):
        return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]

    rows = [(1, 0, at(0)), (2, 0, at(20)), (3, 0, at(25)), (4, 1, at(0)), (5, 1, at(20)), (6, 1, at(-20))]
    df = spark.createDataFrame(rows, "article_id long, cluster int, embedding array<double>")
    got = {r["cluster"] for r in clustering.all_alike(df, "embedding", ["cluster"], "article_id").collect()}
    assert got == {0}


def test_reduced_distances_equal_svd(spark):
    xs = np.random.default_rng(4).normal(size=(50, 6)) * np.array([5, 3, 1, 1, 1, 1])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "article_id long, embedding array<double>")
    got = np.array([r["reduced"] for r in clustering.reduce_dims(df).orderBy("article_id").collect()])
    centred = xs - xs.mean(axis=0)
    expected = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert np.linalg.norm(got[:, None] - got[None], axis=2) == pytest.approx(np.linalg.norm(expected[:, None] - expected[None], axis=2), abs=1e-8)


@pytest.mark.parametrize("plan", ["queries", "corpus", "blocks"])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_plans_equal_brute_force(spark, plan, metric):
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(30, 4)), rng.normal(size=(20, 4))
    c[5] = c[3]  # an exact tie
    queries = spark.createDataFrame([(i, "hot" if i % 3 else "x", [float(v) for v in x]) for i, x in enumerate(q)], "query_id long, kind string, embedding array<double>")
    corpus = spark.createDataFrame([(f"d{i:02}", "hot" if i % 4 else "x", [float(v) for v in x]) for i, x in enumerate(c)], "doc_id string, kind string, embedding array<double>")
    limit = {"queries": 1 << 20, "corpus": 2200, "blocks": 0}[plan]
    got = knn(queries, corpus, 3, ["kind"], metric, broadcast_bytes=limit, block_rows=4)
    found = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in got.collect()}
    for i, x in enumerate(q):
        pool = [j for j in range(20) if ("hot" if j % 4 else "x") == ("hot" if i % 3 else "x")]
        if metric == "l2":
            dist = {j: ((x - c[j]) ** 2).sum() for j in pool}
        else:
            dist = {j: 1 - x @ c[j] / np.linalg.norm(x) / np.linalg.norm(c[j]) for j in pool}
        best = sorted(pool, key=lambda j: (round(dist[j], 9), j))[:3]
        assert [found[(i, k + 1)] for k in range(len(best))] == [f"d{j:02}" for j in best]


def test_a_run_reduces_as_if_it_were_alone(spark, monkeypatch):
    monkeypatch.setattr(clustering, "MOMENT_ROWS", 7)
    monkeypatch.setattr(clustering, "MOMENT_FAN", 2)
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [float(v) for v in rng.normal(size=5) * (1 + i % 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "article_id long, call_id long, embedding array<double>")
    together = {r["article_id"]: r["reduced"] for r in clustering.reduce_dims(df, k=2, run=["call_id"]).collect()}
    for call in range(3):
        mine = df.where(F.col("call_id") == call)
        alone = {r["article_id"]: r["reduced"] for r in clustering.reduce_dims(mine, k=2, run=["call_id"]).collect()}
        whole = {r["article_id"]: r["reduced"] for r in clustering.reduce_dims(mine, k=2).collect()}
        for i, point in alone.items():
            np.testing.assert_allclose(together[i], point, atol=1e-9)
            np.testing.assert_allclose(np.abs(whole[i]), np.abs(point), atol=1e-6)


def test_rings_read_few_blocks_and_lose_nothing(spark):
    """Clustered rows, one hot key and vectors without length: exact results from a small part of all block pairs."""
    from tidemark.operators import metric_index
    from tidemark.operators.vectors import _best_of_block, merged_best

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 6)) * 10
    c = centres[np.arange(3000) % 30] + rng.normal(size=(3000, 6)) * 0.05
    c[7] = c[1000] = 0.0
    q = centres[np.arange(400) % 30] + rng.normal(size=(400, 6)) * 0.05
    q[3] = 0.0
    corpus = spark.createDataFrame([(i, "k", [float(v) for v in x]) for i, x in enumerate(c)], "cid long, key string, cvec array<double>")
    queries = spark.createDataFrame([(i, "k", [float(v) for v in x]) for i, x in enumerate(q)], "qid long, key string, qvec array<double>")
    for metric in ("l2", "cosine"):
        cells = spark.sparkContext.accumulator(0)

        def counted(qid, qvec, cid, cvec, k, metric, exclude_self):
            cells.add(len(qid) * len(cid))
            return _best_of_block(qid, qvec, cid, cvec, k, metric, exclude_self)

        found = metric_index.nearest_by_rings(queries, corpus, 5, metric, False, 32, counted)
        got = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in merged_best(found, 5).collect()}
        dist, ids = _best_of_block(np.arange(400), q, np.arange(3000), c, 5, metric, False)
        assert got == {(i, k + 1): ids[i, k] for i in range(400) for k in range(5)}
        assert cells.value < 0.35 * 400 * 3000


def test_results_are_merged_in_levels(spark, monkeypatch):
    from tidemark.operators import vectors

    monkeypatch.setattr(vectors, "MERGE_TASKS", 2)
    rows = spark.range(0, 4000, 1, 16).selectExpr("id % 7 AS query_id", "id AS neighbour_id", "CAST(pmod(id * 7919, 4001) AS DOUBLE) AS distance")
    got = sorted((r["query_id"], r["rank"], r["neighbour_id"]) for r in vectors.merged_best(rows, 3).collect())
    want = []
    for q in range(7):
        best = sorted(((i * 7919 % 4001, i) for i in range(4000) if i % 7 == q))[:3]
        want += [(q, k + 1, i) for k, (_, i) in enumerate(best)]
    assert got == want


def test_undecided_hot_cluster_uses_many_block_pairs(spark):
    rng = np.random.default_rng(5)
    angles = np.radians(rng.uniform(0, 25, 600))
    rows = [(i, 0, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)] + [(1000 + i, 1, [1.0, 0.001 * i]) for i in range(5)]
    rows += [(2000, 2, [1.0, 0.0]), (2001, 2, [float(np.cos(np.radians(25))), float(np.sin(np.radians(25)))]), (2002, 2, [float(np.cos(np.radians(-25))), float(np.sin(np.radians(-25)))])]
    units = spark.createDataFrame(rows, "article_id long, cluster int, _u array<double>")
    keys = units.select("cluster").distinct()
    got = clustering._pairwise_alike(units, keys, ["cluster"], "article_id", rows_per_block=32)
    assert {r["cluster"] for r in got.collect()} == {0, 1}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = clustering._pairwise_alike(units, keys, ["cluster"], "article_id", rows_per_block=32)
        text = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [x.split(")")[0] for x in text.split("hashpartitioning(")[1:]]
    assert any("_block" in x for x in shuffles) and any("_other" in x for x in shuffles)


def test_silhouettes_of_a_run_are_those_of_the_run_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, int(rng.integers(-1, 4)) if i % 3 else 0, [float(v) for v in rng.normal(size=3)]) for i in range(240)]
    df = spark.createDataFrame(rows, "article_id long, call_id int, cluster int, embedding array<double>")
    got = {r["article_id"]: r["silhouette"] for r in clustering.silhouette(df, metric="sqeuclidean", run=["call_id"], clusters_per_block=2).collect()}
    for call in range(3):
        alone = clustering.silhouette(df.where(F.col("call_id") == call), metric="sqeuclidean").collect()
        for r in alone:
            assert got[r["article_id"]] == pytest.approx(r["silhouette"], abs=1e-9)
    assert all(got[i] is None for i in range(0, 240, 3))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_euclidean_silhouette_shuffles_no_pair_of_packs(spark):
    """Packs meet in place: what is shuffled doesn't grow with the number of pairs of packs."""
    rng = np.random.default_rng(11)
    x, labels = rng.normal(size=(300, 4)), rng.integers(-1, 3, 300)
    df = spark.createDataFrame([(i, int(c), [float(v) for v in row]) for i, (c, row) in enumerate(zip(labels, x))], "article_id long, cluster long, embedding array<double>")
    scored = clustering.silhouette(df, rows_per_block=8)
    plan = _plan(scored)
    assert "CartesianProduct" in plan and "hashpartitioning(_block" not in plan
    dist = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for row in scored.collect():
        i, own = row["article_id"], labels[row["article_id"]]
        a = dist[i, labels == own].sum() / ((labels == own).sum() - 1)
        b = min(dist[i, labels == other].mean() for other in set(labels.tolist()) - {own})
        assert abs(row["silhouette"] - (b - a) / max(a, b)) < 1e-9


def test_packs_meet_ring_blocks_without_a_shuffle(spark, monkeypatch):
    """Many small packs over many blocks of several keys, one without corpus: exact, and no pair is shuffled."""
    from tidemark.operators import metric_index
    from tidemark.operators.vectors import _best_of_block, merged_best

    monkeypatch.setattr(metric_index, "PACK_ROWS", 8)
    monkeypatch.setattr(metric_index, "HELD_ROWS", 20)
    rng = np.random.default_rng(12)
    c, q = rng.normal(size=(600, 5)).round(1), rng.normal(size=(90, 5)).round(1)
    corpus = spark.createDataFrame([(i, f"k{i % 2}", [float(v) for v in x]) for i, x in enumerate(c)], "cid long, key string, cvec array<double>")
    queries = spark.createDataFrame([(i, f"k{i % 3}", [float(v) for v in x]) for i, x in enumerate(q)], "qid long, key string, qvec array<double>")
    found = metric_index.nearest_by_rings(queries, corpus, 4, "l2", False, 16, _best_of_block)
    plan = _plan(found)
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = {(r["query_id"], r["rank"]): (r["neighbour_id"], r["distance"]) for r in merged_best(found, 4).collect()}
    want = {}
    for i in range(90):
        mine = [j for j in range(600) if j % 2 == i % 3]
        best = sorted((round(float(((q[i] - c[j]) ** 2).sum()), 9), j) for j in mine)[:4]
        want |= {(i, n + 1): (j, d) for n, (d, j) in enumerate(best)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_vectors_of_runs_stay_in_place(spark):
    """Components and sums of runs are small: they go to the rows, and only ids and silhouettes are shuffled."""
    rng = np.random.default_rng(13)
    rows = [(i, i % 2, i // 2 % 3 - 1, [float(v) for v in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "article_id long, call_id long, cluster long, embedding array<double>")
    reduced = _plan(clustering.reduce_dims(df, k=2, run=["call_id"]))
    assert "BroadcastHashJoin" in reduced and "Exchange hashpartitioning" not in reduced
    scored = _plan(clustering.silhouette(df, metric="sqeuclidean", run=["call_id"]))
    assert scored.count("BroadcastHashJoin") == 2 and scored.count("SortMergeJoin") == 1


def test_sums_of_runs_meet_rows_alike_in_batches_and_in_blocks(spark, monkeypatch):
    """Repeated and NULL ids, clusters, runs and vectors included; components likewise."""
    rng = np.random.default_rng(5)
    rows = [(i // 2 if i < 20 else i, i % 3, i % 4 - 1, [float(v) for v in rng.normal(size=4)]) for i in range(60)]
    rows += [(None, 0, 1, [1.0, 2.0, 3.0, 4.0]), (91, None, 1, [1.0, 2.0, 3.0, 4.0]), (92, 1, None, [1.0, 2.0, 3.0, 4.0]), (93, 7, None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "article_id long, call_id int, cluster long, embedding array<double>")

    def results():
        scored = clustering.silhouette(df, metric="sqeuclidean", run=["call_id"]).collect()
        reduced = clustering.reduce_dims(df, k=2, run=["call_id"]).collect()
        flat = [(r["article_id"], r["call_id"], r["cluster"], r["embedding"], [r["silhouette"]]) for r in scored]
        return sorted(flat + [(r["article_id"], r["call_id"], r["cluster"], r["embedding"], r["reduced"]) for r in reduced], key=str)

    batches = results()
    monkeypatch.setattr(clustering, "SUMS_BYTES", -1)
    blocks = results()
    assert [r[:4] for r in batches] == [r[:4] for r in blocks]
    assert [v for r in batches for v in r[4]] == pytest.approx([v for r in blocks for v in r[4]])


def test_vectors_in_batches_are_those_of_the_engine(spark):
    """NULL, short, empty and zero vectors and NULL elements included."""
    v = [[1.0, 2.0], [0.0, 0.0], None, [3.0], [], [None, 1.0], [1.0, -2.0, 0.5]]
    df = spark.createDataFrame([(a, b) for a in v for b in v], "a array<double>, b array<double>").repartition(1)
    a, b = F.col("a"), F.col("b")
    got = df.select(
        vec.dot(a, b), vec.dot_rows(a, b), vec.cosine(a, b), vec.cosine_rows(a, b), vec.unit(a), vec.unit_rows(a), F.lit(0), F.lit(0)
    ).collect()
    for r in got:
        for one, other in ((r[0], r[1]), (r[2], r[3]), (r[4], r[5])):
            assert (one is None and other is None) or one == pytest.approx(other)
