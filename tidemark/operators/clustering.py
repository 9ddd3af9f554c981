"""Dimension reduction, density clustering and silhouettes.

Density clustering is DBSCAN* (Campello, Moulavi, Sander 2013): a point is core
when at least ``min_samples`` points, itself included, lie within ``eps``; core
points within ``eps`` of each other share a cluster; all other points are noise.
The plan works on grid cells, so its cost grows with the rows even when one cell
holds a large share of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import cosine_rows, dot, dot_rows, matrix, unit_rows
from tidemark.operators.aggregates import centroid, summed_vector
from tidemark.session import cut_lineage, write_once

NOISE = -1
# Points of one cell that may meet a neighbour's points in one task.
SALT_ROWS = 20_000
# Rows that meet one block of clusters in one task.
ROWS_PER_SALT = 1_000_000
# Sums of clusters that are sent to every task, and clusters of a block beyond that.
SUMS_BYTES, CLUSTERS_PER_BLOCK = 64 * 1024 * 1024, 256
# Rows whose products are summed in one group, and sums added in one group.
MOMENT_ROWS, MOMENT_FAN = 10_000, 64
# Rows that are packed together for the euclidean silhouette, and the size of a part that meets another part in one task.
PACK_ROWS, PART_BYTES = 1024, 64 * 1024 * 1024
# Two boxes with at most this many point pairs are compared point by point.
LEAF_PAIRS = 256


def reduce_dims(df: DataFrame, vec: str = "embedding", k: int = 2, out: str = "reduced", run: Sequence[str] = ()) -> DataFrame:
    """First ``k`` principal components; only a d x d matrix reaches the driver.

    With ``run`` columns every run has its own components, as if it were alone.
    """
    if run:
        return _reduce_runs(df, vec, k, out, list(run))
    usable = df.where(F.col(vec).isNotNull()).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    if usable.isEmpty():
        return usable.withColumn(out, F.lit(None).cast("array<double>")).drop("_v")
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(usable)
    return model.transform(usable).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def _reduce_runs(df: DataFrame, vec: str, k: int, out: str, run: list[str]) -> DataFrame:
    """Components per run from sums of products.

    A run's rows are dealt over groups of about ``MOMENT_ROWS``; each gives one d x d sum, and the sums of a run are
    added in levels of ``MOMENT_FAN``, so no group grows with the run.
    """
    usable = df.where(F.col(vec).isNotNull()).withColumn("_v", F.col(vec).cast("array<double>"))
    keys = run_schema(usable, run)
    # Small tables are written, so that their size is known and the vectors stay where they are.
    sizes = write_once(usable.groupBy(*run).agg(F.ceil(F.count("*") / F.lit(MOMENT_ROWS)).alias("_groups")), "run-sizes")
    dealt = usable.join(sizes, run).select(*run, F.pmod(F.xxhash64("_v"), F.col("_groups")).alias("_group"), "_v")

    def moments(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["_v"].to_numpy())
        head = rows[[*run, "_group"]].head(1)
        return head.assign(_n=float(len(x)), _sum=[x.sum(0)], _gram=[(x.T @ x).ravel()])

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        head = parts[[*run, "_group"]].head(1)
        return head.assign(_n=parts["_n"].sum(), _sum=[np.sum(parts["_sum"].to_list(), 0)], _gram=[np.sum(parts["_gram"].to_list(), 0)])

    def components(parts: pd.DataFrame) -> pd.DataFrame:
        whole = added(parts)
        n, total, gram = (whole[c].iloc[0] for c in ("_n", "_sum", "_gram"))
        covariance = gram.reshape(len(total), -1) / n - np.outer(total, total) / n**2
        axes = np.linalg.eigh(covariance)[1][:, ::-1][:, :k].T
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        return parts[run].head(1).assign(_axes=[axes.tolist()])

    schema = f"{keys}, _group bigint, _n double, _sum array<double>, _gram array<double>"
    parts = dealt.groupBy(*run, "_group").applyInPandas(moments, schema)
    groups = sizes.agg(F.max("_groups")).first()[0] or 1
    while groups > MOMENT_FAN:
        groups = -(-groups // MOMENT_FAN)
        parts = parts.withColumn("_group", F.floor(F.col("_group") / F.lit(MOMENT_FAN)))
        parts = parts.groupBy(*run, "_group").applyInPandas(added, schema)
    axes = write_once(parts.groupBy(*run).applyInPandas(components, f"{keys}, _axes array<array<double>>"), "axes")
    width = axes.agg(F.sum(8 * k * F.size(F.get("_axes", F.lit(0))) + 64).alias("b")).first()["b"] or 0
    if width > SUMS_BYTES:
        return usable.join(axes, run).withColumn(out, F.transform("_axes", lambda a: dot(a, F.col("_v")))).select(*df.columns, out)
    # The components are sent to the rows, whose products are made a batch at a time.
    found = axes.collect()
    shared = df.sparkSession.sparkContext.broadcast([np.array(r["_axes"], "float64") for r in found])

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def projected(runs: pa.Array, vectors: pa.Array) -> pa.Array:
        points, there, of = np.zeros((len(vectors), k)), np.zeros(len(vectors), bool), runs.to_numpy(zero_copy_only=False)
        for number in np.unique(of).tolist():
            rows, axes = np.flatnonzero(of == number), shared.value[number]
            x, full = matrix(vectors.take(pa.array(rows)), axes.shape[1])
            points[rows], there[rows] = x @ axes.T, full
        return pa.ListArray.from_arrays(np.arange(0, points.size + 1, k, dtype=np.int32), pa.array(points.ravel()), mask=pa.array(~there))

    placed = usable.join(_numbered(usable, run, [[r[c] for c in run] for r in found]), run)
    return placed.withColumn(out, projected(F.col("_at"), F.col("_v"))).select(*df.columns, out)


def _numbered(df: DataFrame, run: list[str], runs: list[list]) -> DataFrame:
    """The listed runs with their place in the list, sent to every task."""
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in run], T.StructField("_at", T.IntegerType())])
    return F.broadcast(df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(runs)], schema))


def run_schema(df: DataFrame, run: Sequence[str]) -> str:
    """The run columns as a schema text."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in run)


def min_cluster_size(df: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """One row (one for each run): 1 % of the rows, at least 5."""
    return df.groupBy(*run).agg(F.greatest(F.lit(5), F.floor(F.count("*") * F.lit(0.01))).cast("long").alias("min_cluster_size"))


# -- grid ------------------------------------------------------------------------------------


def _grid(df: DataFrame, eps: float, id_col: str, coords: str, k: int, run: Sequence[str]) -> DataFrame:
    """Points as (run, id, t, cell): ``t`` is the position in cell widths.

    The cell diagonal is just under ``eps``, so all points of a cell are
    neighbours of each other.
    """
    side = eps / math.sqrt(k) * (1.0 - 1e-9)
    points = df.select(
        *run,
        F.col(id_col).cast("long").alias("id"),
        *[F.get(F.col(coords), F.lit(i)).cast("double").alias(f"x{i}") for i in range(k)],
    )
    return points.withColumns(
        {f"t{i}": F.col(f"x{i}") / F.lit(side) for i in range(k)}
    ).withColumn("cell", F.array(*[F.floor(F.col(f"t{i}")) for i in range(k)]))


def _offsets(k: int, half: bool = False) -> list[tuple[int, ...]]:
    """Cells that can hold a neighbour; ``half`` keeps one of each opposite pair."""
    reach = math.ceil(math.sqrt(k) * (1.0 + 1e-9)) if k > 1 else 2
    every = [o for o in itertools.product(range(-reach, reach + 1), repeat=k) if any(o)]
    return [o for o in every if o > tuple([0] * k)] if half else every


def _neighbour_cells(k: int, half: bool = False, with_own: bool = False) -> Column:
    """Exploded neighbour cells of the column ``cell``."""
    offsets = _offsets(k, half) + ([tuple([0] * k)] if with_own else [])
    shifted = [F.array(*[F.col("cell")[i] + F.lit(o[i]) for i in range(k)]) for o in offsets]
    return F.explode(F.array(*shifted))


def _square_distance(k: int, a: str = "", b: str = "o_") -> Column:
    parts = [(F.col(f"{a}x{i}") - F.col(f"{b}x{i}")) ** 2 for i in range(k)]
    return sum(parts[1:], parts[0])


def eps_neighbours(
    queries: DataFrame, points: DataFrame, cells: DataFrame, eps: float, k: int, run: Sequence[str]
) -> DataFrame:
    """Range join: pairs (query, point) with distance at most ``eps``.

    Meant for a query side with few rows per cell. A crowded target cell is
    salted, so its rows are spread over several tasks.
    """
    keys = [*run, "cell"]
    xs = [f"x{i}" for i in range(k)]
    salts = cells.select(*keys, F.ceil(F.col("n") / F.lit(SALT_ROWS)).cast("int").alias("_salts"))
    asked = queries.select(*run, F.col("id").alias("query_id"), *xs, _neighbour_cells(k, with_own=True).alias("cell"))
    asked = asked.join(salts, keys).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    ).drop("_salts")
    held = points.join(salts, keys).select(
        *keys,
        F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int").alias("_salt"),
        F.col("id").alias("o_id"),
        *[F.col(x).alias(f"o_{x}") for x in xs],
    )
    pairs = asked.join(held, [*keys, "_salt"])
    return pairs.where(_square_distance(k) <= F.lit(eps * eps)).select(*run, "query_id", F.col("o_id").alias("point_id"))


def _with_least(df: DataFrame, least: int | DataFrame, run: Sequence[str]) -> DataFrame:
    """Add ``_least``: one number for all rows, or each run's own from a table (run, least)."""
    if isinstance(least, int):
        return df.withColumn("_least", F.lit(least))
    return df.join(least.select(*run, F.col("least").alias("_least")), list(run))


def core_points(points: DataFrame, eps: float, min_samples: int | DataFrame, k: int, run: Sequence[str]) -> DataFrame:
    """Grid points that are core. ``min_samples`` is a number, or a table (run, least) with each run's own.

    A cell with ``min_samples`` points is core as a whole. Only points of emptier
    cells are counted against their surroundings: fewer than ``min_samples`` per
    cell, so the range join stays linear in the rows.
    """
    keys = [*run, "cell"]
    cells = points.groupBy(*keys).agg(F.count("*").alias("n"))
    sized = points.join(_with_least(cells, min_samples, run), keys)
    dense = sized.where(F.col("n") >= F.col("_least")).drop("n", "_least")
    sparse = sized.where(F.col("n") < F.col("_least")).drop("n", "_least")
    counts = eps_neighbours(sparse, points, cells, eps, k, run).groupBy(*run, F.col("query_id").alias("id")).agg(
        F.count("*").alias("_n")
    )
    enough = _with_least(counts, min_samples, run).where(F.col("_n") >= F.col("_least")).drop("_n", "_least")
    return dense.unionByName(sparse.join(enough, [*run, "id"], "left_semi"))


# -- which core cells touch ------------------------------------------------------------------


def _boxes(core: DataFrame, level: int, k: int, run: Sequence[str]) -> DataFrame:
    """Bounding box and count of the points of each sub-cell at a level.

    A level-``L`` sub-cell has 1/2**L of the cell width.
    """
    sub = F.array(*[F.floor(F.col(f"t{i}") * F.lit(float(2**level))) for i in range(k)])
    bounds = []
    for i in range(k):
        bounds += [F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}")]
    return core.groupBy(*run, "cell", sub.alias("sub")).agg(F.count("*").alias("n"), *bounds)


def _renamed(df: DataFrame, prefix: str, run: Sequence[str]) -> DataFrame:
    return df.select(*run, *[F.col(c).alias(prefix + c) for c in df.columns if c not in run])


def _box_distances(k: int) -> tuple[Column, Column]:
    """Smallest and largest squared distance between points of two boxes."""
    near, far = F.lit(0.0), F.lit(0.0)
    for i in range(k):
        gap = F.greatest(F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.lit(0.0))
        reach = F.greatest(F.col(f"b_hi{i}") - F.col(f"a_lo{i}"), F.col(f"a_hi{i}") - F.col(f"b_lo{i}"))
        near, far = near + gap * gap, far + reach * reach
    return near, far


def touching_cells(core: DataFrame, eps: float, k: int, run: Sequence[str]) -> DataFrame:
    """Pairs of core cells that hold core points within ``eps`` of each other.

    Boxes around the points decide most pairs at once: all of one within reach
    of all of the other, or out of reach. Undecided pairs with few point pairs
    are compared exactly; crowded ones are cut into quarter cells and tried
    again, until boxes shrink to single positions.
    """
    limit = F.lit(eps * eps)
    pair = [*run, "a_cell", "b_cell"]
    boxes = _boxes(core, 0, k, run)
    left = _renamed(boxes, "a_", run)
    halves = boxes.select(*run, F.col("cell").alias("_own"), _neighbour_cells(k, half=True).alias("cell"))
    candidates = (
        halves.join(_renamed(boxes, "b_", run).withColumn("cell", F.col("b_cell")), [*run, "cell"])
        .drop("cell").join(left.withColumn("_own", F.col("a_cell")), [*run, "_own"]).drop("_own")
    )
    near, far = _box_distances(k)
    verdict = (
        F.when(near > limit, "apart").when(far <= limit, "touch")
        .when(F.col("a_n") * F.col("b_n") <= LEAF_PAIRS, "leaf").otherwise("open")
    )
    touching: list[DataFrame] = []
    leaves: list[DataFrame] = []
    level = 0
    while True:
        judged = cut_lineage(candidates.withColumn("_v", verdict).where("_v <> 'apart'"))
        touching.append(judged.where("_v = 'touch'").select(*pair).distinct())
        leaves.append(
            judged.where("_v = 'leaf'").select(*pair, "a_sub", "b_sub", F.lit(level).alias("level"))
        )
        undecided = judged.where("_v = 'open'").select(*pair, "a_sub", "b_sub")
        undecided = undecided.join(touching[-1], pair, "left_anti")
        if undecided.isEmpty():
            break
        level += 1
        finer = _boxes(core, level, k, run)
        parent = F.transform("sub", lambda s: F.shiftright(s, 1))
        finer = finer.withColumn("parent", parent)
        candidates = undecided
        for side in ("a_", "b_"):
            mine = _renamed(finer, side, run).withColumnRenamed(f"{side}parent", "_parent")
            candidates = (
                candidates.withColumnRenamed(f"{side}sub", "_parent")
                .join(mine, [*run, f"{side}cell", "_parent"]).drop("_parent")
            )
    found = touching[0]
    for more in touching[1:]:
        found = found.unionByName(more)
    pending = leaves[0]
    for more in leaves[1:]:
        pending = pending.unionByName(more)
    pending = pending.join(found, pair, "left_anti")
    by_points = _leaf_contacts(pending, core, eps, level, k, run)
    return found.unionByName(by_points).distinct()


def _leaf_contacts(pending: DataFrame, core: DataFrame, eps: float, deepest: int, k: int, run: Sequence[str]) -> DataFrame:
    """Cell pairs of small sub-cells with at least one point pair in reach."""
    xs = [f"x{i}" for i in range(k)]
    subs = [
        F.struct(
            F.lit(level).alias("level"),
            F.array(*[F.floor(F.col(f"t{i}") * F.lit(float(2**level))) for i in range(k)]).alias("sub"),
        )
        for level in range(deepest + 1)
    ]
    keyed = core.select(*run, "cell", *xs, F.explode(F.array(*subs)).alias("_s")).select(
        *run, "cell", *xs, F.col("_s.level").alias("level"), F.col("_s.sub").alias("sub")
    )
    pairs = pending
    for side, prefix in (("a_", "a_"), ("b_", "b_")):
        mine = keyed.select(
            *run, "level", F.col("cell").alias(f"{side}cell"), F.col("sub").alias(f"{side}sub"),
            *[F.col(x).alias(prefix + x) for x in xs],
        )
        pairs = pairs.join(mine, [*run, "level", f"{side}cell", f"{side}sub"])
    close = pairs.where(_square_distance(k, "a_", "b_") <= F.lit(eps * eps))
    return close.select(*run, "a_cell", "b_cell").distinct()


# -- connected components --------------------------------------------------------------------


def connected_components(edges: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """(run, node, component) of the nodes in ``edges(src, dst)``; the component is
    its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the edges
    turn into stars in a logarithmic number of rounds, each round a minimum per
    node and a join. Lineage is cut by a checkpoint in every round.
    """
    run = list(run)
    state = edges.where("src <> dst").select(
        *run, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    state = cut_lineage(state)
    mark = _fingerprint(state)
    while True:
        both = state.unionByName(state.select(*run, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*run, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, [*run, "u"]).select(*run, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy(*run, "u").agg(F.min("v").alias("m"))
        moved = large.join(low, [*run, "u"])
        small = moved.select(*run, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select(*run, "u", F.col("m").alias("v"))
        )
        state = cut_lineage(small.where("u <> v").distinct())
        now = _fingerprint(state)
        if now == mark:
            break
        mark = now
    roots = state.select(*run, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(*run, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(state: DataFrame) -> tuple:
    """Order-free digest of the edge set."""
    hashes = state.select(F.xxhash64(*state.columns).alias("h"))
    row = hashes.agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["x"], row["s"]


# -- density clusters ------------------------------------------------------------------------


def density_cluster(
    df: DataFrame,
    eps: float,
    min_cluster_size: int | DataFrame = 3,
    min_samples: int | DataFrame | None = None,
    id_col: str = "article_id",
    coords: str = "reduced",
    k: int = 2,
    run: Sequence[str] = (),
    out: str = "cluster",
) -> DataFrame:
    """Add the density cluster of each row, -1 for noise.

    A cluster is named by its smallest core id, so the result does not depend on
    row order. ``run`` columns (such as the call) are clustered independently in
    the same job; ``min_cluster_size`` may be a table (run, least) with each run's own.
    ``k`` is the number of coordinates, at most 3.
    """
    if not 1 <= k <= 3:
        raise ValueError("the grid supports 1 to 3 coordinates; reduce the vectors first")
    run = list(run)
    min_samples = min_cluster_size if min_samples is None else min_samples
    points = cut_lineage(_grid(df, eps, id_col, coords, k, run).dropna(subset=[f"x{i}" for i in range(k)]))
    core = cut_lineage(core_points(points, eps, min_samples, k, run))
    cells = core.groupBy(*run, "cell").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    names = cells.drop("n")
    touching = touching_cells(core, eps, k, run)
    edges = touching
    for side, name in (("a_cell", "src"), ("b_cell", "dst")):
        edges = edges.join(names.withColumnsRenamed({"cell": side, "node": name}), [*run, side])
    components = connected_components(edges.select(*run, "src", "dst"), run)
    labelled = cells.join(components, [*run, "node"], "left").withColumn(
        "label", F.coalesce("component", "node")
    )
    sizes = labelled.groupBy(*run, "label").agg(F.sum("n").alias("rows"))
    large = _with_least(sizes, min_cluster_size, run).where(F.col("rows") >= F.col("_least"))
    kept = labelled.join(large, [*run, "label"]).select(*run, "cell", "label")
    member = core.join(kept, [*run, "cell"]).select(*run, F.col("id").alias("_id"), "label")
    joined = df.withColumn("_id", F.col(id_col).cast("long")).join(member, [*run, "_id"], "left")
    return joined.withColumn(out, F.coalesce("label", F.lit(NOISE).cast("long"))).select(*df.columns, out)


# -- silhouettes -----------------------------------------------------------------------------


def _silhouette_allowed(stats: DataFrame, cluster: str) -> Column:
    """More than one label with noise present, or exactly two labels without noise."""
    labels = stats.agg(F.count("*").alias("k"), F.max((F.col(cluster) == NOISE).cast("int")).alias("noise"))
    k, noise = labels.select("k").scalar(), labels.select("noise").scalar()
    return ((k > 1) & (noise == 1)) | ((k == 2) & (noise == 0))


def _silhouette(own_sum: Column, own_n: Column, other: Column) -> Column:
    """(b - a) / max(a, b); 0 for a cluster of one row."""
    a = own_sum / (own_n - F.lit(1.0))
    return F.when(own_n <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(other - a, F.greatest(a, other)), F.lit(0.0))
    )


def silhouette(
    df: DataFrame,
    vec: str = "embedding",
    cluster: str = "cluster",
    id_col: str = "article_id",
    metric: str = "euclidean",
    out: str = "silhouette",
    clusters_per_block: int | None = None,
    rows_per_block: int = 1024,
    run: Sequence[str] = (),
) -> DataFrame:
    """Add the silhouette of each row; noise counts as a label. With ``run`` columns each run is judged alone.

    ``sqeuclidean`` needs one pass for the sums per cluster and one pass over the
    rows against those sums: sums below ``SUMS_BYTES`` are sent to the rows, others meet
    them in blocks of ``clusters_per_block``. ``euclidean`` has no such closed form: distances are
    summed inside the tasks, ``rows_per_block`` rows at a time, which takes time quadratic in the rows; what is written
    and shuffled is not.
    NULL for every row when the labels do not allow a silhouette.
    """
    if run:
        if metric != "sqeuclidean":
            raise ValueError("runs are judged by squared distances")
        return _silhouette_runs(df, vec, cluster, id_col, out, clusters_per_block or CLUSTERS_PER_BLOCK, list(run))
    if metric == "sqeuclidean":
        return _silhouette_squared(df, vec, cluster, id_col, out, clusters_per_block)
    return _silhouette_euclidean(df, vec, cluster, id_col, out, rows_per_block)


def _silhouette_squared(df: DataFrame, vec: str, cluster: str, id_col: str, out: str, per_block: int | None) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    # One row a cluster, read several times.
    stats = cut_lineage(df.groupBy(cluster).agg(
        F.count("*").cast("double").alias("n"),
        summed_vector("sum", v, F.lit(1.0)).alias("s"),
        F.sum(dot(v, v)).alias("q"),
    ))
    member = F.struct(F.col(cluster).alias("c"), "n", "s", "q")
    rows = df.select(F.col(id_col), F.col(cluster), v.alias("_v")).withColumn("_vv", dot(F.col("_v"), F.col("_v")))
    width = stats.agg(F.sum(8 * F.size("s") + 64).alias("b")).first()["b"] or 0
    if per_block is None and width <= SUMS_BYTES:
        packed = F.broadcast(stats.groupBy(F.lit(0).alias("_block")).agg(F.collect_list(member).alias("_stats")))
        met = rows.withColumn("_block", F.lit(0)).join(packed, "_block")
    else:
        # Clusters are packed into blocks of bounded width and every row meets each
        # block; salts keep the rows that meet one block in several tasks.
        blocks = F.ceil(stats.agg(F.count("*")).scalar() / F.lit(per_block or CLUSTERS_PER_BLOCK))
        salts = F.ceil(df.agg(F.count("*")).scalar() / F.lit(ROWS_PER_SALT))
        packed = stats.withColumn("_block", F.pmod(F.xxhash64(cluster), blocks)).groupBy("_block").agg(F.collect_list(member).alias("_stats"))
        packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        spread = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col), salts)).withColumn(
            "_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
        )
        met = spread.join(packed, ["_block", "_salt"])

    def total(s: Column) -> Column:
        """Sum of squared distances from the row to the cluster."""
        return s["n"] * F.col("_vv") - F.lit(2.0) * dot(F.col("_v"), s["s"]) + s["q"]

    meets = met.select(
        id_col,
        cluster,
        F.array_min(
            F.transform(F.filter("_stats", lambda s: s["c"] != F.col(cluster)), lambda s: total(s) / s["n"])
        ).alias("_b"),
        F.array_max(F.transform(F.filter("_stats", lambda s: s["c"] == F.col(cluster)), total)).alias("_own"),
        F.array_max(F.transform(F.filter("_stats", lambda s: s["c"] == F.col(cluster)), lambda s: s["n"])).alias("_n"),
    )
    best = meets.groupBy(id_col).agg(F.min("_b").alias("_b"), F.max("_own").alias("_own"), F.max("_n").alias("_n"))
    value = _silhouette(F.greatest("_own", F.lit(0.0)), F.col("_n"), F.col("_b"))
    scored = best.select(id_col, F.when(_silhouette_allowed(stats, cluster), value).alias(out))
    return df.join(scored, id_col)


def _silhouette_runs(df: DataFrame, vec: str, cluster: str, id_col: str, out: str, per_block: int, run: list[str]) -> DataFrame:
    """Squared silhouettes of many runs: a row meets the sums of its own run's clusters, in blocks and salts of the run."""
    v = F.col(vec).cast("array<double>")
    squared = df.select(*run, cluster, v.alias("_v"), dot_rows(v, v).alias("_vv"))
    stats = cut_lineage(squared.groupBy(*run, cluster).agg(
        F.count("*").cast("double").alias("n"), summed_vector("sum", F.col("_v"), F.lit(1.0)).alias("s"), F.sum("_vv").alias("q")
    ))
    k, noise = F.count("*"), F.max((F.col(cluster) == NOISE).cast("int"))
    runs = stats.groupBy(*run).agg(
        F.ceil(k / F.lit(per_block)).alias("_blocks"), F.ceil(F.sum("n") / F.lit(ROWS_PER_SALT)).alias("_salts"),
        (((k > 1) & (noise == 1)) | ((k == 2) & (noise == 0))).alias("_allowed"),
    )
    width = stats.agg(F.sum(8 * F.size("s") + 64).alias("b")).first()["b"] or 0
    if width <= SUMS_BYTES:
        meets = _met_in_batches(df.select(*run, id_col, cluster, v.alias("_v")).join(write_once(runs, "runs"), run), stats, cluster, id_col, run)
    else:
        meets = _met_in_blocks(df.select(*run, id_col, cluster, v.alias("_v")), stats, runs, cluster, id_col, run)
    best = meets.groupBy(*run, id_col, "_allowed").agg(F.min("_b").alias("_b"), F.max("_own").alias("_own"), F.max("_n").alias("_n"))
    value = _silhouette(F.greatest("_own", F.lit(0.0)), F.col("_n"), F.col("_b"))
    return df.join(best.select(*run, id_col, F.when(F.col("_allowed"), value).alias(out)), [*run, id_col])


def _met_in_blocks(rows: DataFrame, stats: DataFrame, runs: DataFrame, cluster: str, id_col: str, run: list[str]) -> DataFrame:
    """Each row with the sums of its run's clusters, block by block: least mean to another cluster, sum and size of its own."""
    packed = stats.join(runs, run).withColumn("_block", F.pmod(F.xxhash64(cluster), "_blocks")).groupBy(*run, "_block", "_salts").agg(
        F.collect_list(F.struct(F.col(cluster).alias("c"), "n", "s", "q")).alias("_stats")
    )
    packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    # Written, so that their size is known: small ones go to the rows.
    packed, runs = write_once(packed, "packed-sums"), write_once(runs, "runs")
    spread = rows.join(runs, run).withColumn("_salt", F.pmod(F.xxhash64(id_col), "_salts")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    )

    def total(s: Column) -> Column:
        return s["n"] * dot(F.col("_v"), F.col("_v")) - F.lit(2.0) * dot(F.col("_v"), s["s"]) + s["q"]

    own = F.filter("_stats", lambda s: s["c"] == F.col(cluster))
    others = F.filter("_stats", lambda s: s["c"] != F.col(cluster))
    return spread.join(packed, [*run, "_block", "_salt"]).select(
        *run, id_col, "_allowed", F.array_min(F.transform(others, lambda s: total(s) / s["n"])).alias("_b"),
        F.array_max(F.transform(own, total)).alias("_own"), F.array_max(F.transform(own, lambda s: s["n"])).alias("_n"),
    )


def _met_in_batches(rows: DataFrame, stats: DataFrame, cluster: str, id_col: str, run: list[str]) -> DataFrame:
    """As ``_met_in_blocks``, with all sums sent to the tasks and the products of a batch of rows made at once."""
    known: dict[tuple, list] = {}
    for r in stats.dropna(subset=run).collect():
        of = known.setdefault(tuple(r[c] for c in run), [])
        if r[cluster] is not None:
            of.append((r[cluster], r["n"], r["s"], r["q"]))
    sums = [[np.array(c, None if i == 0 else "float64") for i, c in enumerate(zip(*of))] for of in known.values()]
    shared = rows.sparkSession.sparkContext.broadcast(sums)
    result = T.StructType([T.StructField(c, T.DoubleType()) for c in ("_b", "_own", "_n")])

    @F.arrow_udf(result)
    def met(runs: pa.Array, own: pa.Array, vectors: pa.Array) -> pa.Array:
        of, out = runs.to_numpy(zero_copy_only=False), np.full((3, len(own)), np.inf)
        placed = own.is_valid().to_numpy(zero_copy_only=False)
        for number in np.unique(of).tolist():
            rows = np.flatnonzero((of == number) & placed)
            if not shared.value[number] or not len(rows):
                continue
            names, n, s, q = shared.value[number]
            mine = own.take(pa.array(rows)).to_numpy(zero_copy_only=False)[:, None] == names
            out[2, rows] = np.where(mine, n, -np.inf).max(axis=1)
            x, full = matrix(vectors.take(pa.array(rows)), s.shape[1])
            total = n * (x * x).sum(axis=1)[:, None] - 2.0 * (x @ s.T) + q
            out[0, rows[full]] = np.where(mine, np.inf, total / n)[full].min(axis=1)
            out[1, rows[full]] = np.where(mine, total, -np.inf)[full].max(axis=1)
        return pa.StructArray.from_arrays([pa.array(c, mask=np.isinf(c)) for c in out], ["_b", "_own", "_n"])

    placed = rows.join(_numbered(rows, run, [list(r) for r in known]), run)
    return placed.select(*run, id_col, "_allowed", met(F.col("_at"), F.col(cluster), F.col("_v")).alias("_m")).select(*run, id_col, "_allowed", "_m.*")


def _silhouette_euclidean(df: DataFrame, vec: str, cluster: str, id_col: str, out: str, rows_per_block: int) -> DataFrame:
    id_type, cluster_type = df.schema[id_col].dataType, df.schema[cluster].dataType
    stats = df.groupBy(cluster).agg(F.count("*").cast("double").alias("_n"))
    # Packs are written once and met part by part in place; no pair of packs is shuffled. A part's packs stay in memory.
    size = df.agg(F.count("*").alias("n"), F.sum(F.size(vec) * 8 + 64).alias("bytes")).first()
    parts = max(math.ceil(2 * math.sqrt(df.sparkSession.sparkContext.defaultParallelism)), math.ceil((size["bytes"] or 0) / PART_BYTES))
    blocks = F.lit(max(parts, math.ceil(size["n"] / max(rows_per_block, PACK_ROWS))))
    packed = write_once(
        df.withColumn("_block", F.pmod(F.xxhash64(id_col), blocks)).repartition(parts, "_block").groupBy("_block").agg(
            F.collect_list(id_col).alias("ids"),
            F.collect_list(cluster).alias("labels"),
            F.flatten(F.collect_list(F.col(vec).cast("array<double>"))).alias("xs"),
        ),
        "silhouette-blocks",
    )
    right = packed.select(F.col("ids").alias("o_ids"), F.col("labels").alias("o_labels"), F.col("xs").alias("o_xs"))
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField(cluster, cluster_type),
            T.StructField("_other", cluster_type),
            T.StructField("_sum", T.DoubleType()),
        ]
    )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A pack meets all packs of a part one after the other, so its sums are kept until the next pack comes.
        mark, ids, labels, totals = None, None, None, {}

        def rows() -> Iterator[pd.DataFrame]:
            for label, total in totals.items():
                yield pd.DataFrame({id_col: ids, cluster: labels, "_other": label, "_sum": total})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.block_no != mark:
                    yield from rows()
                    mark, ids, labels, totals = row.block_no, np.asarray(row.ids), np.asarray(row.labels), {}
                    x = np.array(row.xs, dtype="float64").reshape(len(ids), -1)
                    lengths = (x**2).sum(1)
                order = np.argsort(np.asarray(row.o_labels), kind="stable")
                o_labels, o_ids = np.asarray(row.o_labels)[order], np.asarray(row.o_ids)[order]
                y = np.asarray(row.o_xs, dtype="float64").reshape(len(o_labels), -1)[order]
                same = bool(np.isin(ids, o_ids).any())
                found, starts = np.unique(o_labels, return_index=True)
                for at in range(0, len(ids), rows_per_block):
                    some = slice(at, at + rows_per_block)
                    dist = x[some] @ y.T
                    dist *= -2.0
                    dist += lengths[some, None]
                    dist += (y**2).sum(1)
                    np.sqrt(np.maximum(dist, 0.0, out=dist), out=dist)
                    if same:
                        dist[ids[some, None] == o_ids[None, :]] = 0.0
                    for label, part in zip(found.tolist(), np.add.reduceat(dist, starts, axis=1).T):
                        totals.setdefault(label, np.zeros(len(ids)))[some] += part
        yield from rows()

    pairs = packed.withColumnRenamed("_block", "block_no").join(right.hint("shuffle_replicate_nl"), F.lit(True))
    partial = pairs.mapInPandas(sums, schema)
    per_label = partial.groupBy(id_col, cluster, "_other").agg(F.sum("_sum").alias("_sum"))
    sized = per_label.join(stats.withColumnRenamed(cluster, "_other"), "_other")
    own = F.col("_other") == F.col(cluster)
    best = sized.groupBy(id_col).agg(
        F.min(F.when(~own, F.col("_sum") / F.col("_n"))).alias("_b"),
        F.max(F.when(own, F.col("_sum"))).alias("_own"),
        F.max(F.when(own, F.col("_n"))).alias("_n"),
    )
    value = _silhouette(F.col("_own"), F.col("_n"), F.col("_b"))
    scored = best.select(id_col, F.when(_silhouette_allowed(stats, cluster), value).alias(out))
    return df.join(scored, id_col)


# -- diverse selection -----------------------------------------------------------------------


def diverse_top(
    df: DataFrame,
    n: int = 5,
    threshold: float = 0.95,
    vec: str = "embedding",
    cluster: str = "cluster",
    id_col: str = "article_id",
    run: Sequence[str] = (),
) -> DataFrame:
    """At most ``n`` articles per cluster, closest to the centroid first, none more
    similar to an earlier pick than ``threshold``.

    One round per pick for all clusters together: the best candidate per cluster
    is a map-side-combined maximum, then candidates too close to it drop out.
    When all cosines of a cluster exceed 0.9 only its first article is taken.
    """
    keys = [*run, cluster]
    quiet = df.where(F.col(cluster) != NOISE)
    # What there is one of for each cluster is written, so that its size is known and the rows stay where they are.
    near = quiet.join(write_once(centroid(quiet, vec, keys), "centroids"), keys).withColumn(
        "_near", F.round(cosine_rows(F.col(vec), F.col("centroid")), 9)
    )
    left = near.select(*keys, id_col, unit_rows(F.col(vec).cast("array<double>")).alias("_u"), "_near")
    picks: list[DataFrame] = []
    for number in range(1, n + 1):
        best = left.groupBy(*keys).agg(
            F.max_by(F.struct(id_col, "_u"), F.struct("_near", -F.col(id_col))).alias("_p")
        )
        best = write_once(best.select(*keys, F.col(f"_p.{id_col}").alias("_pid"), F.col("_p._u").alias("_pu")), "picks")
        picks.append(best.select(*keys, F.lit(number).alias("rank"), F.col("_pid").alias(id_col)))
        if number == n or best.isEmpty():
            break
        left = (
            left.join(best, keys)
            .where((F.col(id_col) != F.col("_pid")) & (dot_rows(F.col("_u"), F.col("_pu")) <= F.lit(threshold)))
            .drop("_pid", "_pu")
        )
    chosen = picks[0]
    for more in picks[1:]:
        chosen = chosen.unionByName(more)
    alike = all_alike(quiet, vec, keys, id_col)
    first = quiet.join(alike, keys, "left_semi").groupBy(*keys).agg(F.min(id_col).alias(id_col))
    return chosen.join(alike, keys, "left_anti").unionByName(
        first.select(*keys, F.lit(1).alias("rank"), id_col)
    )


# Fixed value: a cluster whose cosines all exceed this is one story.
ALIKE = 0.9


def all_alike(df: DataFrame, vec: str, keys: Sequence[str], id_col: str) -> DataFrame:
    """Clusters in which every pair of articles has a cosine above 0.9.

    A cheap necessary test goes first: against any one article all others must
    exceed 0.9. When all even exceed cos(arccos(0.9) / 2) no pair can fail;
    the few clusters in between are settled by comparing distinct vectors.
    """
    keys = list(keys)
    units = df.select(*keys, id_col, unit_rows(F.col(vec).cast("array<double>")).alias("_u"))
    pivot = write_once(units.groupBy(*keys).agg(F.min_by("_u", id_col).alias("_p")), "pivots")
    nearness = units.join(pivot, keys).select(*keys, dot_rows(F.col("_u"), F.col("_p")).alias("_low"))
    lowest = write_once(nearness.groupBy(*keys).agg(F.min("_low").alias("_low")), "lowest")
    sure = math.cos(math.acos(ALIKE) / 2.0)
    certain = lowest.where(F.col("_low") > sure).select(*keys)
    open_keys = lowest.where((F.col("_low") > ALIKE) & (F.col("_low") <= sure)).select(*keys)
    return certain.unionByName(_pairwise_alike(units, open_keys, keys, id_col))


def _pairwise_alike(units: DataFrame, open_keys: DataFrame, keys: list[str], id_col: str, rows_per_block: int = 1024) -> DataFrame:
    """Exact test of the undecided clusters, block pair by block pair."""
    schema = T.StructType([*[units.schema[c] for c in keys], T.StructField("_low", T.DoubleType())])
    rows = units.join(open_keys, keys, "left_semi").groupBy(*keys, "_u").agg(F.min(id_col).alias(id_col))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(rows_per_block)).alias("_b"))
    blocks = (
        rows.join(sizes, keys).withColumn("_block", F.pmod(F.xxhash64(id_col), F.col("_b")))
        .groupBy(*keys, "_block").agg(F.size(F.collect_list("_u")).alias("m"), F.flatten(F.collect_list("_u")).alias("xs"))
    )
    blocks = write_once(blocks, "alike-blocks")
    # The pairs of blocks are listed first and then fetch both sides, so a hot cluster's pairs are keyed by block.
    numbers = sizes.select(*keys, "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("_block"))
    listed = numbers.select(*keys, "_block", F.explode(F.sequence(F.col("_block"), F.col("_b") - 1)).alias("_other"))
    other = blocks.select(*keys, F.col("_block").alias("_other"), F.col("m").alias("o_m"), F.col("xs").alias("o_xs"))
    pairs = listed.join(blocks, [*keys, "_block"]).join(other, [*keys, "_other"])

    def lows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                x = np.asarray(row.xs).reshape(row.m, -1)
                y = np.asarray(row.o_xs).reshape(row.o_m, -1)
                found.append(float((x @ y.T).min()))
            yield batch[keys].assign(_low=found)

    lowest = pairs.select(*keys, "m", "xs", "o_m", "o_xs").mapInPandas(lows, schema)
    return lowest.groupBy(*keys).agg(F.min("_low").alias("_low")).where(F.col("_low") > ALIKE).select(*keys)
