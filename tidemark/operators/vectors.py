"""Embedding, nearest neighbours and tf-idf."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.mentions import distinct_names
from tidemark.functions.vectors import MISSING_MARK, as_vector, cosine, missing_to_null
from tidemark.operators.metric_index import merge_best, nearest_by_rings
from tidemark.operators.model_map import map_with_model
from tidemark.operators.ordering import top_per_key
from tidemark.session import cut_lineage, write_once

# Slots of the default text vector.
DIM = 256
# Fixed value: a term is two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"
# Largest side of a neighbour search that is sent to every task.
BROADCAST_BYTES = 64 * 1024 * 1024
# A term is hot when it is in more than this share (one part in so many) of all rows.
HOT_SHARE = 100
# Hot terms that are sent to the rows of many runs, the most frequent first; all others are joined.
HOT_TERMS = 100_000
# Tasks whose results for a query are merged at once.
MERGE_TASKS = 64
# Largest distance matrix a task holds at a time.
MATRIX_CELLS = 500_000


# -- text to vector --------------------------------------------------------------------------


def terms(c: Column | str) -> Column:
    """Lower-cased terms of a text, in order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def _slot_counts(dim: int):
    """Arrow function: the counts of terms in ``dim`` slots of each list of terms; every distinct term is hashed once a batch."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def counts(listed: pa.Array) -> pa.Array:
        words = listed.flatten().dictionary_encode()
        slots = np.array([int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dim for w in words.dictionary.to_pylist()], np.int64)
        sizes = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(listed)), sizes)
        table = np.zeros((len(listed), dim))
        if len(rows):
            np.add.at(table, (rows, slots[words.indices.to_numpy(zero_copy_only=False)]), 1.0)
        lengths = np.sqrt((table * table).sum(axis=1, keepdims=True))
        table /= np.where(lengths > 0, lengths, 1.0)
        return pa.ListArray.from_arrays(np.arange(0, table.size + 1, dim, dtype=np.int32), pa.array(table.ravel()), mask=listed.is_null())

    return counts


def hashed_vectors(df: DataFrame, text_col: str, out: str = "embedding", dim: int = DIM) -> DataFrame:
    """Add the default vector: term counts in ``dim`` slots, length one.

    A term's slot is the number in the first seven hexadecimal digits of its MD5, modulo ``dim``, which other
    engines can compute as well. Terms are cut by Spark, counted in Arrow batches; nothing is shuffled. A text without
    terms gets the zero vector, NULL text gets NULL.
    """
    return df.withColumn(out, _slot_counts(dim)(terms(text_col)))


def text_vector(spark: SparkSession, text: str, dim: int = DIM) -> list[float]:
    """Default vector of one literal text, such as a query or an anchor."""
    one = spark.range(1).select(F.lit(text).alias("text"))
    return hashed_vectors(one, "text", dim=dim).first()["embedding"]


def embed(
    df: DataFrame,
    text_col: str,
    model: Callable[[list[str]], list] | None = None,
    out: str = "embedding",
    dim: int = DIM,
    **model_options,
) -> DataFrame:
    """Add a vector per row: the hashed default, or a user model applied in batches."""
    if model is None:
        return hashed_vectors(df, text_col, out, dim)
    return map_with_model(df, text_col, out, model, result_type=T.ArrayType(T.DoubleType()), **model_options)


def embed_with_fallback(
    df: DataFrame, text_col: str, first: Callable, second: Callable | None = None, out: str = "embedding", **options
) -> DataFrame:
    """Vectors of the first model; when any row got none, all rows use the second.

    The first result is checkpointed, so the model is asked once per row.
    """
    tried = cut_lineage(embed(df, text_col, first, out, **options))
    if tried.where(F.col(out).isNull()).isEmpty():
        return tried
    return embed(df, text_col, second, out, **options)


def backfill_vectors(df: DataFrame, text_col: str, vec: str = "summary_embedding", dim: int = DIM) -> DataFrame:
    """Compute vectors only for rows still carrying the "not embedded" mark."""
    marked = df.withColumn(vec, missing_to_null(vec))
    todo = F.when(F.col(vec).isNull(), F.col(text_col))
    filled = hashed_vectors(marked.withColumn("_todo", todo), "_todo", "_fresh", dim)
    return filled.withColumn(vec, F.coalesce(vec, "_fresh")).select(*df.columns)


def needs_vector(df: DataFrame, vec: str = "summary_embedding") -> DataFrame:
    """Rows whose vector is the mark."""
    return df.where(F.get(F.col(vec), F.lit(0)) == F.lit(MISSING_MARK))


# The anchor text and the similarity above which an event is dropped.
ANCHOR_TEXT = "Irrelevant Article"
ANCHOR_THRESHOLD = 0.8


def flag_irrelevant(
    df: DataFrame,
    vec: str = "summary_embedding",
    anchor: Sequence[float] | None = None,
    threshold: float = ANCHOR_THRESHOLD,
    out: str = "irrelevant",
) -> DataFrame:
    """True where the summary lies closer to the anchor than the threshold."""
    if anchor is None:
        dim = df.select(F.size(vec).alias("d")).where("d > 0").first()
        anchor = text_vector(df.sparkSession, ANCHOR_TEXT, dim["d"] if dim else DIM)
    return df.withColumn(out, cosine(F.col(vec), as_vector(anchor)) > F.lit(threshold))


# -- nearest neighbours ----------------------------------------------------------------------


def _distances(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Query x corpus distances, rounded so that equal vectors tie exactly."""
    products = queries @ corpus.T
    if metric == "cosine":
        lengths = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(corpus, axis=1)[None, :]
        safe = np.where(lengths > 0, lengths, 1.0)
        return np.round(1.0 - np.where(lengths > 0, products / safe, 0.0), 9)
    squares = (queries**2).sum(axis=1)[:, None] + (corpus**2).sum(axis=1)[None, :]
    return np.round(np.maximum(squares - 2.0 * products, 0.0), 9)


def _best_of_block(
    qid: np.ndarray, qvec: np.ndarray, cid: np.ndarray, cvec: np.ndarray, k: int, metric: str, exclude_self: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest corpus rows of one block per query."""
    dist = _distances(qvec, cvec, metric)
    if exclude_self:
        dist[qid[:, None] == cid[None, :]] = np.inf
    if dist.shape[1] > k:
        # Only rows up to the k-th distance are sorted; equal ones go by id.
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1]
        query, place = np.nonzero(dist <= np.where(np.isnan(kth), np.inf, kth)[:, None])
    else:
        query, place = (a.ravel() for a in np.indices(dist.shape))
    order = np.lexsort((cid[place], dist[query, place], query))
    query, place = query[order], place[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    query, place, rank = query[rank < k], place[rank < k], rank[rank < k]
    best = np.full((len(qid), min(k, len(cid))), np.inf), np.full((len(qid), min(k, len(cid))), cid[0] if len(cid) else 0, cid.dtype)
    best[0][query, rank], best[1][query, rank] = dist[query, place], cid[place]
    return best


def _as_rows(qid: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    dist, ids = best
    frame = pd.DataFrame(
        {"query_id": np.repeat(qid, dist.shape[1]), "neighbour_id": ids.ravel(), "distance": dist.ravel()}
    )
    return frame[np.isfinite(frame["distance"])]


def _slices(n: int, other: int) -> Iterator[slice]:
    """Ranges of ``n`` rows whose distance matrix against ``other`` rows stays small."""
    rows = max(1, MATRIX_CELLS // max(other, 1))
    return (slice(start, start + rows) for start in range(0, n, rows))


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    where: Sequence[str] = (),
    metric: str = "l2",
    query_id: str = "query_id",
    corpus_id: str = "doc_id",
    vec: str = "embedding",
    exclude_self: bool = False,
    block_rows: int = 1024,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest corpus rows per query among rows equal on ``where``.

    Output (query_id, neighbour_id, distance, rank). Each task keeps only its k
    best per query; no query-corpus pair is ever a row. Whichever side stays
    below ``broadcast_bytes`` (queries are tried first) travels to the tasks and
    the other side is read in place, without a shuffle. When both are larger, packs of
    queries read only the distance rings that can hold a neighbour (``metric_index``). ``l2`` is the squared distance.
    """
    q_type = queries.schema[query_id].dataType
    c_type = corpus.schema[corpus_id].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", q_type),
            T.StructField("neighbour_id", c_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    vector = F.col(vec).cast("array<double>")
    key = F.to_json(F.struct(*where)) if where else F.lit("")
    queries = queries.where(F.col(vec).isNotNull()).dropna(subset=list(where)) if where else queries.where(F.col(vec).isNotNull())
    q = queries.select(F.col(query_id).alias("qid"), key.alias("key"), vector.alias("qvec"))
    c = corpus.where(F.col(vec).isNotNull()).select(F.col(corpus_id).alias("cid"), key.alias("key"), vector.alias("cvec"))
    if _bytes(q, "qvec") <= broadcast_bytes:
        partial = _knn_queries_sent(q, c, schema, k, metric, exclude_self)
    elif _bytes(c, "cvec") <= broadcast_bytes:
        partial = _knn_corpus_sent(q, c, schema, k, metric, exclude_self)
    else:
        partial = nearest_by_rings(q, c, k, metric, exclude_self, block_rows, _best_of_block)
    return merged_best(partial, k)


def fits_in_tasks(corpus: DataFrame, where: Sequence[str], corpus_id: str, vec: str, carried: str, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a side with unique ids is small enough for ``knn_lists``, with its ``carried`` texts."""
    size = F.size(vec) * 8 + F.coalesce(F.length(carried), F.lit(0)) * 4 + F.length(F.to_json(F.struct(*where))) + 64
    state = corpus.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), (F.count("*") == F.count_distinct(corpus_id)).alias("unique")).first()
    return state["unique"] and state["bytes"] <= broadcast_bytes


def knn_lists(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    where: Sequence[str],
    metric: str,
    corpus_id: str,
    query_vec: str,
    corpus_vec: str,
    carried: str,
    out: str,
) -> DataFrame:
    """The queries with the ``carried`` texts of their ``knn`` as one array, nearest first, in place of ``query_vec``.

    Nothing of the queries is shuffled and no neighbour is a row. For a corpus that ``fits_in_tasks``; the array is empty
    where ``knn`` has no row.
    """
    known = corpus.where(F.col(corpus_vec).isNotNull()).dropna(subset=[*where, corpus_id])
    key = F.to_json(F.struct(*where))
    sides = _by_key(known.select(F.col(corpus_id).alias("cid"), key.alias("key"), F.col(corpus_vec).cast("array<double>").alias("cvec")), "cid", "cvec")
    # Numbers in id order stand for the ids, so ties go the same way.
    placed = {name: (np.arange(len(ids)), rows[np.argsort(ids, kind="stable")]) for name, (ids, rows) in sides.items()}
    shared = queries.sparkSession.sparkContext.broadcast(placed)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def nearest(keys: pa.Array, vecs: pa.Array) -> pa.Array:
        found = np.full((len(keys), k), -1, np.int32)
        known = pd.DataFrame({"key": keys.to_pandas(), "usable": vecs.is_valid().to_numpy(zero_copy_only=False)})
        for name, group in known[known["usable"]].groupby("key", sort=False):
            if name not in shared.value:
                continue
            cid, cvec = shared.value[name]
            rows = group.index.to_numpy()
            qvec = np.stack(vecs.take(pa.array(rows)).to_numpy(zero_copy_only=False)).astype("float64")
            for part in _slices(len(rows), len(cid)):
                dist, ids = _best_of_block(rows[part], qvec[part], cid, cvec, k, metric, False)
                found[rows[part], : dist.shape[1]] = np.where(np.isfinite(dist), ids, -1)
        kept = found >= 0
        ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(found[kept]))

    numbered = queries.withColumn("_near", nearest(F.when(F.concat(*[F.col(c).cast("string") for c in where]).isNotNull(), key), F.col(query_vec).cast("array<double>")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(corpus_id, carried))), lambda c: c[carried])
    lists = known.groupBy(*where).agg(ordered.alias("_carried"))
    texts = F.transform("_near", lambda i: F.get("_carried", i))
    return numbered.drop(query_vec).join(F.broadcast(lists), list(where), "left").withColumn(out, texts).drop("_near", "_carried")


def merged_best(partial: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, neighbour_id, distance) of each query, merged level by level.

    Every task cuts to k rows a query before it shuffles. With more tasks than ``MERGE_TASKS``, the results of as many
    are merged first, so that the last level reads k rows a query from each group instead of from each task.
    """
    order = [F.asc("distance"), F.asc("neighbour_id")]
    if int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions")) > MERGE_TASKS:
        grouped = partial.withColumn("_group", F.floor(F.spark_partition_id() / F.lit(MERGE_TASKS)))
        partial = top_per_key(grouped, ["query_id", "_group"], order, k).drop("_group", "rank")
    return top_per_key(partial, ["query_id"], order, k)


def _bytes(df: DataFrame, vec: str) -> int:
    """Upper estimate of the size of one side in memory."""
    return df.agg(F.sum(F.size(vec) * 8 + F.length("key") + 64).alias("b")).first()["b"] or 0


def _by_key(df: DataFrame, ident: str, vec: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix per key of a side whose size was checked against the bound."""
    return {
        name: (group[ident].to_numpy(), np.stack(group[vec].to_numpy()).astype("float64"))
        for name, group in df.toPandas().groupby("key", sort=False)
    }


def _knn_queries_sent(q: DataFrame, c: DataFrame, schema: T.StructType, k: int, metric: str, exclude_self: bool) -> DataFrame:
    shared = q.sparkSession.sparkContext.broadcast(_by_key(q, "qid", "qvec"))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One running result per task, so a task returns at most k rows per query.
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, group in batch.groupby("key", sort=False):
                if name not in shared.value:
                    continue
                qid, qvec = shared.value[name]
                for rows in _slices(len(group), len(qid)):
                    part = group.iloc[rows]
                    cvec = np.stack(part["cvec"].to_numpy()).astype("float64")
                    found = _best_of_block(qid, qvec, part["cid"].to_numpy(), cvec, k, metric, exclude_self)
                    best[name] = merge_best(best.get(name), found, k)
        for name, found in best.items():
            yield _as_rows(shared.value[name][0], found)

    return c.mapInPandas(nearest, schema)


def _knn_corpus_sent(q: DataFrame, c: DataFrame, schema: T.StructType, k: int, metric: str, exclude_self: bool) -> DataFrame:
    shared = c.sparkSession.sparkContext.broadcast(_by_key(c, "cid", "cvec"))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("key", sort=False):
                if name not in shared.value:
                    continue
                cid, cvec = shared.value[name]
                for rows in _slices(len(group), len(cid)):
                    part = group.iloc[rows]
                    qvec = np.stack(part["qvec"].to_numpy()).astype("float64")
                    qid = part["qid"].to_numpy()
                    yield _as_rows(qid, _best_of_block(qid, qvec, cid, cvec, k, metric, exclude_self))

    return q.mapInPandas(nearest, schema)


# -- tf-idf ----------------------------------------------------------------------------------


def tfidf(
    df: DataFrame, columns: dict[str, str], id_col: str = "article_id", run: Sequence[str] = (), slots: int | None = None
) -> DataFrame:
    """Long-form weights (run, id, kind, term, weight) of the entity columns.

    Smoothed idf ``ln((1+n)/(1+df))+1`` and rows of length one per column. The
    text of a column is its distinct names joined by blanks. With ``run`` columns
    a run's rows are counted alone. With ``slots`` there is one row (run, id, parts) for each id with any term, from which
    ``slot_vectors`` adds up the weights in so many slots; few terms are rows on the way.
    """
    run = list(run)
    texts = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), terms(distinct_names(column, kind, " ")).alias("terms"))
            for kind, column in columns.items()
        ]
    )
    # A row's terms are counted inside the row; they are read twice, so they are written once.
    counts = F.transform(F.array_distinct("_x.terms"), lambda t: F.struct(
        t.alias("term"), (F.size("_x.terms") - F.size(F.array_remove("_x.terms", t))).cast("double").alias("tf")
    ))
    listed = df.select(*run, id_col, F.explode(texts).alias("_x"))
    rows = write_once(listed.select(*run, id_col, F.col("_x.kind").alias("kind"), counts.alias("counts")), "tf")
    n_docs = rows.groupBy(*run).agg((F.count("*") / F.lit(len(columns))).alias("n"))
    terms_of = rows.select(*run, "kind", F.explode("counts.term").alias("term")).groupBy(*run, "kind", "term").agg(F.count("*").alias("df"))
    counted = terms_of.join(n_docs, run) if run else terms_of.withColumn("n", n_docs.scalar())
    idf = write_once(
        counted.select(
            *run, "kind", "term", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"),
            (F.col("df") > F.col("n") / F.lit(HOT_SHARE)).alias("often"),
            *([] if slots is None else ["df", F.pmod(F.xxhash64("kind", "term"), F.lit(slots)).cast("int").alias("slot")]),
        ),
        "idf",
    )
    if slots is not None:
        return _folded(rows, idf, list(columns), id_col, run)
    each = rows.select(*run, id_col, "kind", F.explode("counts").alias("_c")).select(*run, id_col, "kind", "_c.term", "_c.tf")
    keys = [*run, "kind", "term"]
    if run:
        # Terms of many runs: a run's hot terms are split at run time by the join.
        weighted = each.join(idf, keys).select(*run, id_col, "kind", "term", (F.col("tf") * F.col("idf")).alias("w"))
    else:
        # Terms in more than a hundredth of the rows: at most a hundred times the terms of an average row, however many
        # rows there are. They are sent to the rows; all others are joined.
        hot = F.broadcast(idf.where("often").select("kind", "term", F.col("idf").alias("hot")))
        marked = each.join(hot, keys, "left")
        often = marked.where(F.col("hot").isNotNull()).select(id_col, "kind", "term", (F.col("tf") * F.col("hot")).alias("w"))
        seldom = marked.where(F.col("hot").isNull()).join(idf.where("NOT often"), keys)
        weighted = often.unionByName(seldom.select(id_col, "kind", "term", (F.col("tf") * F.col("idf")).alias("w")))
    # A row's weights are at most its terms.
    per_row = weighted.groupBy(*run, id_col, "kind").agg(
        F.collect_list(F.struct("term", "w")).alias("_w"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len")
    )
    return per_row.select(*run, id_col, "kind", F.explode("_w").alias("_t"), "len").select(
        *run, id_col, "kind", F.col("_t.term").alias("term"), (F.col("_t.w") / F.col("len")).alias("weight")
    )


def _folded(rows: DataFrame, idf: DataFrame, kinds: list[str], id_col: str, run: list[str]) -> DataFrame:
    """(run, id, parts) of the counted ``rows``: a part has a kind's sum of squares, slots and weights.

    The weights of hot terms are made inside the row, from a list of bounded size; only the other terms are rows and joined.
    """
    group = F.to_json(F.struct(*run, "kind"))
    hot = idf.where("often").orderBy(F.desc("df"), *run, "kind", "term").limit(HOT_TERMS).select(group.alias("g"), "term", "idf", "slot").collect()
    groups, words = sorted({r["g"] for r in hot}), sorted({r["term"] for r in hot})
    number, place = {g: i for i, g in enumerate(groups)}, {w: i for i, w in enumerate(words)}
    # One number for a group and a word, in order.
    codes = np.array([number[r["g"]] * len(words) + place[r["term"]] for r in hot], np.int64)
    order = np.argsort(codes)
    known = codes[order], np.array([r["idf"] for r in hot])[order], np.array([r["slot"] for r in hot], np.int32)[order]
    shared = rows.sparkSession.sparkContext.broadcast((groups, words, known))

    def found(of: pa.Array, counts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Of each counted term: its row, the term, how often it is there, and its place among the hot terms or -1."""
        groups, words, (codes, _, _) = shared.value
        each = counts.flatten()
        terms, tf = each.field("term"), each.field("tf").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(counts)), counts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        if not len(codes) or not len(row):
            return row, terms, tf, np.full(len(row), -1)
        mine = pc.index_in(of, pa.array(groups, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[row]
        word = pc.index_in(terms, pa.array(words, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        wanted = np.where((mine < 0) | (word < 0), -1, mine * len(words) + word)
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        return row, terms, tf, np.where(codes[at] == wanted, at, -1)

    def listed(rows_of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(rows_of, minlength=n))]).astype(np.int32), values)

    part = T.StructType([T.StructField("sq", T.DoubleType()), T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("ws", T.ArrayType(T.DoubleType()))])

    @F.arrow_udf(part)
    def inside(of: pa.Array, counts: pa.Array) -> pa.Array:
        row, _, tf, at = found(of, counts)
        row, tf, at = row[at >= 0], tf[at >= 0], at[at >= 0]
        _, _, (_, weight, slot) = shared.value
        w = tf * weight[at]
        sums = pa.array(np.bincount(row, w * w, len(counts)))
        return pa.StructArray.from_arrays([sums, listed(row, len(counts), pa.array(slot[at])), listed(row, len(counts), pa.array(w))], ["sq", "slots", "ws"])

    seldom = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.DoubleType())]))

    @F.arrow_udf(seldom)
    def outside(of: pa.Array, counts: pa.Array) -> pa.Array:
        row, terms, tf, at = found(of, counts)
        kept = at < 0
        left = pa.StructArray.from_arrays([terms.filter(pa.array(kept)), pa.array(tf[kept])], ["term", "tf"])
        return listed(row[kept], len(counts), left)

    kind = F.array_position(F.lit(kinds), F.col("kind")).cast("byte").alias("kind")
    counted = rows.where(F.size("counts") > 0)
    often = counted.select(*run, id_col, kind, inside(group, F.col("counts")).alias("_p")).where(F.size("_p.slots") > 0).select(*run, id_col, "kind", "_p.*")
    each = counted.select(*run, id_col, "kind", F.explode(outside(group, F.col("counts"))).alias("_c")).select(*run, id_col, "kind", "_c.*")
    w = F.col("tf") * F.col("idf")
    others = each.join(idf.select(*run, "kind", "term", "idf", "slot"), [*run, "kind", "term"]).select(
        *run, id_col, kind, (w * w).alias("sq"), F.array("slot").alias("slots"), F.array(w).alias("ws")
    )
    # An id has at most the parts of its terms.
    return often.unionByName(others).groupBy(*run, id_col).agg(F.collect_list(F.struct("kind", "sq", "slots", "ws")).alias("parts"))


def slot_vectors(parts: Column | str, dim: int) -> Column:
    """The vector of the ``parts`` that ``tfidf`` gives with ``slots=dim``: weights over the length of their kind, added up by slot."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def dense(listed: pa.Array) -> pa.Array:
        each = listed.flatten()
        row = np.repeat(np.arange(len(listed)), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        of = row * 128 + each.field("kind").to_numpy(zero_copy_only=False)
        lengths = np.sqrt(np.bincount(of, each.field("sq").to_numpy(zero_copy_only=False), len(listed) * 128))
        size = each.field("slots").value_lengths().to_numpy(zero_copy_only=False)
        weights = each.field("ws").flatten().to_numpy(zero_copy_only=False) / np.repeat(lengths[of], size)
        place = np.repeat(row, size) * dim + each.field("slots").flatten().to_numpy(zero_copy_only=False)
        table = np.bincount(place, weights, len(listed) * dim)
        return pa.ListArray.from_arrays(np.arange(0, len(table) + 1, dim, dtype=np.int32), pa.array(table), mask=listed.is_null())

    return dense(F.col(parts) if isinstance(parts, str) else parts)
