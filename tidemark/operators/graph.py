"""Company-entity graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_graph(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, type) and undirected edges (src, dst, description).

    ``relations`` has one row per company with ``seq``, ``stock`` and a map
    ``entities`` of entity to description. Later writes win: the entry of a
    company comes before its entities, companies follow ``seq``.
    """
    listed = relations.select("seq", "stock", F.posexplode_outer("entities").alias("pos", "entity", "description"))
    order = F.struct("seq", (F.coalesce("pos", F.lit(-1)) + 1).alias("pos"))
    links = listed.where(F.col("entity").isNotNull())
    edges = links.groupBy(
        F.least("stock", "entity").alias("src"), F.greatest("stock", "entity").alias("dst")
    ).agg(F.max_by("description", order).alias("description"))
    stocks = relations.select(F.col("stock").alias("node"), F.lit("stock").alias("type"), F.struct("seq", F.lit(0).alias("pos")).alias("at"))
    entities = links.select(F.col("entity").alias("node"), F.lit("entity").alias("type"), order.alias("at"))
    nodes = stocks.unionByName(entities).groupBy("node").agg(F.max_by("type", "at").alias("type"))
    return nodes, edges


def degree_centrality(nodes: DataFrame, edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Degree over (nodes - 1); nodes at or above the threshold. A self-loop counts twice."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    others = nodes.agg(F.count("*") - 1).scalar()
    scored = nodes.join(degree, "node", "left").select(
        "node", "type", F.coalesce("degree", F.lit(0).cast("long")).alias("degree")
    ).withColumn(
        "centrality", F.when(others <= 0, F.lit(1.0)).otherwise(F.col("degree") / others)
    )
    return scored.where(F.col("centrality") >= F.lit(threshold))
