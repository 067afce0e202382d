"""Graphs whose nodes are columns: builders, adjacency tables and edge features.

Node table:  ``(station, graph_type, node, idx)`` - every feature, also isolated ones.
Edge table:  ``(station, graph_type, source, target, weight, directed)`` -
undirected edges once, with the lower column index as source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAPH_TYPES = ("correlation", "top_k", "weighted", "learnable")
GRAPH_KEYS = ["station", "graph_type"]
# Weights closer to zero than this are no edge in a saved adjacency matrix.
ZERO_TOLERANCE = 1e-12
MIN_SIMILARITY = 1e-6
WEAK_EDGE = 0.05


def _edges(pairs: DataFrame, graph_type: str, weight: Column, directed: bool) -> DataFrame:
    return pairs.select("station", F.lit(graph_type).alias("graph_type"), "source", "target",
                        weight.alias("weight"), F.lit(directed).alias("directed"))


def feature_nodes(stations: DataFrame, cols: list[str], graph_types=GRAPH_TYPES) -> DataFrame:
    """Every feature of every station as a node of every graph type."""
    names = F.array(*[F.struct(F.lit(c).alias("node"), F.lit(i).alias("idx")) for i, c in enumerate(cols)])
    types = F.array(*[F.lit(t) for t in graph_types])
    return (stations.select("station").distinct()
            .select("station", F.explode(types).alias("graph_type"))
            .select("station", "graph_type", F.inline(names)))


def correlation_graph(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Undirected edges where ``|r|`` is strictly above the threshold."""
    return _edges(pairs.where(F.abs("r") > threshold), "correlation", F.col("r"), False)


def weighted_graph(pairs: DataFrame) -> DataFrame:
    """Undirected edges for every non-zero similarity."""
    return _edges(pairs.where("r <> 0"), "weighted", F.col("r"), False)


def both_directions(pairs: DataFrame) -> DataFrame:
    """Each unordered pair as two ordered ones, without a join."""
    def side(i, j, a, b):
        return F.struct(F.col(i).alias("i"), F.col(j).alias("j"),
                        F.col(a).alias("source"), F.col(b).alias("target"), F.col("r").alias("r"))
    return pairs.select("station", F.inline(F.array(
        side("i", "j", "source", "target"), side("j", "i", "target", "source"))))


def top_k_graph(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Directed edges from each node to its k most similar others.

    Equal similarities go to the higher column index.  A node never selects
    itself, and similarities within 1e-6 of zero are dropped after ranking.
    """
    rank = Window.partitionBy("station", "source").orderBy(F.abs("r").desc(), F.col("j").desc())
    ranked = both_directions(pairs).withColumn("rank", F.row_number().over(rank))
    best = ranked.where((F.col("rank") <= k) & (F.abs("r") > MIN_SIMILARITY))
    return _edges(best, "top_k", F.col("r"), True)


def cut_weak_edges(edges: DataFrame, limit: float = WEAK_EDGE) -> DataFrame:
    return edges.where(F.abs("weight") >= limit)


def endpoints(edges: DataFrame) -> DataFrame:
    """Both ordered forms of undirected edges; directed edges once."""
    keep = F.struct("source", "target", "weight")
    flip = F.struct(F.col("target").alias("source"), F.col("source").alias("target"), F.col("weight"))
    sides = F.when(F.col("directed"), F.array(keep)).otherwise(F.array(keep, flip))
    return edges.select(*GRAPH_KEYS, "directed", F.inline(sides))


def adjacency_cells(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every cell of the adjacency matrix: ``(station,graph_type,source,target,weight)``.

    The dense matrix is the requested output, so its N x N cells come from an
    equi-join of a graph's nodes with themselves and missing edges are 0.
    """
    rows = nodes.select(*GRAPH_KEYS, F.col("node").alias("source"), F.col("idx").alias("source_idx"))
    columns = nodes.select(*GRAPH_KEYS, F.col("node").alias("target"), F.col("idx").alias("target_idx"))
    present = endpoints(edges).select(*GRAPH_KEYS, "source", "target", "weight")
    return (rows.join(columns, GRAPH_KEYS)
            .join(present, [*GRAPH_KEYS, "source", "target"], "left")
            .withColumn("weight", F.coalesce("weight", F.lit(0.0))))


def adjacency_matrix(nodes: DataFrame, edges: DataFrame, cols: list[str]) -> DataFrame:
    """One row per node with one weight column per node, from edges alone.

    A conditional sum per label needs no N x N intermediate.
    """
    cells = endpoints(edges)
    wide = cells.groupBy(*GRAPH_KEYS, "source").agg(
        *[F.sum(F.when(F.col("target") == c, F.col("weight"))).alias(c) for c in cols])
    return (nodes.withColumnRenamed("node", "source")
            .join(wide, [*GRAPH_KEYS, "source"], "left")
            .select(*GRAPH_KEYS, "source", "idx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols]))


def binarised(cells: DataFrame) -> DataFrame:
    return cells.withColumn("linked", (F.abs("weight") > 0).cast("double"))


def combine_undirected(cells: DataFrame) -> DataFrame:
    """Both directions of a saved matrix as one edge: mean of the non-zero ones.

    The order of the pair follows the label index, as the cells carry it.
    """
    first = F.col("source_idx") < F.col("target_idx")
    used = F.when(F.abs("weight") > ZERO_TOLERANCE, F.col("weight"))
    return (cells.where("source_idx <> target_idx")
            .select(*GRAPH_KEYS,
                    F.when(first, F.col("source")).otherwise(F.col("target")).alias("source"),
                    F.when(first, F.col("target")).otherwise(F.col("source")).alias("target"),
                    used.alias("used"))
            .groupBy(*GRAPH_KEYS, "source", "target").agg(F.avg("used").alias("weight"))
            .where("weight is not null")
            .withColumn("directed", F.lit(False)))


def graph_from_adjacency(cells: DataFrame) -> DataFrame:
    """Edges of saved matrices: ``top_k`` stays directed, all others are combined."""
    directed = (cells.where("graph_type = 'top_k'").where(F.abs("weight") > ZERO_TOLERANCE)
                .select(*GRAPH_KEYS, "source", "target", "weight", F.lit(True).alias("directed")))
    return directed.unionByName(combine_undirected(cells.where("graph_type <> 'top_k'")))


def edge_features(edges: DataFrame) -> DataFrame:
    return edges.withColumns({
        "abs_weight": F.abs("weight"),
        "sign": F.when(F.col("weight") >= 0, "positive").otherwise("negative"),
    })


# Similarity-based builders share one signature: (pairs, settings) -> edges.
BUILDERS = {
    "correlation": lambda pairs, cfg: correlation_graph(pairs, cfg.correlation_threshold),
    "top_k": lambda pairs, cfg: top_k_graph(pairs, cfg.top_k_neighbors),
    "weighted": lambda pairs, cfg: weighted_graph(pairs),
}
