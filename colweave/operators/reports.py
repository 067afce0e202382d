"""Summary tables per station and across stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.operators.graphs import GRAPH_TYPES
from colweave.operators.metrics import METRICS


def metric_table(metrics: DataFrame) -> DataFrame:
    """One row per station and metric, one column per graph type."""
    long = metrics.select("station", "graph_type", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot(
        ["station", "graph_type"], METRICS, "metric", "value")
    return long.groupBy("station", "metric").pivot("graph_type", list(GRAPH_TYPES)).agg(F.first("value"))


def density_table(metrics: DataFrame) -> DataFrame:
    """One row per station, the density of each graph type, 0 where there is none."""
    return (metrics.groupBy("station").pivot("graph_type", list(GRAPH_TYPES)).agg(F.first("density"))
            .fillna(0.0, list(GRAPH_TYPES)))


def distance_table(quality: DataFrame) -> DataFrame:
    """Mean pairwise distance per model, averaged over graph types, 0 where there is none."""
    gat = F.col("run").contains("GAT")
    mean = F.col("avg_pairwise_distance")
    return quality.groupBy("station").agg(
        F.coalesce(F.avg(F.when(gat, mean)), F.lit(0.0)).alias("gat_mean_distance"),
        F.coalesce(F.avg(F.when(~gat, mean)), F.lit(0.0)).alias("graphsage_mean_distance"))


def comparison_table(profiles: DataFrame, guard: DataFrame) -> DataFrame:
    """Rows, columns, bytes, nodes and embedding status of every station."""
    return profiles.join(guard, "station").select(
        "station", F.col("rows").alias("raw_rows"), F.col("cols").alias("raw_columns"),
        F.col("features").alias("nodes"), "bytes",
        F.when(F.col("embeddings_skipped"), "Skipped").otherwise("Success").alias("embedding_status"))


def _listed(df: DataFrame, name: str, *fields: str) -> DataFrame:
    """A station's rows as one sorted array of structs; rows are schema-sized, not data-sized."""
    return df.groupBy("station").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def station_report(audit: DataFrame, roles: DataFrame, drops: DataFrame, cleaning: DataFrame, outliers: DataFrame,
                   metrics: DataFrame, centralities: DataFrame, run_reports: DataFrame, quality: DataFrame,
                   guard: DataFrame) -> DataFrame:
    """Everything known about a station as one nested row."""
    central = centralities.groupBy("station", "graph_type").agg(F.sort_array(F.collect_list(F.struct(
        "node", "degree_centrality", "betweenness_centrality", "closeness_centrality", "eigenvector_centrality",
        "pagerank"))).alias("centralities"))
    graphs = metrics.join(central, ["station", "graph_type"], "left")
    skip = F.when(F.col("embeddings_skipped"), F.concat(
        F.lit("Feature graph has only "), F.col("features").cast("string"), F.lit(" nodes (minimum 3 required).")))
    joined = audit
    for part in (
        _listed(roles, "classifications", "idx", "column", "role"),
        _listed(drops, "dropped_columns", "column", "reason"),
        cleaning,
        _listed(outliers, "outliers_treated", "column", "outliers", "lower_bound", "upper_bound"),
        _listed(graphs, "graph_structures", "graph_type", *METRICS, "warnings", "centralities"),
        _listed(run_reports, "embedding_runs", "run", "graph_type", "model_name", "final_loss", "validation"),
        _listed(quality, "embeddings_analysis", "run", "node_count", "dimension", "avg_pairwise_distance",
                "std_pairwise_distance", "dimension_variance", "sparsity"),
        guard.select("station", "status", "warning", F.col("embeddings_skipped"), skip.alias("skip_reason")),
    ):
        joined = joined.join(part, "station", "left")
    return joined


def node_feature_table(nodes: DataFrame, stats: DataFrame, centralities: DataFrame) -> DataFrame:
    """Every node with its column statistics and centralities, NULL where unknown."""
    keys = ["station", "node"]
    return (nodes.select("station", "graph_type", "node", "idx")
            .join(stats, keys, "left")
            .join(centralities.select(*keys, "graph_type", "degree_centrality", "pagerank"),
                  [*keys, "graph_type"], "left"))
