"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colweave.plans import catalog  # noqa: E402
from colweave.session import build_session  # noqa: E402

HEADLINES = [
    "line_graph_summary", "standard_scaling", "pearson_matrix", "pearson_matrix_wide", "gram_matrix_wide",
    "cosine_matrix", "correlation_graph", "top_k_graph", "weighted_graph", "adjacency_matrix",
    "column_profile_orders", "duplicate_row_counts", "duplicate_columns", "iqr_outlier_counts_lines",
    "zscore_outlier_counts_lines", "column_roles", "timestamp_search", "row_dedupe", "sparse_columns",
    "redundant_columns", "fill_both_ways", "time_interpolation", "impute_median_mode", "knn_imputation",
    "outliers_iqr_clip", "outliers_z_score_winsorize", "isolation_forest_treatment", "graph_metrics_correlation",
    "graph_metrics_top_k", "betweenness_centrality_top_k", "eigenvector_centrality_correlation",
    "pagerank_centrality_top_k", "attention_model_top_k", "mean_model_correlation", "station_reports",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executors and the Python workers before the clock.
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(8).repartition(8).mapInPandas(lambda parts: parts, "id long").count()
    catalog.QUERIES["line_graph_summary"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
