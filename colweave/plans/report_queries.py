"""Queries for file inventories, saved matrices and the summary tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colweave.config import Settings
from colweave.functions.stats import rounded
from colweave.operators import centrality, clean, graphs, metrics, profile, quality, reports
from colweave.operators.quantiles import exact_percentiles
from colweave.plans import inputs, stations
from colweave.plans.graph_queries import CELLS_SQL, CORR_EDGES_SQL, DIRECTED_SQL, line_graph
from colweave.plans.inputs import EVENT_COLS, LINE_COLS, LINE_SQL
from colweave.plans.metric_queries import WEIGHTED_SQL, metrics_sql, pagerank_sql
from colweave.plans.registry import query
from colweave.session import materialise, shared_folder
from colweave.sources import artefacts, discovery
from colweave.sources.results import ResultStore, global_report

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


@query("file_inventory", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS file_name, (SELECT count(*) FROM {t}) AS rows, "
    f"(SELECT count(*) FROM (DESCRIBE {t})) AS cols" for t in TABLES))
def file_inventory(spark, sf_dir):
    """The inventory that loading a folder of stations gives: every file with its rows and columns."""
    return discovery.load_stations(spark, sf_dir).inventory.select(
        "file_name", F.col("rows").cast("long").alias("rows"), F.col("cols").cast("long").alias("cols"))


@query("schema_drift", "WITH f AS (" + " UNION ALL ".join(
    f"SELECT (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE {t})) AS sig, "
    f"(SELECT count(*) FROM {t}) AS n" for t in TABLES) + """)
SELECT 'root_station' AS station, 'Failed' AS status, 'The files of the station differ in their columns.' AS reason
FROM f WHERE n > 0 HAVING count(DISTINCT sig) > 1""")
def schema_drift(spark, sf_dir):
    """Files of one station with different columns fail that station."""
    return discovery.load_stations(spark, sf_dir).failures


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/colweave/{uuid.uuid4().hex}"


@query("csv_stations", """
SELECT o_orderstatus AS station, o_orderkey AS order_key, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
       'line 1' || chr(10) || 'he said "' || o_orderpriority || '", twice' AS note FROM orders""")
def csv_stations(spark, sf_dir):
    """Orders written as CSV files, one station per status, with quotes, line breaks and words for missing values."""
    orders = inputs.table(spark, sf_dir, "orders").select(
        "o_orderstatus", F.col("o_orderkey").alias("order_key"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string")).otherwise("NA").alias("price"),
        F.concat(F.lit("line 1\nhe said \""), "o_orderpriority", F.lit("\", twice")).alias("note"))
    folder = _scratch(spark)
    orders.write.option("header", "true").option("escape", '"').partitionBy("o_orderstatus").csv(folder)
    (_, loaded), = discovery.load_stations(spark, folder).tables
    return loaded.select(F.substring_index("station", "=", -1).alias("station"), F.col("order_key").cast("long").alias("order_key"),
                         "price", "note")


@query("csv_single_file", """
SELECT 'one' AS station, o_orderkey AS order_key, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
       'line 1' || chr(10) || chr(10) || '"' || o_orderpriority || ',' || chr(10) AS note FROM orders""")
def csv_single_file(spark, sf_dir):
    """All orders in one CSV file whose quoted values go on over lines, read in many small splits that end anywhere."""
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string")).otherwise("NA").alias("price"),
        F.concat(F.lit("line 1\n\n\""), "o_orderpriority", F.lit(",\n")).alias("note"))
    folder = _scratch(spark)
    (orders.coalesce(1).write.option("header", "true").option("escape", '"').option("ignoreTrailingWhiteSpace", "false")
     .csv(f"{folder}/one"))
    small = {"spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1"}
    before = {key: spark.conf.get(key) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        (_, loaded), = discovery.load_stations(spark, folder).tables
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return loaded.select("station", F.col("order_key").cast("long").alias("order_key"), "price", "note")


@query("day_first_times", """
SELECT o_orderstatus AS station, o_orderkey AS row_id, strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS seen
FROM orders""")
def day_first_times(spark, sf_dir):
    """Text dates with the day first: one layout holds for the whole column."""
    rows = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("station"), F.col("o_orderkey").alias("row_id"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"))
    dated, _ = discovery.in_time_order(rows, ["order_date"], "order_date")
    return dated.select("station", "row_id", F.col("_order_ts").cast("timestamp_ntz").alias("seen"))


@query("saved_adjacency_graph", f"""WITH {CELLS_SQL}
SELECT station, source, target, round(weight, 6) + 0.0 AS weight FROM cells
WHERE source_idx < target_idx AND abs(weight) > 1e-12""")
def saved_adjacency_graph(spark, sf_dir):
    """The edges of labelled matrices survive writing them down and reading them back."""
    nodes, edges = line_graph(spark, sf_dir)
    folder = _scratch(spark)
    artefacts.write_adjacency(materialise(nodes), edges, folder)
    out = graphs.graph_from_adjacency(artefacts.read_saved_adjacency(spark, folder))
    return out.select("station", "source", "target", rounded(F.col("weight")).alias("weight"))


@query("saved_features", """
SELECT event_type AS station, event_id, user_id FROM events""")
def saved_features(spark, sf_dir):
    """Without a scaled table the cleaned one is read, less its columns that are no features."""
    folder = _scratch(spark)
    events = inputs.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station"), "event_id", "user_id", "value", F.col("ts").cast("string").alias("time"))
    artefacts.write_table(events, f"{folder}/cleaned")
    return artefacts.read_features(spark, f"{folder}/scaled", f"{folder}/cleaned").select("station", "event_id", "user_id")


@query("saved_embeddings", """
SELECT 'label ' || label AS station, 'run ' || vec_id % 3 AS run, vec_id::VARCHAR AS node,
       len(embedding)::BIGINT AS dimension, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 6) + 0.0 AS total
FROM embeddings""")
def saved_embeddings(spark, sf_dir):
    """Vectors written by station and run, and read back."""
    folder = _scratch(spark)
    vectors = inputs.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label "), "label").alias("station"), F.concat(F.lit("run "), F.col("vec_id") % 3).alias("run"),
        F.col("vec_id").cast("string").alias("node"), F.col("embedding").cast("array<double>").alias("embedding"))
    artefacts.write_embeddings(vectors, folder)
    return artefacts.read_embeddings(spark, folder).select(
        "station", "run", "node", F.size("embedding").cast("long").alias("dimension"),
        rounded(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)).alias("total"))


def line_metrics(spark, sf_dir):
    """Structure metrics of three graph types of the line items in one plan."""
    parts = [line_graph(spark, sf_dir, t) for t in ("correlation", "top_k", "weighted")]
    nodes, edges = parts[0]
    for more_nodes, more_edges in parts[1:]:
        nodes, edges = nodes.unionByName(more_nodes), edges.unionByName(more_edges)
    return materialise(metrics.graph_metrics(nodes, edges))


THREE_SQL = "three AS (" + " UNION ALL ".join(
    f"SELECT * FROM ({metrics_sql(t, base, directed)})" for t, base, directed in (
        ("correlation", CORR_EDGES_SQL, False), ("top_k", DIRECTED_SQL, True), ("weighted", WEIGHTED_SQL, False))) + ")"


@query("metric_table", f"WITH {THREE_SQL} " + " UNION ALL ".join(
    f"SELECT station, '{m}' AS metric, " + ", ".join(
        f"max({m}::DOUBLE) FILTER (WHERE graph_type = '{t}') AS {t}" for t in graphs.GRAPH_TYPES)
    + " FROM three GROUP BY station" for m in metrics.METRICS))
def metric_table(spark, sf_dir):
    out = reports.metric_table(line_metrics(spark, sf_dir))
    return out.select("station", "metric", *[rounded(F.col(t)).alias(t) for t in graphs.GRAPH_TYPES])


@query("density_table", f"WITH {THREE_SQL} SELECT station, " + ", ".join(
    f"coalesce(max(density) FILTER (WHERE graph_type = '{t}'), 0.0)::DOUBLE AS {t}" for t in graphs.GRAPH_TYPES)
    + " FROM three GROUP BY station")
def density_table(spark, sf_dir):
    """No learnable graph here, so its density is 0."""
    out = reports.density_table(line_metrics(spark, sf_dir))
    return out.select("station", *[rounded(F.col(t)).alias(t) for t in graphs.GRAPH_TYPES])


@query("comparison_table", f"""WITH {LINE_SQL}
SELECT station, count(*) AS raw_rows, 5::BIGINT AS raw_columns, 5::BIGINT AS nodes, 40 * count(*) AS bytes,
       'Success' AS embedding_status FROM line GROUP BY station""")
def comparison_table(spark, sf_dir):
    rows = inputs.line_features(spark, sf_dir)
    profiles = materialise(profile.table_profile(rows, LINE_COLS))
    features = profiles.select("station", F.explode(F.array(*[F.lit(c) for c in LINE_COLS])).alias("column"))
    return reports.comparison_table(profiles, clean.feature_guard(features, profiles))


PROFILE_RUNS = {"correlation_GAT": (0.0, 0.25, 0.5), "weighted_GAT": (0.25, 0.5, 0.75),
                "correlation_GraphSAGE": (0.1, 0.5, 0.9)}


@query("distance_table", f"""WITH {inputs.USER_DAYS_SQL},
cells AS (""" + " UNION ALL ".join(
    f"SELECT station, '{run}' AS run, '{c}' AS node, {d} AS d, quantile_cont({c}, {p}) AS v FROM user_days GROUP BY station"
    for run, probs in PROFILE_RUNS.items() for c in EVENT_COLS for d, p in enumerate(probs)) + """),
dist AS (SELECT a.station, a.run, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS distance
  FROM cells a JOIN cells b ON a.station = b.station AND a.run = b.run AND a.d = b.d AND a.node < b.node
  GROUP BY a.station, a.run, a.node, b.node),
mean AS (SELECT station, run, avg(distance) AS m FROM dist GROUP BY station, run)
SELECT station, round(coalesce(avg(m) FILTER (WHERE contains(run, 'GAT')), 0), 6) + 0.0 AS gat_mean_distance,
       round(coalesce(avg(m) FILTER (WHERE NOT contains(run, 'GAT')), 0), 6) + 0.0 AS graphsage_mean_distance
FROM mean GROUP BY station""")
def distance_table(spark, sf_dir):
    """Three sets of column profiles stand in for embedding runs."""
    rows = inputs.user_days(spark, sf_dir)
    probs = sorted({p for group in PROFILE_RUNS.values() for p in group})
    q = materialise(exact_percentiles(rows, EVENT_COLS, probs))
    runs = q.select("station", F.inline(F.array(*[
        F.struct(F.lit(run).alias("run"), F.lit(c).alias("node"),
                 F.array(*[F.col(c)[probs.index(p)] for p in group]).alias("embedding"))
        for run, group in PROFILE_RUNS.items() for c in EVENT_COLS])))
    out = reports.distance_table(quality.embedding_quality(runs))
    return out.select("station", rounded(F.col("gat_mean_distance")).alias("gat_mean_distance"),
                      rounded(F.col("graphsage_mean_distance")).alias("graphsage_mean_distance"))


@query("node_feature_table", f"""WITH {CORR_EDGES_SQL}
SELECT n.station, n.node, """ + ", ".join(
    f"CASE n.node " + " ".join(f"WHEN '{c}' THEN round(max(s.{f}_{c}), 4) + 0.0" for c in LINE_COLS) + f" END AS {f}"
    for f in ("mean", "std")) + """,
  round((SELECT count(*) FROM edges e WHERE e.station = n.station AND (e.source = n.node OR e.target = n.node)) / 4, 6)
    + 0.0 AS degree_centrality, r.value AS pagerank
FROM nodes n JOIN (SELECT station, """ + ", ".join(
    f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in LINE_COLS) + f""" FROM line GROUP BY station) s
ON s.station = n.station JOIN ({pagerank_sql(CORR_EDGES_SQL, False)}) r ON r.station = n.station AND r.node = n.node
GROUP BY n.station, n.node, r.value""")
def node_feature_table(spark, sf_dir):
    nodes, edges = line_graph(spark, sf_dir)
    nodes = materialise(nodes)
    central = materialise(centrality.centralities(nodes, edges))
    stats = profile.node_stats(inputs.line_features(spark, sf_dir), LINE_COLS)
    out = reports.node_feature_table(nodes, stats, central)
    return out.select("station", "node", rounded(F.col("mean"), 4).alias("mean"), rounded(F.col("std"), 4).alias("std"),
                      rounded(F.col("degree_centrality")).alias("degree_centrality"),
                      rounded(F.col("pagerank")).alias("pagerank"))


def line_run(spark, sf_dir):
    rows = inputs.line_features(spark, sf_dir).withColumn("row_id", F.monotonically_increasing_id())
    return stations.run_stations(rows, LINE_COLS, Settings(redundant_correlation_threshold=1.0, top_k_neighbors=2))


@query("station_reports")
def station_reports(spark, sf_dir):
    """The whole analysis of the line items, as one JSON document per station."""
    report = line_run(spark, sf_dir).report
    return report.select("station", F.to_json(F.struct(*report.columns)).alias("report"))


# A folder of two kinds of stations: line items by flag and orders by status, which share no column set.
ORDER_COLS = ["price", "buyer", "age"]
GLOBAL_SQL = f"""WITH {LINE_SQL},
ord AS (SELECT o_orderstatus AS station, o_totalprice AS price, o_custkey::DOUBLE AS buyer,
    date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS age FROM orders),
pairs AS (
  SELECT 'flag ' || station AS station, value AS r, 5 AS n FROM ({inputs.pair_union_sql(LINE_COLS, inputs.PEARSON_CELL, 'line')})
  UNION ALL
  SELECT 'status ' || station, value, 3 FROM ({inputs.pair_union_sql(ORDER_COLS, inputs.PEARSON_CELL, 'ord')}))"""
_saved_runs: dict[tuple, ResultStore] = {}


def global_run(spark, sf_dir) -> ResultStore:
    """The whole analysis of both kinds of stations, loaded from files, saved as one run; made once per session and tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _saved_runs:
        folder = _scratch(spark)
        line = inputs.line_features(spark, sf_dir).withColumn("station", F.concat(F.lit("flag "), "station"))
        orders = inputs.table(spark, sf_dir, "orders").select(
            F.concat(F.lit("status "), "o_orderstatus").alias("station"), F.col("o_totalprice").alias("price"),
            F.col("o_custkey").cast("double").alias("buyer"),
            F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double").alias("age"))
        for rows in (line, orders):
            rows.write.mode("append").partitionBy("station").parquet(f"{folder}/data")
        cfg = Settings(redundant_correlation_threshold=1.0, top_k_neighbors=2, outlier_treatment="none")
        runs, failures = stations.run_folder(spark, f"{folder}/data", cfg)
        _saved_runs[key] = stations.save_runs(runs, failures, f"{folder}/results", "whole folder", cfg)
    return _saved_runs[key]


def _station():
    return F.substring_index("station", "=", -1).alias("station")


@query("global_comparison", f"""{GLOBAL_SQL}
SELECT 'flag ' || station AS station, count(*) AS raw_rows, 5::BIGINT AS raw_columns, 5::BIGINT AS nodes,
       40 * count(*) AS bytes, 'Success' AS embedding_status FROM line GROUP BY station
UNION ALL
SELECT 'status ' || station, count(*), 3, 3, 24 * count(*), 'Success' FROM ord GROUP BY station""")
def global_comparison(spark, sf_dir):
    """Stations of every column set side by side, read through the results folder's manifest."""
    saved = global_run(spark, sf_dir).read("comparison")
    return saved.select(_station(), "raw_rows", F.col("raw_columns").cast("long").alias("raw_columns"),
                        F.col("nodes").cast("long").alias("nodes"), "bytes", "embedding_status")


@query("global_density", f"""{GLOBAL_SQL}
SELECT station, round(sum((abs(r) > 0.5)::INT) / (n * (n - 1) / 2), 6) + 0.0 AS correlation,
       round(n * least(2, n - 1) / (n * (n - 1)), 6) + 0.0 AS top_k,
       round(sum((r <> 0)::INT) / (n * (n - 1) / 2), 6) + 0.0 AS weighted
FROM pairs GROUP BY station, n""")
def global_density(spark, sf_dir):
    saved = global_run(spark, sf_dir).read("density")
    return saved.select(_station(), *[rounded(F.col(c)).alias(c) for c in ("correlation", "top_k", "weighted")])


@query("global_profile", f"""{GLOBAL_SQL} """ + " UNION ALL ".join(
    f"SELECT '{kind} ' || station AS station, '{c}' AS column, count({c}) AS known, "
    f"round(avg({c}), 4) + 0.0 AS mean FROM {source} GROUP BY station"
    for kind, source, cols in (("flag", "line", LINE_COLS), ("status", "ord", ORDER_COLS)) for c in cols))
def global_profile(spark, sf_dir):
    """Cleaned rows of stations with different columns, read as one table: columns a station lacks stay out."""
    cols = sorted({*LINE_COLS, *ORDER_COLS})
    cleaned = global_run(spark, sf_dir).read("cleaned")
    wide = cleaned.groupBy("station").agg(*[agg for c in cols for agg in (
        F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"))])
    return (wide.select(_station(), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("known"), F.col(f"m_{c}").alias("mean")) for c in cols])))
        .where("known > 0").select("station", "column", "known", rounded(F.col("mean"), 4).alias("mean")))


@query("global_summary")
def global_summary(spark, sf_dir):
    """Profile, densities and mean distances of every station, one row each."""
    return global_report(global_run(spark, sf_dir)).withColumn("station", _station())
