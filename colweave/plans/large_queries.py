"""Operators forced onto their form for large stations or graphs, against the same SQL as their other form."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.functions.stats import rounded
from colweave.operators import centrality, iforest, ordered, paths, profile, quantiles
from colweave.plans import inputs
from colweave.plans.graph_queries import line_graph
from colweave.plans.inputs import EVENT_COLS
from colweave.plans.metric_queries import wide_graph
from colweave.plans.registry import SQL, query
from colweave.session import materialise

# Rows a station may have before its rows are cut into slices, far below any station here.
SLICED = 100


@query("fill_both_ways_sliced", SQL["fill_both_ways"])
def fill_both_ways_sliced(spark, sf_dir):
    rows = inputs.event_signals(spark, sf_dir, "concat('user ', user_id)")
    return ordered.fill_both_ways(rows, EVENT_COLS, limit=1).select("station", "row_id", *EVENT_COLS)


@query("time_interpolation_sliced", SQL["time_interpolation"])
def time_interpolation_sliced(spark, sf_dir):
    out = ordered.interpolate_in_time(inputs.event_signals(spark, sf_dir), EVENT_COLS, limit=SLICED)
    return out.select("station", "row_id", *[rounded(F.col(c)).alias(c) for c in EVENT_COLS])


@query("sequence_tests_sliced", SQL["sequence_tests"])
def sequence_tests_sliced(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select(F.lit("log").alias("station"), "ts", "event_id", "user_id")
    return ordered.sequence_tests(rows, ["event_id", "user_id"], ["ts", "event_id"], SLICED)


@query("column_medians_histogram", SQL["column_medians"])
def column_medians_histogram(spark, sf_dir):
    out = quantiles.medians(inputs.user_days(spark, sf_dir), EVENT_COLS, SLICED)
    return out.select("station", *[rounded(F.col(c)).alias(c) for c in EVENT_COLS])


@query("iqr_outlier_counts_histogram", SQL["iqr_outlier_counts"])
def iqr_outlier_counts_histogram(spark, sf_dir):
    found = profile.iqr_outliers(inputs.event_values(spark, sf_dir), ["value"], SLICED)
    return found.select("station", "column", "outliers", rounded(F.col("lower_bound"), 4).alias("lower_bound"),
                        rounded(F.col("upper_bound"), 4).alias("upper_bound"))


@query("connected_components_joined", SQL["connected_components_wide"])
def connected_components_joined(spark, sf_dir):
    nodes, edges = wide_graph(spark, sf_dir)
    nodes = materialise(nodes)
    return paths.components(nodes, materialise(paths.links(nodes, edges)), row_nodes=0).select("idx", "label")


def _joined(spark, sf_dir, name: str, graph_type: str):
    nodes, edges = line_graph(spark, sf_dir, graph_type)
    nodes = materialise(nodes)
    found = materialise(centrality.with_distance(paths.links(nodes, edges)))
    if name == "closeness":
        lengths = materialise(paths.shortest_lengths(nodes, found, row_nodes=0))
        out = centrality.closeness(nodes, centrality.length_sums(lengths))
    elif name == "betweenness":
        # Sources of one graph in several tasks.
        out = centrality.betweenness(nodes, paths.path_sums(nodes, found, block=2))
    else:
        out = getattr(centrality, name)(nodes, found, row_links=0)
    return out.join(nodes, ["station", "graph_type", "idx"]).select(
        "station", "node", rounded(F.col(out.columns[-1])).alias("value"))


for _name in ("closeness", "betweenness", "eigenvector", "pagerank"):
    for _type in ("correlation", "top_k"):
        query(f"{_name}_centrality_{_type}_{'blocks' if _name == 'betweenness' else 'joined'}", SQL[f"{_name}_centrality_{_type}"])(
            lambda spark, sf_dir, n=_name, t=_type: _joined(spark, sf_dir, n, t))


@query("isolation_forest_forms", """
SELECT nullif(o_orderstatus, 'P') AS station, count(*) AS rows, count(DISTINCT o_orderkey) AS scored, 0::BIGINT AS differing,
       true AS within FROM orders GROUP BY nullif(o_orderstatus, 'P')""")
def isolation_forest_forms(spark, sf_dir):
    """Both ways to bring rows and trees together give every row the same score, once, between 0 and 1.

    Rows without a station are a station, too.
    """
    cols = ["o_totalprice", "day"]
    rows = inputs.table(spark, sf_dir, "orders").select(
        F.nullif("o_orderstatus", F.lit("P")).alias("station"), F.col("o_orderkey").alias("row_id"),
        "o_totalprice", F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("day"))
    forest = materialise(iforest.grow_forest(rows, cols))
    both = iforest.with_scores(iforest.with_scores(rows, cols, forest, out="sent"), cols, forest, 0, "keyed")
    return both.groupBy("station").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("row_id").alias("scored"),
        F.count(F.when(F.abs(F.col("sent") - F.col("keyed")) > 1e-12, 1)).alias("differing"),
        F.bool_and((F.col("sent") > 0) & (F.col("sent") < 1)).alias("within"))


@query("isolation_forest_bounds", f"""WITH {inputs.EVENT_VALUES_SQL}
SELECT station, count(*) AS rows, 0::BIGINT AS moved_elsewhere, true AS some_treated FROM readings GROUP BY station""")
def isolation_forest_bounds(spark, sf_dir):
    """Treatment keeps every row, and a value it moves lands on its station's 1st or 99th percentile."""
    rows = inputs.event_values(spark, sf_dir)
    treated, found = iforest.treat_by_forest(rows, ["value"], "clip")
    tails = quantiles.exact_percentiles(rows, ["value"], [0.01, 0.99]).select("station", F.col("value").alias("tails"))
    moved = (rows.select("station", "row_id", F.col("value").alias("before"))
             .join(treated.select("station", "row_id", "value"), ["station", "row_id"]).join(tails, "station"))
    changed = F.col("value") != F.col("before")
    edge = F.least(F.abs(F.col("value") - F.col("tails")[0]), F.abs(F.col("value") - F.col("tails")[1]))
    return (moved.groupBy("station").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(changed & (edge > 1e-9), 1)).alias("moved_elsewhere"))
        .join(found, "station").select("station", "rows", "moved_elsewhere", (F.col("outliers") > 0).alias("some_treated")))
