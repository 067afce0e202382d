"""Queries for scaling, column similarity and the four graph builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.functions.stats import rounded
from colweave.operators import graphs, similarity
from colweave.operators.scale import standard_scale
from colweave.plans import inputs
from colweave.plans.inputs import (EVENT_COLS, LINE_COLS, LINE_SQL, LINE_STATS_SQL, PEARSON_CELL,
                                   USER_DAYS_SQL, VECTOR_COLS, VECTOR_SQL,
                                   pair_union_sql)
from colweave.plans.registry import query
from colweave.session import materialise

PAIRS_SQL = LINE_STATS_SQL + """,
pairs AS (
  """ + pair_union_sql(LINE_COLS, PEARSON_CELL, "scaled") + ")"

CORR_EDGES_SQL = PAIRS_SQL + """,
nodes AS (
  SELECT station, unnest([""" + ", ".join(f"'{c}'" for c in LINE_COLS) + """]) AS node,
         unnest(range(5)) AS idx FROM (SELECT DISTINCT station FROM line)),
edges AS (SELECT station, source, target, i, j, value AS weight FROM pairs WHERE abs(value) > 0.5)"""

DIRECTED_SQL = PAIRS_SQL + """,
nodes AS (
  SELECT station, unnest([""" + ", ".join(f"'{c}'" for c in LINE_COLS) + """]) AS node,
         unnest(range(5)) AS idx FROM (SELECT DISTINCT station FROM line)),
ordered AS (
  SELECT station, i, j, source, target, value AS r FROM pairs
  UNION ALL SELECT station, j, i, target, source, value FROM pairs),
edges AS (
  SELECT station, source, target, i, j, r AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY station, source ORDER BY abs(r) DESC, j DESC) AS rk
    FROM ordered) WHERE rk <= 2 AND abs(r) > 1e-6)"""


def scaled_line(spark, sf_dir):
    return standard_scale(inputs.line_features(spark, sf_dir), LINE_COLS)


def line_pairs(spark, sf_dir):
    """Correlation does not change under scaling, so one scan of the raw columns gives it."""
    return similarity.pearson_pairs(inputs.line_features(spark, sf_dir), LINE_COLS, complete=True)


def line_graph(spark, sf_dir, graph_type="correlation"):
    """Node and edge tables of one graph type over the line item features."""
    # A few rows per station: written once, read for nodes and for edges.
    pairs = materialise(line_pairs(spark, sf_dir))
    edges = {
        "correlation": lambda: graphs.correlation_graph(pairs, 0.5),
        "top_k": lambda: graphs.top_k_graph(pairs, 2),
        "weighted": lambda: graphs.weighted_graph(pairs),
    }[graph_type]()
    return graphs.feature_nodes(pairs, LINE_COLS, (graph_type,)), edges


@query("standard_scaling", f"""WITH {LINE_STATS_SQL}
SELECT station, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in LINE_COLS)} FROM scaled""")
def standard_scaling(spark, sf_dir):
    return scaled_line(spark, sf_dir).select("station", *[rounded(F.col(c)).alias(c) for c in LINE_COLS])


@query("pearson_matrix", f"""WITH {PAIRS_SQL}
SELECT station, source, target, round(value, 6) + 0.0 AS r FROM pairs""")
def pearson_matrix(spark, sf_dir):
    return line_pairs(spark, sf_dir).select("station", "source", "target", rounded(F.col("r")).alias("r"))


@query("pearson_matrix_gappy", f"""WITH {USER_DAYS_SQL},
pairs AS ({pair_union_sql(EVENT_COLS, PEARSON_CELL, "user_days")})
SELECT station, source, target, round(value, 6) + 0.0 AS r FROM pairs""")
def pearson_matrix_gappy(spark, sf_dir):
    """Pairwise-complete correlation over columns with missing values."""
    pairs = similarity.pearson_pairs(inputs.user_days(spark, sf_dir), EVENT_COLS)
    return pairs.select("station", "source", "target", rounded(F.col("r")).alias("r"))


@query("pearson_matrix_blocks", f"""WITH {USER_DAYS_SQL},
pairs AS ({pair_union_sql(EVENT_COLS, PEARSON_CELL, "user_days")})
SELECT station, source, target, round(value, 6) + 0.0 AS r FROM pairs""")
def pearson_matrix_blocks(spark, sf_dir):
    """The same matrix through Arrow blocks and partial sums."""
    pairs = similarity.pearson_pairs(inputs.user_days(spark, sf_dir), EVENT_COLS, wide_limit=0)
    return pairs.select("station", "source", "target", rounded(F.col("r")).alias("r"))


VECTOR_PAIRS_SQL = VECTOR_SQL + """,
pairs AS (
  SELECT a.d AS i, b.d AS j,
         coalesce(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0), 0) AS r
  FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.d < b.d GROUP BY a.d, b.d)"""


@query("pearson_matrix_wide", f"""WITH {VECTOR_PAIRS_SQL}
SELECT 'd' || lpad(i::VARCHAR, 2, '0') AS source, 'd' || lpad(j::VARCHAR, 2, '0') AS target,
       round(r, 6) + 0.0 AS r FROM pairs""")
def pearson_matrix_wide(spark, sf_dir):
    """All 2,016 pairs of 64 columns."""
    pairs = similarity.pearson_pairs(inputs.vector_features(spark, sf_dir), VECTOR_COLS)
    return pairs.select("source", "target", rounded(F.col("r")).alias("r"))


COSINE_CELL = "coalesce(sum({a} * {b}) / nullif(sqrt(sum({a} * {a})) * sqrt(sum({b} * {b})), 0), 0)"


@query("cosine_matrix", f"""WITH {LINE_SQL},
pairs AS ({pair_union_sql(LINE_COLS, COSINE_CELL, "line")})
SELECT station, source, target, round(value, 6) + 0.0 AS r FROM pairs""")
def cosine_matrix(spark, sf_dir):
    pairs = similarity.cosine_pairs(inputs.line_features(spark, sf_dir), LINE_COLS)
    return pairs.select("station", "source", "target", rounded(F.col("r")).alias("r"))


@query("gram_matrix", f"""WITH {LINE_STATS_SQL},
pairs AS ({pair_union_sql(LINE_COLS, "sum({a} * {b})", "scaled", diagonal=True)})
SELECT station, source, target, round(value, 4) + 0.0 AS g FROM pairs""")
def gram_matrix(spark, sf_dir):
    grams = similarity.gram_matrix(scaled_line(spark, sf_dir), LINE_COLS)
    return grams.select("station", "source", "target", rounded(F.col("g"), 4).alias("g"))


@query("gram_matrix_wide", f"""WITH {VECTOR_SQL}
SELECT 'd' || lpad(a.d::VARCHAR, 2, '0') AS source, 'd' || lpad(b.d::VARCHAR, 2, '0') AS target,
       round(sum(a.v * b.v), 6) + 0.0 AS g
FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.d <= b.d GROUP BY a.d, b.d""")
def gram_matrix_wide(spark, sf_dir):
    grams = similarity.gram_matrix(inputs.vector_features(spark, sf_dir), VECTOR_COLS)
    return grams.select("source", "target", rounded(F.col("g")).alias("g"))


EDGE_OUT = "SELECT station, source, target, round(weight, 6) + 0.0 AS weight FROM edges"


def _edge_out(edges):
    return edges.select("station", "source", "target", rounded(F.col("weight")).alias("weight"))


@query("correlation_graph", f"WITH {CORR_EDGES_SQL} {EDGE_OUT}")
def correlation_graph(spark, sf_dir):
    return _edge_out(line_graph(spark, sf_dir)[1])


@query("correlation_graph_wide", f"""WITH {VECTOR_PAIRS_SQL}
SELECT 'd' || lpad(i::VARCHAR, 2, '0') AS source, 'd' || lpad(j::VARCHAR, 2, '0') AS target,
       round(r, 6) + 0.0 AS weight FROM pairs WHERE abs(r) > 0.1""")
def correlation_graph_wide(spark, sf_dir):
    pairs = similarity.pearson_pairs(inputs.vector_features(spark, sf_dir), VECTOR_COLS)
    return _edge_out(graphs.correlation_graph(pairs, 0.1)).drop("station")


@query("top_k_graph", f"WITH {DIRECTED_SQL} {EDGE_OUT}")
def top_k_graph(spark, sf_dir):
    return _edge_out(line_graph(spark, sf_dir, "top_k")[1])


@query("top_k_graph_cosine", f"""WITH {LINE_SQL},
pairs AS ({pair_union_sql(LINE_COLS, COSINE_CELL, "line")}),
ordered AS (
  SELECT station, i, j, source, target, value AS r FROM pairs
  UNION ALL SELECT station, j, i, target, source, value FROM pairs),
edges AS (
  SELECT station, source, target, r AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY station, source ORDER BY abs(r) DESC, j DESC) AS rk
    FROM ordered) WHERE rk <= 3 AND abs(r) > 1e-6)
{EDGE_OUT}""")
def top_k_graph_cosine(spark, sf_dir):
    pairs = similarity.cosine_pairs(inputs.line_features(spark, sf_dir), LINE_COLS)
    return _edge_out(graphs.top_k_graph(pairs, 3))


@query("weighted_graph", f"""WITH {PAIRS_SQL},
edges AS (SELECT station, source, target, value AS weight FROM pairs WHERE value <> 0) {EDGE_OUT}""")
def weighted_graph(spark, sf_dir):
    return _edge_out(line_graph(spark, sf_dir, "weighted")[1])


@query("weak_edge_cut", f"""WITH {PAIRS_SQL},
edges AS (SELECT station, source, target, value AS weight FROM pairs WHERE abs(value) >= 0.05) {EDGE_OUT}""")
def weak_edge_cut(spark, sf_dir):
    return _edge_out(graphs.cut_weak_edges(line_graph(spark, sf_dir, "weighted")[1]))


@query("adjacency_matrix", f"""WITH {DIRECTED_SQL}
SELECT n.station, n.node AS source, {", ".join(
    f"round(coalesce(sum(weight) FILTER (WHERE target = '{c}'), 0), 6) + 0.0 AS {c}" for c in LINE_COLS)}
FROM nodes n LEFT JOIN edges e ON e.station = n.station AND e.source = n.node
GROUP BY n.station, n.node""")
def adjacency_matrix(spark, sf_dir):
    nodes, edges = line_graph(spark, sf_dir, "top_k")
    matrix = graphs.adjacency_matrix(nodes, edges, LINE_COLS)
    return matrix.select("station", "source", *[rounded(F.col(c)).alias(c) for c in LINE_COLS])


CELLS_SQL = CORR_EDGES_SQL + """,
cells AS (
  SELECT a.station, a.node AS source, b.node AS target, a.idx AS source_idx, b.idx AS target_idx,
         coalesce(e.weight, 0) AS weight
  FROM nodes a JOIN nodes b USING (station)
  LEFT JOIN (SELECT station, source, target, weight FROM edges
             UNION ALL SELECT station, target, source, weight FROM edges) e
    ON e.station = a.station AND e.source = a.node AND e.target = b.node)"""


@query("adjacency_aligned", f"""WITH {CELLS_SQL}
SELECT station, source, target, round(weight, 6) + 0.0 AS weight FROM cells""")
def adjacency_aligned(spark, sf_dir):
    nodes, edges = line_graph(spark, sf_dir)
    return _edge_out(graphs.adjacency_cells(nodes, edges))


@query("adjacency_binarised", f"""WITH {CELLS_SQL}
SELECT station, source, target, CASE WHEN abs(weight) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS linked
FROM cells""")
def adjacency_binarised(spark, sf_dir):
    nodes, edges = line_graph(spark, sf_dir)
    return graphs.binarised(graphs.adjacency_cells(nodes, edges)).select("station", "source", "target", "linked")


@query("undirected_edges", f"""WITH {DIRECTED_SQL}
SELECT station, CASE WHEN i < j THEN source ELSE target END AS source,
       CASE WHEN i < j THEN target ELSE source END AS target,
       round(avg(weight) FILTER (WHERE abs(weight) > 1e-12), 6) + 0.0 AS weight
FROM edges GROUP BY ALL HAVING count(*) FILTER (WHERE abs(weight) > 1e-12) > 0""".replace(
    "GROUP BY ALL", "GROUP BY station, CASE WHEN i < j THEN source ELSE target END, "
                    "CASE WHEN i < j THEN target ELSE source END"))
def undirected_edges(spark, sf_dir):
    """Directed top-k matrix read as an undirected one."""
    nodes, edges = line_graph(spark, sf_dir, "top_k")
    return _edge_out(graphs.combine_undirected(graphs.adjacency_cells(nodes, edges)))


@query("edge_features", f"""WITH {DIRECTED_SQL}
SELECT station, source, target, round(weight, 6) + 0.0 AS weight, round(abs(weight), 6) AS abs_weight,
       CASE WHEN weight >= 0 THEN 'positive' ELSE 'negative' END AS sign FROM edges""")
def edge_features(spark, sf_dir):
    out = graphs.edge_features(line_graph(spark, sf_dir, "top_k")[1])
    return (out.select("station", "source", "target", rounded(F.col("weight")).alias("weight"),
                       rounded(F.col("abs_weight")).alias("abs_weight"), "sign")
            .orderBy("station", "source", "target"))
