"""Queries for graph structure and node centralities."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.functions.stats import rounded
from colweave.operators import centrality, graphs, metrics, paths, similarity
from colweave.plans import inputs
from colweave.plans.graph_queries import (CORR_EDGES_SQL, DIRECTED_SQL, PAIRS_SQL, VECTOR_PAIRS_SQL, line_graph)
from colweave.plans.inputs import LINE_COLS, VECTOR_COLS
from colweave.plans.registry import query
from colweave.session import materialise


def wide_graph(spark, sf_dir):
    """64 embedding dimensions linked where they correlate above 0.1."""
    rows = inputs.vector_features(spark, sf_dir)
    pairs = materialise(similarity.pearson_pairs(rows, VECTOR_COLS))
    edges = graphs.correlation_graph(pairs, 0.1)
    return graphs.feature_nodes(pairs, VECTOR_COLS, ("correlation",)), edges


WEIGHTED_SQL = PAIRS_SQL + """,
nodes AS (
  SELECT station, unnest([""" + ", ".join(f"'{c}'" for c in LINE_COLS) + """]) AS node,
         unnest(range(5)) AS idx FROM (SELECT DISTINCT station FROM line)),
edges AS (SELECT station, source, target, i, j, value AS weight FROM pairs WHERE value <> 0)"""

WIDE_SQL = VECTOR_PAIRS_SQL + """,
nodes AS (SELECT 'vectors' AS station, 'd' || lpad(d::VARCHAR, 2, '0') AS node, d AS idx
          FROM (SELECT DISTINCT d FROM cells)),
edges AS (SELECT 'vectors' AS station, 'd' || lpad(i::VARCHAR, 2, '0') AS source,
                 'd' || lpad(j::VARCHAR, 2, '0') AS target, i, j, r AS weight FROM pairs WHERE abs(r) > 0.1)"""


def metrics_sql(graph_type: str, base: str, directed: bool) -> str:
    """Structure metrics of graphs given as ``nodes(station,node,idx)`` and ``edges(station,i,j,weight)``."""
    along = ("SELECT station, i AS s, j AS t FROM edges" if directed else
             "SELECT station, i AS s, j AS t FROM edges UNION SELECT station, j, i FROM edges")
    whole = ("(SELECT count(*) FROM hops_along h WHERE h.station = c.station) = c.n * c.n" if directed
             else "k.parts = 1")
    local = ("found / nullif(deg * (deg - 1) - 2 * mutual, 0)" if directed
             else "2 * found / nullif(deg * (deg - 1), 0)")
    return f"""WITH RECURSIVE {base},
along AS ({along}),
two AS (SELECT station, s, t FROM along UNION SELECT station, t, s FROM along),
walk_any(station, s, t, h) AS (
  SELECT station, idx, idx, 0 FROM nodes
  UNION SELECT w.station, w.s, e.t, w.h + 1 FROM walk_any w JOIN two e ON e.station = w.station AND e.s = w.t
  WHERE w.h < (SELECT count(*) FROM nodes n WHERE n.station = w.station)),
walk_along(station, s, t, h) AS (
  SELECT station, idx, idx, 0 FROM nodes
  UNION SELECT w.station, w.s, e.t, w.h + 1 FROM walk_along w JOIN along e ON e.station = w.station AND e.s = w.t
  WHERE w.h < (SELECT count(*) FROM nodes n WHERE n.station = w.station)),
hops_any AS (SELECT station, s, t, min(h) AS h FROM walk_any GROUP BY station, s, t),
hops_along AS (SELECT station, s, t, min(h) AS h FROM walk_along GROUP BY station, s, t),
comp AS (SELECT station, s AS idx, min(t) AS label FROM hops_any GROUP BY station, s),
sizes AS (SELECT station, label, count(*) AS size FROM comp GROUP BY station, label),
main AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY size DESC, label) AS rk
         FROM sizes) WHERE rk = 1),
k AS (SELECT station, count(*) AS parts FROM sizes GROUP BY station),
c AS (SELECT n.station, count(*) AS n, (SELECT count(*) FROM edges e WHERE e.station = n.station) AS m
      FROM nodes n GROUP BY n.station),
flags AS (SELECT c.*, k.parts, {whole} AS whole FROM c JOIN k USING (station)),
ecc_any AS (SELECT h.station, s, max(h) AS far FROM hops_any h GROUP BY h.station, s),
ecc_along AS (SELECT h.station, s, max(h) AS far FROM hops_along h GROUP BY h.station, s),
span AS (
  SELECT f.station, max(e.far) AS diameter, min(e.far) AS radius
  FROM flags f JOIN ecc_along e USING (station) WHERE f.whole GROUP BY f.station
  UNION ALL
  SELECT f.station, max(e.far), min(e.far) FROM flags f JOIN ecc_any e USING (station)
  JOIN comp USING (station) JOIN main USING (station)
  WHERE NOT f.whole AND comp.idx = e.s AND comp.label = main.label GROUP BY f.station),
links2 AS (SELECT station, least(i, j) AS a, greatest(i, j) AS b, count(*) AS ways FROM edges
           GROUP BY station, least(i, j), greatest(i, j)),
tri AS (
  SELECT x.station, x.a AS a, x.b AS b, y.b AS c, x.ways * y.ways * z.ways AS found
  FROM links2 x JOIN links2 y ON y.station = x.station AND y.a = x.b
  JOIN links2 z ON z.station = x.station AND z.a = x.a AND z.b = y.b),
per AS (SELECT station, unnest([a, b, c]) AS idx, unnest([found, found, found]) AS found FROM tri),
found AS (SELECT station, idx, sum(found) AS found FROM per GROUP BY station, idx),
ends AS (SELECT station, unnest([a, b]) AS idx, unnest([ways, ways]) AS ways FROM links2),
deg AS (SELECT station, idx, sum(ways) AS deg, count(*) FILTER (WHERE ways = 2) AS mutual FROM ends
        GROUP BY station, idx),
clus AS (SELECT n.station, avg(coalesce({local}, 0)) AS clustering_coefficient,
                count(*) FILTER (WHERE deg IS NULL) AS isolated_nodes
         FROM nodes n LEFT JOIN deg ON deg.station = n.station AND deg.idx = n.idx
         LEFT JOIN found ON found.station = n.station AND found.idx = n.idx GROUP BY n.station)
SELECT f.station, '{graph_type}' AS graph_type, n AS node_count, m AS edge_count,
       round({1 if directed else 2} * m / nullif(n * (n - 1), 0), 6) + 0.0 AS density,
       round(2 * m / n, 6) + 0.0 AS avg_degree, parts AS connected_components, isolated_nodes,
       round(clustering_coefficient, 6) + 0.0 AS clustering_coefficient,
       CASE WHEN n > 1 AND (whole OR main.size > 1) THEN diameter::DOUBLE ELSE -1.0::DOUBLE END AS diameter,
       CASE WHEN n > 1 AND (whole OR main.size > 1) THEN radius::DOUBLE ELSE -1.0::DOUBLE END AS radius,
       concat_ws('|',
         CASE WHEN n > 1 AND NOT whole THEN 'Disconnected Graph: Diameter and radius computed on the largest component.' END,
         CASE WHEN m = 0 THEN 'Degenerate Graph: No edges exist.' END,
         CASE WHEN n < 5 THEN 'Small Graph Warning: Graph contains only ' || n || ' nodes.' END,
         CASE WHEN parts > 1 THEN 'Disconnected Graph: Contains ' || parts || ' connected components.' END,
         CASE WHEN isolated_nodes > 0 THEN 'Isolated Nodes Warning: ' || isolated_nodes || ' nodes have no connections.' END
       ) AS warnings
FROM flags f LEFT JOIN span USING (station) JOIN main USING (station) JOIN clus USING (station)"""


def _metrics_out(nodes, edges):
    out = metrics.graph_metrics(nodes, edges)
    return out.select("station", "graph_type", "node_count", "edge_count", rounded(F.col("density")).alias("density"),
                      rounded(F.col("avg_degree")).alias("avg_degree"), "connected_components", "isolated_nodes",
                      rounded(F.col("clustering_coefficient")).alias("clustering_coefficient"),
                      "diameter", "radius", F.concat_ws("|", "warnings").alias("warnings"))


@query("graph_metrics_correlation", metrics_sql("correlation", CORR_EDGES_SQL, False))
def graph_metrics_correlation(spark, sf_dir):
    return _metrics_out(*line_graph(spark, sf_dir, "correlation"))


@query("graph_metrics_top_k", metrics_sql("top_k", DIRECTED_SQL, True))
def graph_metrics_top_k(spark, sf_dir):
    return _metrics_out(*line_graph(spark, sf_dir, "top_k"))


@query("graph_metrics_weighted", metrics_sql("weighted", WEIGHTED_SQL, False))
def graph_metrics_weighted(spark, sf_dir):
    return _metrics_out(*line_graph(spark, sf_dir, "weighted"))


@query("graph_metrics_wide", metrics_sql("correlation", WIDE_SQL, False))
def graph_metrics_wide(spark, sf_dir):
    """64 nodes, sparse and disconnected."""
    return _metrics_out(*wide_graph(spark, sf_dir))


@query("connected_components_wide", f"""WITH RECURSIVE {WIDE_SQL},
two AS (SELECT i AS s, j AS t FROM edges UNION SELECT j, i FROM edges),
reach(s, t) AS (SELECT idx, idx FROM nodes UNION SELECT r.s, two.t FROM reach r JOIN two ON two.s = r.t)
SELECT s::INT AS idx, min(t)::INT AS label FROM reach GROUP BY s""")
def connected_components_wide(spark, sf_dir):
    nodes, edges = wide_graph(spark, sf_dir)
    nodes = materialise(nodes)
    return paths.components(nodes, materialise(paths.links(nodes, edges))).select("idx", "label")


# The flagship: correlate, link and measure.
@query("line_graph_summary", f"""WITH {CORR_EDGES_SQL},
c AS (SELECT n.station, count(*) AS node_count, (SELECT count(*) FROM edges e WHERE e.station = n.station) AS edge_count,
      count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.station = n.station
                                         AND (e.source = n.node OR e.target = n.node))) AS isolated_nodes
      FROM nodes n GROUP BY n.station)
SELECT station, node_count, edge_count, round(2 * edge_count / node_count, 6) + 0.0 AS avg_degree,
       round(2 * edge_count / (node_count * (node_count - 1)), 6) + 0.0 AS density, isolated_nodes FROM c""")
def line_graph_summary(spark, sf_dir):
    nodes, edges = line_graph(spark, sf_dir)
    ordered = materialise(paths.links(nodes, edges))
    lonely = metrics.isolated_nodes(nodes, ordered).groupBy("station").agg(
        F.count(F.lit(1)).alias("isolated_nodes"))
    return (metrics.basic_counts(nodes, ordered).join(lonely, "station", "left").fillna(0, ["isolated_nodes"])
            .select("station", "node_count", "edge_count", rounded(F.col("avg_degree")).alias("avg_degree"),
                    rounded(F.col("density")).alias("density"), "isolated_nodes"))


# ---------------------------------------------------------------- centralities

def _degree_sql(base: str) -> str:
    return f"""WITH {base}
SELECT n.station, n.node, round((SELECT count(*) FROM edges e WHERE e.station = n.station
         AND (e.source = n.node OR e.target = n.node))
       / nullif((SELECT count(*) FROM nodes m WHERE m.station = n.station) - 1, 0), 6) + 0.0 AS value
FROM nodes n"""


def _paths_sql(base: str, directed: bool) -> str:
    """Shortest lengths and path counts by listing simple paths of small graphs."""
    along = "SELECT station, i AS s, j AS t, 1 / (abs(weight) + 1e-6) AS d FROM edges"
    if not directed:
        along += " UNION ALL SELECT station, j, i, 1 / (abs(weight) + 1e-6) FROM edges"
    return f"""WITH RECURSIVE {base},
along AS ({along}),
walk(station, s, t, d, seen) AS (
  SELECT station, idx, idx, 0.0::DOUBLE, [idx] FROM nodes
  UNION ALL SELECT w.station, w.s, a.t, w.d + a.d, list_append(w.seen, a.t) FROM walk w
  JOIN along a ON a.station = w.station AND a.s = w.t WHERE NOT list_contains(w.seen, a.t)),
best AS (SELECT station, s, t, min(d) AS d FROM walk GROUP BY station, s, t),
short AS (SELECT w.* FROM walk w JOIN best b ON b.station = w.station AND b.s = w.s AND b.t = w.t
          AND abs(w.d - b.d) <= 1e-12 * b.d WHERE w.s <> w.t),
num AS (SELECT station, s, t, count(*) AS paths FROM short GROUP BY station, s, t),
n AS (SELECT station, count(*) AS n FROM nodes GROUP BY station)"""


def _closeness_sql(base: str, directed: bool) -> str:
    return _paths_sql(base, directed) + """,
r AS (SELECT station, t, sum(d) AS total, count(*) AS others FROM best WHERE s <> t GROUP BY station, t)
SELECT nodes.station, node, round(coalesce(others / nullif(total, 0) * (others / nullif(n - 1, 0)), 0), 6) + 0.0 AS value
FROM nodes JOIN n ON n.station = nodes.station LEFT JOIN r ON r.station = nodes.station AND r.t = nodes.idx"""


def _betweenness_sql(base: str, directed: bool) -> str:
    return _paths_sql(base, directed) + """,
via AS (SELECT short.station, unnest(seen[2:-2]) AS idx, short.s, short.t, paths FROM short
        JOIN num ON num.station = short.station AND num.s = short.s AND num.t = short.t WHERE len(seen) > 2),
flow AS (SELECT station, idx, sum(1 / paths) AS flow FROM via GROUP BY station, idx)
SELECT nodes.station, node, round(coalesce(flow / nullif((n - 1) * (n - 2), 0), 0), 6) + 0.0 AS value
FROM nodes JOIN n ON n.station = nodes.station
LEFT JOIN flow ON flow.station = nodes.station AND flow.idx = nodes.idx"""


def _matrix_sql(base: str, directed: bool) -> str:
    """One row per graph: ``w[i][j]`` is the weight from node j into node i."""
    into = "SELECT station, i AS s, j AS t, abs(weight) AS w FROM edges"
    if not directed:
        into += " UNION ALL SELECT station, j, i, abs(weight) FROM edges"
    return f"""WITH RECURSIVE {base},
into_ AS ({into}),
outw AS (SELECT station, s, sum(w) AS total FROM into_ GROUP BY station, s),
grid AS (
  SELECT a.station, a.idx AS t, b.idx AS s, coalesce(x.w, 0) AS w, coalesce(x.w / nullif(o.total, 0), 0) AS p
  FROM nodes a JOIN nodes b ON b.station = a.station
  LEFT JOIN into_ x ON x.station = a.station AND x.t = a.idx AND x.s = b.idx
  LEFT JOIN outw o ON o.station = a.station AND o.s = b.idx),
rws AS (SELECT station, t, list(w ORDER BY s) AS w, list(p ORDER BY s) AS p FROM grid GROUP BY station, t),
mats AS (SELECT station, count(*) AS n, list(w ORDER BY t) AS w, list(p ORDER BY t) AS p FROM rws GROUP BY station),
dead AS (SELECT nodes.station, list(CASE WHEN coalesce(total, 0) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY idx)
         AS stuck FROM nodes LEFT JOIN outw ON outw.station = nodes.station AND outw.s = idx GROUP BY nodes.station)"""


def _eigen_sql(base: str, directed: bool) -> str:
    return _matrix_sql(base, directed) + """,
it(station, n, w, x, k, done) AS (
  SELECT station, n, w, list_transform(range(n), lambda i: 1.0::DOUBLE / n), 0, false FROM mats
  UNION ALL
  SELECT station, n, w, y, k + 1, list_sum(list_transform(range(n), lambda i: abs(y[i + 1] - x[i + 1]))) < n * 1e-5
  FROM (SELECT *, list_transform(g, lambda v: v / norm) AS y FROM (
    SELECT *, CASE WHEN sqrt(list_inner_product(g, g)) = 0 THEN 1 ELSE sqrt(list_inner_product(g, g)) END AS norm FROM (
      SELECT *, list_transform(range(n), lambda i: x[i + 1] + list_inner_product(w[i + 1], x)) AS g
      FROM it WHERE NOT done AND k < 1000)))),
final AS (SELECT station, x, done FROM it WHERE done OR k = 1000)
SELECT nodes.station, node, round(CASE WHEN done THEN x[idx + 1] ELSE 0 END, 6) + 0.0 AS value
FROM nodes JOIN final ON final.station = nodes.station"""


def pagerank_sql(base: str, directed: bool) -> str:
    return _matrix_sql(base, directed) + """,
it(station, n, p, stuck, x, k, done) AS (
  SELECT mats.station, n, p, stuck, list_transform(range(n), lambda i: 1.0::DOUBLE / n), 0, false
  FROM mats JOIN dead ON dead.station = mats.station
  UNION ALL
  SELECT station, n, p, stuck, y, k + 1, list_sum(list_transform(range(n), lambda i: abs(y[i + 1] - x[i + 1]))) < n * 1e-5
  FROM (SELECT *, list_transform(p, lambda r: 0.85 * list_inner_product(r, x)
                  + (0.85 * list_inner_product(stuck, x) + 0.15) / n) AS y
        FROM it WHERE NOT done AND k < 1000)),
final AS (SELECT station, x, done FROM it WHERE done OR k = 1000)
SELECT nodes.station, node, round(CASE WHEN done THEN x[idx + 1] ELSE 0 END, 6) + 0.0 AS value
FROM nodes JOIN final ON final.station = nodes.station"""


_BASES = {"correlation": (CORR_EDGES_SQL, False), "top_k": (DIRECTED_SQL, True)}


def _centrality(spark, sf_dir, graph_type, name):
    nodes, edges = line_graph(spark, sf_dir, graph_type)
    nodes = materialise(nodes)
    ordered = materialise(centrality.with_distance(paths.links(nodes, edges)))
    if name == "degree":
        out = centrality.degree(nodes, ordered)
    elif name == "eigenvector":
        out = centrality.eigenvector(nodes, ordered)
    elif name == "pagerank":
        out = centrality.pagerank(nodes, ordered)
    else:
        out = getattr(centrality, name)(nodes, paths.path_sums(nodes, ordered))
    value = [c for c in out.columns if c not in ("station", "graph_type", "idx")][0]
    return out.join(nodes, ["station", "graph_type", "idx"]).select(
        "station", "node", rounded(F.col(value)).alias("value"))


for _type, (_base, _directed) in _BASES.items():
    for _name, _sql in (("degree", _degree_sql(_base)), ("closeness", _closeness_sql(_base, _directed)),
                        ("betweenness", _betweenness_sql(_base, _directed)),
                        ("eigenvector", _eigen_sql(_base, _directed)),
                        ("pagerank", pagerank_sql(_base, _directed))):
        query(f"{_name}_centrality_{_type}", _sql)(
            lambda spark, sf_dir, t=_type, m=_name: _centrality(spark, sf_dir, t, m))


@query("pagerank_wide", pagerank_sql(WIDE_SQL, False))
def pagerank_wide(spark, sf_dir):
    nodes, edges = wide_graph(spark, sf_dir)
    nodes = materialise(nodes)
    out = centrality.pagerank(nodes, materialise(paths.links(nodes, edges)))
    return out.join(nodes, ["station", "graph_type", "idx"]).select(
        "station", "node", rounded(F.col("pagerank")).alias("value"))
