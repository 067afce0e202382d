"""Queries for message passing, learned adjacency, embeddings and the isolation forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.functions.stats import rounded
from colweave.operators import embed, graphs, iforest, layers, learned, quality, similarity
from colweave.operators.quantiles import exact_percentiles
from colweave.plans import inputs
from colweave.plans.graph_queries import CORR_EDGES_SQL, DIRECTED_SQL, line_graph, scaled_line
from colweave.plans.inputs import EVENT_COLS, LINE_COLS
from colweave.plans.registry import query
from colweave.session import materialise

# Fixed small weights, the same in Spark and in SQL.
WIDTH, HIDDEN, OUT = 4, 3, 2


def fixed_matrix(rows: int, cols: int) -> list[list[float]]:
    return [[((3 * o + 2 * i) % 5 - 2) / 4.0 for i in range(cols)] for o in range(rows)]


def fixed_vector(n: int, offset: int) -> list[float]:
    return [((2 * i + offset) % 3 - 1) / 2.0 for i in range(n)]


def quantile_features(spark, sf_dir, run):
    """Minimum, quartiles and maximum of each scaled column as its node feature."""
    q = materialise(exact_percentiles(scaled_line(spark, sf_dir), LINE_COLS, [0.0, 0.25, 0.75, 1.0]))
    return q.select("station", F.lit(run).alias("run"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("node"), F.col(c).alias("h")) for c in LINE_COLS])))


QUANTILES_SQL = """
h0 AS (""" + " UNION ALL ".join(
    f"SELECT station, '{c}' AS node, {d} AS d, quantile_cont({c}, {p}) AS v FROM scaled GROUP BY station"
    for c in LINE_COLS for d, p in enumerate((0.0, 0.25, 0.75, 1.0))) + ")"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) for v in row) + ")" for row in rows)


def _linear_sql(name: str, source: str, weights) -> str:
    cells = _values((o, i, f"{w}::DOUBLE") for o, row in enumerate(weights) for i, w in enumerate(row))
    return f"""{name} AS (SELECT station, node, o AS d, sum(v * w) AS v FROM {source}
      JOIN (VALUES {cells}) t(o, i, w) ON t.i = {source}.d GROUP BY station, node, o)"""


def _attention_sql(name: str, source: str, weights, a_src, a_dst) -> str:
    ends = _values((i, f"{a}::DOUBLE", f"{b}::DOUBLE") for i, (a, b) in enumerate(zip(a_src, a_dst)))
    return f"""{_linear_sql(name + "_p", source, weights)},
{name}_s AS (SELECT station, node, sum(v * a) AS out_, sum(v * b) AS in_ FROM {name}_p
  JOIN (VALUES {ends}) t(i, a, b) ON t.i = {name}_p.d GROUP BY station, node),
{name}_e AS (SELECT station, source, target, weight FROM ordered_edges
  UNION ALL SELECT station, node, node, 0 FROM nodes),
{name}_l AS (SELECT e.station, source, target, a.out_ + b.in_ + sign(weight) * ln(1 + abs(weight)) AS raw
  FROM {name}_e e JOIN {name}_s a ON a.station = e.station AND a.node = source
  JOIN {name}_s b ON b.station = e.station AND b.node = target),
{name}_x AS (SELECT *, CASE WHEN raw >= 0 THEN raw ELSE 0.2 * raw END AS logit FROM {name}_l),
{name}_a AS (SELECT *, exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w) AS alpha
  FROM {name}_x WINDOW w AS (PARTITION BY station, source)),
{name} AS (SELECT x.station, source AS node, d, sum(alpha * v) AS v FROM {name}_a x
  JOIN {name}_p p ON p.station = x.station AND p.node = x.target GROUP BY x.station, source, d)"""


def _mean_sql(name: str, source: str, weights, bias, width: int, how: str = "mean") -> str:
    agg = ("sum(weight * v) / greatest(sum(abs(weight)), 1)" if how == "mean" else "max(weight * v)")
    offsets = _values((o, f"{b}::DOUBLE") for o, b in enumerate(bias))
    return f"""{name}_n AS (SELECT e.station, e.source AS node, d, {agg} AS v FROM ordered_edges e
  JOIN {source} f ON f.station = e.station AND f.node = e.target GROUP BY e.station, e.source, d),
{name}_c AS (SELECT station, node, d, v FROM {source}
  UNION ALL SELECT f.station, f.node, f.d + {width}, coalesce(n.v, 0) FROM {source} f
  LEFT JOIN {name}_n n ON n.station = f.station AND n.node = f.node AND n.d = f.d),
{_linear_sql(name + "_w", name + "_c", weights)},
{name} AS (SELECT station, node, d, v + b AS v FROM {name}_w JOIN (VALUES {offsets}) t(o, b) ON t.o = d)"""


def _ordered(base: str, directed: bool) -> str:
    sides = "SELECT station, source, target, weight FROM edges"
    if not directed:
        sides += " UNION ALL SELECT station, target, source, weight FROM edges"
    return f"{base},\nordered_edges AS ({sides}), {QUANTILES_SQL}"


def _vector_sql(name: str, width: int) -> str:
    return f"SELECT station, node, " + ", ".join(
        f"round(max(v) FILTER (WHERE d = {d}), 6) + 0.0 AS z{d}" for d in range(width)
    ) + f" FROM {name} GROUP BY station, node"


def _vector_out(features, width):
    return features.select("station", "node", *[rounded(F.col("h")[d]).alias(f"z{d}") for d in range(width)])


def _run_edges(spark, sf_dir, graph_type):
    _, edges = line_graph(spark, sf_dir, graph_type)
    return graphs.endpoints(edges).select("station", F.col("graph_type").alias("run"), "source", "target", "weight")


def _elu_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT station, node, d, CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END AS v FROM {source})"


def _relu_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT station, node, d, greatest(v, 0) AS v FROM {source})"


ATT_1 = (fixed_matrix(HIDDEN, WIDTH), fixed_vector(HIDDEN, 0), fixed_vector(HIDDEN, 1))
ATT_2 = (fixed_matrix(OUT, HIDDEN), fixed_vector(OUT, 1), fixed_vector(OUT, 2))
SAGE_1 = (fixed_matrix(HIDDEN, 2 * WIDTH), fixed_vector(HIDDEN, 1))
SAGE_2 = (fixed_matrix(OUT, 2 * HIDDEN), fixed_vector(OUT, 0))

for _type, _base, _directed in (("correlation", CORR_EDGES_SQL, False), ("top_k", DIRECTED_SQL, True)):
    _start = _ordered(_base, _directed)

    @query(f"attention_layer_{_type}",
           f"WITH {_start}, {_attention_sql('h1', 'h0', *ATT_1)} {_vector_sql('h1', HIDDEN)}")
    def attention_layer(spark, sf_dir, t=_type):
        out = layers.attention_layer(quantile_features(spark, sf_dir, t), _run_edges(spark, sf_dir, t), *ATT_1, HIDDEN)
        return _vector_out(out, HIDDEN)

    @query(f"mean_layer_{_type}",
           f"WITH {_start}, {_mean_sql('h1', 'h0', *SAGE_1, WIDTH)} {_vector_sql('h1', HIDDEN)}")
    def mean_layer(spark, sf_dir, t=_type):
        out = layers.sampled_layer(quantile_features(spark, sf_dir, t), _run_edges(spark, sf_dir, t), *SAGE_1, WIDTH)
        return _vector_out(out, HIDDEN)

    @query(f"max_layer_{_type}",
           f"WITH {_start}, {_mean_sql('h1', 'h0', *SAGE_1, WIDTH, 'max')} {_vector_sql('h1', HIDDEN)}")
    def max_layer(spark, sf_dir, t=_type):
        out = layers.sampled_layer(quantile_features(spark, sf_dir, t), _run_edges(spark, sf_dir, t), *SAGE_1, WIDTH,
                                   "max")
        return _vector_out(out, HIDDEN)

    @query(f"attention_model_{_type}",
           f"WITH {_start}, {_attention_sql('h1', 'h0', *ATT_1)}, {_elu_sql('r1', 'h1')}, "
           f"{_attention_sql('h2', 'r1', *ATT_2)} {_vector_sql('h2', OUT)}")
    def attention_model(spark, sf_dir, t=_type):
        steps = [dict(zip(("weights", "a_src", "a_dst"), a)) for a in (ATT_1, ATT_2)]
        out = layers.attention_model(quantile_features(spark, sf_dir, t), _run_edges(spark, sf_dir, t), steps)
        return _vector_out(out, OUT)

    @query(f"mean_model_{_type}",
           f"WITH {_start}, {_mean_sql('h1', 'h0', *SAGE_1, WIDTH)}, {_relu_sql('r1', 'h1')}, "
           f"{_mean_sql('h2', 'r1', *SAGE_2, HIDDEN)} {_vector_sql('h2', OUT)}")
    def mean_model(spark, sf_dir, t=_type):
        steps = [dict(zip(("weights", "bias"), a)) for a in (SAGE_1, SAGE_2)]
        out = layers.sampled_model(quantile_features(spark, sf_dir, t), _run_edges(spark, sf_dir, t), steps, WIDTH)
        return _vector_out(out, OUT)


# ------------------------------------------------- quality of given embeddings

LABEL_SQL = """
e AS (SELECT label::VARCHAR AS station, vec_id, embedding FROM embeddings),
cells AS (SELECT station, vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS v FROM e)"""


def labelled_vectors(spark, sf_dir):
    """The embedding table as runs: one per label, vectors as nodes."""
    return inputs.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("station"), F.lit("given").alias("run"),
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("node"),
        F.col("embedding").cast("array<double>").alias("embedding"))


def dimension_vectors(spark, sf_dir):
    """Columns as nodes: each event type's user profile of mean, spread and range."""
    q = exact_percentiles(inputs.user_days(spark, sf_dir), EVENT_COLS, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9])
    return q.select("station", F.lit("given").alias("run"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("node"), F.col(c).alias("embedding")) for c in EVENT_COLS])))


DIMENSION_SQL = inputs.USER_DAYS_SQL + """,
cells AS (""" + " UNION ALL ".join(
    f"SELECT station, '{c}' AS node, {d} AS d, quantile_cont({c}, {p}) AS v FROM user_days GROUP BY station"
    for c in EVENT_COLS for d, p in enumerate((0.0, 0.1, 0.25, 0.5, 0.75, 0.9))) + ")"


@query("embedding_quality", f"""WITH {DIMENSION_SQL},
dist AS (SELECT a.station, a.node AS s, b.node AS t, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS distance
  FROM cells a JOIN cells b ON a.station = b.station AND a.d = b.d AND a.node < b.node
  GROUP BY a.station, a.node, b.node),
dims AS (SELECT station, d, var_pop(v) AS variance, count(*) AS n, count(*) FILTER (WHERE abs(v) < 1e-3) AS small
  FROM cells GROUP BY station, d)
SELECT x.*, round(y.avg_d, 6) + 0.0 AS avg_pairwise_distance, round(y.std_d, 6) + 0.0 AS std_pairwise_distance FROM (
  SELECT station, max(n) AS node_count, count(*) AS dimension, round(avg(variance), 6) + 0.0 AS dimension_variance,
         round(sum(small) / sum(n), 6) + 0.0 AS sparsity FROM dims GROUP BY station) x
JOIN (SELECT station, avg(distance) AS avg_d, stddev_pop(distance) AS std_d FROM dist GROUP BY station) y USING (station)""")
def embedding_quality(spark, sf_dir):
    out = quality.embedding_quality(dimension_vectors(spark, sf_dir))
    return out.select("station", "node_count", "dimension", *[rounded(F.col(c)).alias(c) for c in (
        "avg_pairwise_distance", "std_pairwise_distance", "dimension_variance", "sparsity")])


@query("embedding_health", f"""WITH {LABEL_SQL},
s AS (SELECT station, d, stddev_pop(v) AS std, bool_or(v IS NULL OR isnan(v) OR isinf(v)) AS bad
      FROM cells GROUP BY station, d)
SELECT station, CASE WHEN NOT bool_or(bad) AND max(std) < 1e-4 THEN 'Collapsed (Zero Variance)'
  WHEN bool_or(bad) THEN 'NaNs present (cleared)' ELSE 'Stable' END AS validation FROM s GROUP BY station""")
def embedding_health(spark, sf_dir):
    return quality.embedding_health(labelled_vectors(spark, sf_dir)).select("station", "validation")


@query("reconstruction_loss", f"""WITH {LABEL_SQL},
m AS (SELECT station, d, avg(v) AS m FROM cells GROUP BY station, d)
SELECT station, round(avg((v - m) * (v - m)), 8) + 0.0 AS loss FROM cells JOIN m USING (station, d) GROUP BY station""")
def reconstruction_loss(spark, sf_dir):
    """Loss of restoring every vector by the mean vector of its label."""
    rows = labelled_vectors(spark, sf_dir)
    means = rows.groupBy("station").agg(F.array(*[F.avg(F.col("embedding")[d]) for d in range(64)]).alias("x_hat"))
    out = quality.reconstruction_loss(rows.join(means, "station").withColumnRenamed("embedding", "x"))
    return out.select("station", rounded(F.col("loss"), 8).alias("loss"))


# --------------------------------------------------- numeric jobs without SQL

def line_feature_table(rows):
    """Every line feature as a node of every station."""
    return rows.select("station").distinct().select("station", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("idx")) for i, c in enumerate(LINE_COLS)])))


@query("isolation_forest_scores")
def isolation_forest_scores(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("station"), F.col("o_orderkey").alias("row_id"),
        "o_totalprice", F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("day"))
    return iforest.anomaly_scores(rows, ["o_totalprice", "day"], iforest.grow_forest(rows, ["o_totalprice", "day"]))


@query("isolation_forest_treatment")
def isolation_forest_treatment(spark, sf_dir):
    treated, _ = iforest.treat_by_forest(inputs.event_values(spark, sf_dir), ["value"], "clip")
    return treated.select("station", "row_id", "value")
