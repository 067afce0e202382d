"""Message passing over edge tables.

Node features are ``(station, run, node, h ARRAY<DOUBLE>)`` and edges are ordered
``(station, run, source, target, weight)``: ``source`` receives from ``target``.
Width is a parameter, so neighbour sums are one aggregate per dimension and no
array is ever exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colweave.functions.vectors import elu, leaky_relu, linear, literal_vector, dot, relu

RUN_KEYS = ["station", "run"]
Matrix = Sequence[Sequence[float]]


def _messages(features: DataFrame, edges: DataFrame, name: str = "far") -> DataFrame:
    """Each edge with the feature of its far end."""
    far = features.select(*RUN_KEYS, F.col("node").alias("target"), F.col("h").alias(name))
    return edges.select(*RUN_KEYS, "source", "target", "weight").join(far, [*RUN_KEYS, "target"])


def _by_dimension(width: int, value) -> Column:
    return F.array(*[value(d) for d in range(width)])


def attention_layer(features: DataFrame, edges: DataFrame, weights: Matrix | None, a_src: Sequence[float],
                    a_dst: Sequence[float], width: int) -> DataFrame:
    """Softmax-weighted neighbour sum, self included.

    The logit of an edge is ``LeakyReLU(a_src.h_i + a_dst.h_j + sign(w) log(1+|w|))``;
    a self loop has no edge term.  Returns ``(station, run, node, h)``.
    """
    projected = features if weights is None else features.withColumn("h", linear(F.col("h"), weights))
    scored = projected.select(*RUN_KEYS, "node", "h", dot(F.col("h"), literal_vector(a_src)).alias("out"),
                              dot(F.col("h"), literal_vector(a_dst)).alias("in"))
    loops = scored.select(*RUN_KEYS, F.col("node").alias("source"), F.col("node").alias("target"),
                          F.lit(0.0).alias("weight"))
    linked = (edges.where("weight <> 0 and source <> target")
              .select(*RUN_KEYS, "source", "target", "weight").unionByName(loops))
    near = scored.select(*RUN_KEYS, F.col("node").alias("source"), "out")
    far = scored.select(*RUN_KEYS, F.col("node").alias("target"), F.col("h").alias("far"), "in")
    bias = F.signum("weight") * F.log1p(F.abs("weight"))
    logits = (linked.join(near, [*RUN_KEYS, "source"]).join(far, [*RUN_KEYS, "target"])
              .withColumn("logit", leaky_relu(F.col("out") + F.col("in") + bias)))
    group = Window.partitionBy(*RUN_KEYS, "source")
    raised = logits.withColumn("up", F.exp(F.col("logit") - F.max("logit").over(group)))
    mixed = _by_dimension(width, lambda d: F.sum(F.col("up") * F.col("far")[d]) / F.sum("up"))
    return raised.groupBy(*RUN_KEYS, F.col("source").alias("node")).agg(mixed.alias("h"))


def neighbour_mean(features: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """``sum(w h) / max(sum|w|, 1)`` over neighbours; zeros for a node without any."""
    total = F.greatest(F.sum(F.abs("weight")), F.lit(1.0))
    mean = _by_dimension(width, lambda d: F.sum(F.col("weight") * F.col("far")[d]) / total)
    return _with_nodes(features, _messages(features, edges).groupBy(
        *RUN_KEYS, F.col("source").alias("node")).agg(mean.alias("near")), width)


def neighbour_max(features: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """Largest ``w h`` per dimension over neighbours; zeros for a node without any."""
    top = _by_dimension(width, lambda d: F.max(F.col("weight") * F.col("far")[d]))
    linked = edges.where("weight <> 0")
    return _with_nodes(features, _messages(features, linked).groupBy(
        *RUN_KEYS, F.col("source").alias("node")).agg(top.alias("near")), width)


def _with_nodes(features: DataFrame, near: DataFrame, width: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), width)
    return features.select(*RUN_KEYS, "node", "h").join(near, [*RUN_KEYS, "node"], "left").withColumn(
        "near", F.coalesce("near", zeros))


AGGREGATORS = {"mean": neighbour_mean, "max": neighbour_max}


def sampled_layer(features: DataFrame, edges: DataFrame, weights: Matrix | None, bias: Sequence[float] | None,
                  width: int, aggregator: str = "mean") -> DataFrame:
    """Own feature and aggregated neighbours side by side, then a linear map.

    Without ``weights`` the two halves are returned as they are.
    """
    if aggregator not in AGGREGATORS:
        raise ValueError(f"Unknown aggregator type: {aggregator}")
    joined = AGGREGATORS[aggregator](features, edges, width).withColumn("h", F.concat("h", "near"))
    mapped = F.col("h") if weights is None else linear(F.col("h"), weights, bias)
    return joined.select(*RUN_KEYS, "node", mapped.alias("h"))


def activate(features: DataFrame, kind: str) -> DataFrame:
    act = {"elu": elu, "relu": relu}[kind]
    return features.withColumn("h", F.transform("h", act))


def attention_model(features: DataFrame, edges: DataFrame, layers: list[dict]) -> DataFrame:
    """Attention, ELU, attention in evaluation mode.

    Each layer is ``{"weights", "a_src", "a_dst"}``.
    """
    def one(state: DataFrame, layer: dict) -> DataFrame:
        return attention_layer(state, edges, layer["weights"], layer["a_src"], layer["a_dst"], len(layer["weights"]))

    first, second = layers
    return one(activate(one(features, first), "elu"), second)


def sampled_model(features: DataFrame, edges: DataFrame, layers: list[dict], width: int,
                  aggregator: str = "mean") -> DataFrame:
    """Aggregate and map, ReLU, aggregate and map.  Each layer is ``{"weights", "bias"}``."""
    first, second = layers
    hidden = activate(sampled_layer(features, edges, first["weights"], first["bias"], width, aggregator), "relu")
    return sampled_layer(hidden, edges, second["weights"], second["bias"], len(first["weights"]), aggregator)
