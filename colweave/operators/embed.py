"""Node features and node embeddings in closed form.

Nodes are columns.  Their raw features are as long as the table, so the reduction
uses the dual form: the N x N inner products that Spark adds up in one scan,
centred both ways, are the inner products of row-centred columns, and each
station's small matrix gives the principal scores.  No row sampling is needed.  Embeddings then spread these scores over two hops of
each graph and keep the leading axes, which are scored by how well a linear
decoder restores the features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.operators import quality
from colweave.operators.graphs import endpoints
from colweave.operators.layers import RUN_KEYS, attention_layer, sampled_layer
from colweave.session import materialise, ready_workers

# Leading axes of a node's features, if the settings name no other number.
MAX_FEATURE_DIM = 32
MIN_NODES = 3
MODELS = ("GAT", "GraphSAGE")


def _feature_helper(cols: list[str], width: int, limit: int):
    def scores(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        used = np.unique(np.concatenate([i, j]))
        size = len(used)
        gram = np.zeros((len(cols), len(cols)))
        gram[i, j] = gram[j, i] = pdf["g"].to_numpy()
        centre = np.eye(size) - 1.0 / size
        values, vectors = np.linalg.eigh(centre @ gram[np.ix_(used, used)] @ centre)
        keep = min(size - 1, int(pdf["rows"].iloc[0]), limit)
        top = np.argsort(values)[::-1][:keep]
        x = vectors[:, top] * np.sqrt(np.maximum(values[top], 0.0))
        signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])]) if x.size else np.ones(x.shape[1])
        padded = np.zeros((size, width))
        padded[:, :x.shape[1]] = x * np.where(signs == 0, 1.0, signs)
        return pd.DataFrame({"station": pdf["station"].iloc[0], "node": [cols[k] for k in used], "h": list(padded)})

    return scores


def feature_width(cols: list[str], limit: int = MAX_FEATURE_DIM) -> int:
    return max(1, min(len(cols) - 1, limit))


def node_features(grams: DataFrame, features: DataFrame, counts: DataFrame, cols: list[str],
                  limit: int = MAX_FEATURE_DIM) -> DataFrame:
    """Principal scores of every node: ``(station, node, h)``, at most ``limit`` axes.

    ``grams(station,i,j,g)`` are inner products of the scaled columns and
    ``features(station, column, idx)`` lists each station's nodes; other columns
    are ignored.  Vectors are padded with zeros to one width.
    """
    own = features.select("station", F.col("idx").alias("i"))
    kept = (grams.select("station", "i", "j", "g").join(own, ["station", "i"], "left_semi")
            .join(own.withColumnRenamed("i", "j"), ["station", "j"], "left_semi")
            .join(counts.select("station", "rows"), "station"))
    return ready_workers(kept).groupBy("station").applyInPandas(
        _feature_helper(cols, feature_width(cols, limit), limit), "station string, node string, h array<double>")


def run_name(graph_type, model: str):
    return F.concat(graph_type, F.lit(f"_{model}"))


def _reduce_helper(embed_dim: int):
    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        spread, x = np.vstack(pdf["h"].to_numpy()), np.vstack(pdf["x"].to_numpy())
        size = len(x)
        dim = embed_dim if size >= embed_dim else max(2, size - 1)
        ok = np.isfinite(spread).all()
        z = np.zeros((size, dim))
        if ok:
            axes = quality.principal_axes(spread, min(dim, spread.shape[1], size - 1))
            z[:, :axes.shape[1]] = axes
        basis = np.hstack([z, np.ones((size, 1))])
        weights, *_ = np.linalg.lstsq(basis, x, rcond=None)
        return pd.DataFrame({"station": pdf["station"], "run": pdf["run"], "node": pdf["node"],
                             "embedding": list(z), "x": list(x), "x_hat": list(basis @ weights)})

    return shrink


def embedding_runs(features: DataFrame, edges: DataFrame, width: int, embed_dim: int = 8) -> DataFrame:
    """Embeddings of every station, graph type and model.

    ``features(station, node, h)``; stations with fewer than three nodes are left
    out.  Returns ``(station, run, node, embedding, x, x_hat)``.
    """
    sizes = features.groupBy("station").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_NODES)
    features = materialise(features.join(sizes.select("station"), "station", "left_semi"))
    types = edges.select("station", "graph_type").distinct()
    ordered = materialise(endpoints(edges).select("station", "graph_type", "source", "target", "weight"))
    parts = []
    for model in MODELS:
        name = run_name(F.col("graph_type"), model)
        start = features.join(types, "station").select("station", name.alias("run"), "node", "h")
        links = ordered.select("station", name.alias("run"), "source", "target", "weight")
        if model == "GAT":
            zeros = [0.0] * width
            one = attention_layer(start, links, None, zeros, zeros, width)
            two = attention_layer(one, links, None, zeros, zeros, width)
        else:
            one = sampled_layer(start, links, None, None, width)
            two = sampled_layer(one, links, None, None, 2 * width)
        parts.append(two.join(start.withColumnRenamed("h", "x"), [*RUN_KEYS, "node"]))
    both = parts[0].unionByName(parts[1])
    return ready_workers(both).groupBy(*RUN_KEYS).applyInPandas(
        _reduce_helper(embed_dim),
        "station string, run string, node string, embedding array<double>, x array<double>, x_hat array<double>")


def run_reports(runs: DataFrame) -> DataFrame:
    """Loss and health of every run; a collapsed run or one without a finite loss has failed."""
    loss = quality.reconstruction_loss(runs)
    health = quality.embedding_health(runs)
    failed = (F.col("validation") == "Collapsed (Zero Variance)") | F.col("loss").isNull() | F.isnan("loss")
    return health.join(loss, RUN_KEYS, "left").select(
        *RUN_KEYS, F.regexp_replace("run", "_(GAT|GraphSAGE)$", "").alias("graph_type"),
        F.regexp_extract("run", "_(GAT|GraphSAGE)$", 1).alias("model_name"),
        F.when(~failed, F.col("loss")).alias("final_loss"),
        F.when(failed, "Failed").otherwise(F.col("validation")).alias("validation"))


def stored_embeddings(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Embeddings of the runs that did not fail."""
    good = reports.where("validation <> 'Failed'").select(*RUN_KEYS)
    return quality.clear_not_finite(runs.select(*RUN_KEYS, "node", "embedding")).join(good, RUN_KEYS, "left_semi")
