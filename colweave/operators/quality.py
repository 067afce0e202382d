"""Quality of node embeddings ``(station, run, node, embedding)`` and their 2-D projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.operators.layers import RUN_KEYS
from colweave.session import ready_workers

SMALL_VALUE = 1e-3
COLLAPSED_STD = 1e-4
# Vectors of a block, and numbers that a task holds of a tile at once.
PAIR_BLOCK = 1024
TILE_CELLS = 2_000_000


def _joined_spread(a: tuple, b: tuple) -> tuple:
    """Count, mean and squared deviations of two lots together."""
    n = a[0] + b[0]
    if not n:
        return a
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def _tile_spread(pdf: pd.DataFrame, inner: bool) -> tuple:
    """Spread of the distances between two blocks of vectors, or within one, a few rows at a time."""
    vectors = np.vstack(pdf["embedding"].to_numpy()).astype(float)
    upper = pdf["upper"].to_numpy(dtype=bool)
    left, right = (vectors, vectors) if inner else (vectors[~upper], vectors[upper])
    step = max(1, TILE_CELLS // max(1, right.size))
    found = (0, 0.0, 0.0)
    for low in range(0, len(left), step):
        some = left[low:low + step]
        cells = np.sqrt(((some[:, None, :] - right[None, :, :]) ** 2).sum(axis=2))
        if inner:
            values = cells[np.arange(len(right))[None, :] > np.arange(low, low + len(some))[:, None]]
        else:
            values = cells.ravel()
        if len(values):
            mean = values.mean()
            found = _joined_spread(found, (len(values), mean, ((values - mean) ** 2).sum()))
    return found


def distance_spread(embeddings: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Mean and deviation of the distances of all unordered node pairs of a run.

    The nodes of a run fall into blocks by their hash, every two blocks meet in a task of
    their own, and only the count, mean and squared deviations of that tile leave it: no row
    per pair.  A vector travels once per block of its run.  Nodes with a NULL in their vector
    take no part; vectors of different sizes have no distance.  ``(keys,
    avg_pairwise_distance, std_pairwise_distance)``; runs without any pair have no row.
    """
    whole = embeddings.where(~F.exists("embedding", lambda v: v.isNull())).select(
        *RUN_KEYS, F.size("embedding").alias("dims"), "node", "embedding")
    sizes = whole.groupBy(*RUN_KEYS, "dims").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    placed = (whole.join(sizes, [*RUN_KEYS, "dims"])
              .withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    dealt = placed.select(*RUN_KEYS, "dims", F.least("at", "other").alias("first"), F.greatest("at", "other").alias("second"),
                          (F.col("at") > F.col("other")).alias("upper"), "embedding")

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, squares = _tile_spread(pdf, key[3] == key[4])
        return pd.DataFrame({**{k: [v] for k, v in zip(RUN_KEYS, key)}, "n": [n], "mean": [mean], "squares": [squares]})

    kinds = ", ".join(f"{k} {embeddings.schema[k].dataType.simpleString()}" for k in RUN_KEYS)
    tiles = (ready_workers(dealt).groupBy(*RUN_KEYS, "dims", "first", "second")
             .applyInPandas(tile, f"{kinds}, n long, mean double, squares double").where("n > 0")
             # Arrow makes NULL of NaN.
             .fillna(float("nan"), ["mean", "squares"]))
    run = Window.partitionBy(*RUN_KEYS)
    centre = F.sum(F.col("n") * F.col("mean")).over(run) / F.sum("n").over(run)
    between = F.col("n") * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))
    return tiles.withColumn("centre", centre).groupBy(*RUN_KEYS).agg(
        F.max("centre").alias("avg_pairwise_distance"),
        F.sqrt(F.sum(F.col("squares") + between) / F.sum("n")).alias("std_pairwise_distance"))


def dimension_stats(embeddings: DataFrame) -> DataFrame:
    cells = embeddings.select(*RUN_KEYS, F.posexplode("embedding").alias("dim", "v"))
    return cells.groupBy(*RUN_KEYS, "dim").agg(
        F.var_pop("v").alias("variance"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.abs("v") < SMALL_VALUE, 1)).alias("small"))


def embedding_quality(embeddings: DataFrame) -> DataFrame:
    """Node count, dimension, distance mean and deviation, mean variance and sparsity per run.

    Runs of a single node are left out.
    """
    spread = distance_spread(embeddings)
    dims = dimension_stats(embeddings).groupBy(*RUN_KEYS).agg(
        F.max("n").alias("node_count"), F.count(F.lit(1)).alias("dimension"),
        F.avg("variance").alias("dimension_variance"), (F.sum("small") / F.sum("n")).alias("sparsity"))
    return dims.join(spread, RUN_KEYS).select(
        *RUN_KEYS, "node_count", "dimension", "avg_pairwise_distance", "std_pairwise_distance",
        "dimension_variance", "sparsity")


def embedding_health(embeddings: DataFrame) -> DataFrame:
    """``Stable``, or why not: collapsed to a point, or holding values that are not finite."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    broken = embeddings.groupBy(*RUN_KEYS).agg(F.bool_or(bad).alias("broken"))
    flat = dimension_stats(embeddings).groupBy(*RUN_KEYS).agg(F.max("std").alias("widest"))
    collapsed = F.col("widest") < COLLAPSED_STD
    return broken.join(flat, RUN_KEYS).select(
        *RUN_KEYS, F.when(~F.col("broken") & collapsed, "Collapsed (Zero Variance)")
        .when(F.col("broken"), "NaNs present (cleared)").otherwise("Stable").alias("validation"))


def clear_not_finite(embeddings: DataFrame) -> DataFrame:
    ok = F.transform("embedding", lambda v: F.when(
        v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), 0.0).otherwise(v))
    return embeddings.withColumn("embedding", ok)


def reconstruction_loss(pairs: DataFrame) -> DataFrame:
    """Mean squared difference of ``x`` and ``x_hat`` arrays per run."""
    cells = pairs.select(*RUN_KEYS, F.inline(F.arrays_zip("x", "x_hat")))
    return cells.groupBy(*RUN_KEYS).agg(F.avg((F.col("x") - F.col("x_hat")) * (F.col("x") - F.col("x_hat"))).alias("loss"))


def principal_axes(x: np.ndarray, wanted: int) -> np.ndarray:
    """Scores of centred rows on the leading axes; each axis points to its largest loading."""
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:wanted]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return centred @ (axes * np.where(signs == 0, 1.0, signs)[:, None]).T


def _project(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node", kind="stable")
    x = np.vstack(pdf["embedding"].to_numpy())
    scores = principal_axes(x, min(2, x.shape[1], len(x) - 1)) if len(x) > 1 else np.zeros((len(x), 0))
    flat = np.zeros((len(x), 2))
    flat[:, :scores.shape[1]] = scores
    return pd.DataFrame({"station": pdf["station"], "run": pdf["run"], "node": pdf["node"],
                         "x": flat[:, 0], "y": flat[:, 1]})


def project_2d(embeddings: DataFrame) -> DataFrame:
    """First two principal coordinates of a run's nodes, padded with zeros.

    A group is one run: as many short vectors as the table has feature columns.
    """
    return ready_workers(embeddings).select(*RUN_KEYS, "node", "embedding").groupBy(*RUN_KEYS).applyInPandas(
        _project, "station string, run string, node string, x double, y double").withColumn("method", F.lit("PCA"))
