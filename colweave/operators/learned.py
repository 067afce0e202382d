"""Learned sparse adjacency from the Gram matrix of a station.

The rows are read once, by Spark, into the N x N inner products S.  The loss
``|XA - X|^2 / (B N) + l1 * sum|A|`` depends on X only through S, so the descent
runs on N x N numbers per station, independent of the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.operators.graphs import WEAK_EDGE
from colweave.session import ready_workers

L1_PENALTY = 0.005
# Fixed: keeps the inverse tanh of a correlation of 1 finite.
ATANH_MARGIN = 1e-4
# Fixed Adam constants (Kingma and Ba).
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8


def descend(gram: np.ndarray, corr: np.ndarray, rows: float, epochs: int, lr: float,
            weight_decay: float, l1_penalty: float) -> np.ndarray:
    """Best symmetric adjacency with zero diagonal found by Adam."""
    n = len(gram)
    off = 1.0 - np.eye(n)
    raw = np.arctanh(np.clip(corr * off, ATANH_MARGIN - 1, 1 - ATANH_MARGIN))
    best, best_loss = corr * off, np.inf
    first, second = np.zeros_like(raw), np.zeros_like(raw)
    scale = rows * n
    for step in range(1, epochs + 1):
        tanh = np.tanh((raw + raw.T) / 2)
        adj = tanh * off
        miss = adj - np.eye(n)
        pull = gram @ miss
        loss = np.sum(miss * pull) / scale + l1_penalty * np.abs(adj).sum()
        if not np.isfinite(loss):
            break
        if loss < best_loss:
            best, best_loss = adj, loss
        slope = (2 * pull / scale + l1_penalty * np.sign(adj)) * off * (1 - tanh ** 2)
        slope = (slope + slope.T) / 2 + weight_decay * raw
        first = BETA_1 * first + (1 - BETA_1) * slope
        second = BETA_2 * second + (1 - BETA_2) * slope ** 2
        raw = raw - lr * (first / (1 - BETA_1 ** step)) / (np.sqrt(second / (1 - BETA_2 ** step)) + EPSILON)
    return best


def _learner(cols: list[str], epochs: int, lr: float, weight_decay: float, l1_penalty: float):
    n = len(cols)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        gram, corr = np.zeros((n, n)), np.zeros((n, n))
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        gram[i, j] = gram[j, i] = pdf["g"].to_numpy()
        corr[i, j] = corr[j, i] = pdf["r"].to_numpy()
        # Only this station's features take part.
        used = np.unique(np.concatenate([i, j]))
        adj = descend(gram[np.ix_(used, used)], corr[np.ix_(used, used)], float(pdf["rows"].iloc[0]),
                      epochs, lr, weight_decay, l1_penalty)
        a, b = np.triu_indices(len(used), 1)
        return pd.DataFrame({"station": pdf["station"].iloc[0], "source": [cols[used[k]] for k in a],
                             "target": [cols[used[k]] for k in b], "weight": adj[a, b]})

    return learn


def learned_graph(grams: DataFrame, pairs: DataFrame, counts: DataFrame, cols: list[str], epochs: int = 150,
                  lr: float = 0.01, weight_decay: float = 1e-4, l1_penalty: float = L1_PENALTY) -> DataFrame:
    """Undirected edges of the learned adjacency, weak ones removed.

    ``grams(station,i,j,g)``, ``pairs(station,i,j,r)`` and ``counts(station,rows)``
    are all N x N or smaller; each station is one group.
    """
    cells = (grams.select("station", "i", "j", "g")
             .join(pairs.select("station", "i", "j", "r"), ["station", "i", "j"], "left")
             .join(counts.select("station", "rows"), "station")
             .select("station", "i", "j", F.coalesce("g", F.lit(0.0)).alias("g"),
                     F.coalesce("r", F.lit(0.0)).alias("r"), "rows"))
    learned = ready_workers(cells).groupBy("station").applyInPandas(
        _learner(cols, epochs, lr, weight_decay, l1_penalty),
        "station string, source string, target string, weight double")
    return learned.where(F.abs("weight") >= WEAK_EDGE).select(
        "station", F.lit("learnable").alias("graph_type"), "source", "target", "weight", F.lit(False).alias("directed"))
