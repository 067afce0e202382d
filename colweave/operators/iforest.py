"""Isolation forest (Liu, Ting and Zhou 2008) as Spark jobs.

Rows are sampled by hash, each tree is grown by its own task from at most 256
rows, and all rows are scored in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from colweave.functions.stats import clamp, join_station
from colweave.operators.quantiles import exact_percentiles
from colweave.session import GROUP_ROW_LIMIT, materialise, ready_workers

TREES = 100
TREE_ROWS = 256
DEPTH = math.ceil(math.log2(TREE_ROWS))
ANOMALY_SCORE = 0.5
# Rows offered to every tree, so that it finds its 256 whatever the hash gives.
OFFERED_ROWS = TREE_ROWS + 10 * math.isqrt(TREE_ROWS)
# Tree nodes that may be sent to every task; beyond, rows meet their forest by key.
BROADCAST_NODES = 600_000
# Rows of one scoring group in that case.
SCORE_ROWS = 200_000
# The key under which rows without a station meet their trees.
NO_STATION = "\u0001"
EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = ("station string, tree int, id int, feature int, split double, child int, length double, sampled int")


def mean_depth(n):
    """Mean path length of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def _unit(*cols):
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def _value(c: str):
    """A column that is absent in a station is constant there and never splits."""
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _key():
    return F.coalesce(F.col("station").cast("string"), F.lit(NO_STATION))


def _samples(df: DataFrame, cols: list[str], seed: int) -> DataFrame:
    """``(station, tree, x)``: up to 256 rows for every tree, drawn by hash from all rows of the station."""
    counts = materialise(df.groupBy("station").agg(F.count(F.lit(1)).alias("_n")))
    rows = df.select("station", "row_id", F.array(*[_value(c) for c in cols]).alias("x"))
    rows = join_station(rows, counts)
    # A row of a small station meets every tree.  Otherwise it has a few slots, mostly one, and
    # each slot leads to some tree with the chance that offers every tree enough rows.
    slots = F.ceil(TREES * OFFERED_ROWS / F.col("_n")).cast("int")
    chance = TREES * OFFERED_ROWS / (F.col("_n") * slots)
    drawn = F.transform(
        F.filter(F.sequence(F.lit(1), slots), lambda j: _unit(F.col("row_id"), j, F.lit(seed)) < chance),
        lambda j: F.pmod(F.xxhash64(F.col("row_id"), j, F.lit(seed + 1)), F.lit(TREES)).cast("int"))
    trees = F.when(F.col("_n") <= 4 * TREE_ROWS, F.sequence(F.lit(0), F.lit(TREES - 1))).otherwise(F.array_distinct(drawn))
    dealt = rows.withColumn("tree", F.explode(trees)).withColumn(
        "_u", _unit(F.col("row_id"), F.col("tree"), F.lit(seed + 2)))
    rank = Window.partitionBy("station", "tree").orderBy("_u", "row_id")
    return (dealt.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= TREE_ROWS)
            .select("station", "tree", "x"))


def _grow(seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.vstack(pdf["x"].to_numpy())
        x = x[np.lexsort(x.T[::-1])]
        found: list[list] = []
        todo = [(0, np.arange(len(x)), 0)]
        nodes: dict[int, list] = {0: None}
        while todo:
            place, rows, depth = todo.pop()
            part = x[rows]
            wide = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
            if depth >= DEPTH or len(rows) <= 1 or len(wide) == 0:
                nodes[place] = [-1, 0.0, -1, depth + float(mean_depth(len(rows)))]
                continue
            feature = int(rng.choice(wide))
            low, high = part[:, feature].min(), part[:, feature].max()
            split = float(rng.uniform(low, high))
            left = part[:, feature] <= split
            child = len(nodes)
            # Children sit next to each other.
            nodes[child] = nodes[child + 1] = None
            nodes[place] = [feature, split, child, 0.0]
            todo += [(child, rows[left], depth + 1), (child + 1, rows[~left], depth + 1)]
        for place in sorted(nodes):
            found.append([pdf["station"].iloc[0], tree, place, *nodes[place], len(x)])
        return pd.DataFrame(found, columns=["station", "tree", "id", "feature", "split", "child", "length", "sampled"])

    return grow


def grow_forest(df: DataFrame, cols: list[str], seed: int = 42) -> DataFrame:
    """Tree nodes of every station's forest: ``NODE_SCHEMA``, at most 511 per tree."""
    # A stated partition count: the groups are tiny but growing a tree takes time.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _samples(ready_workers(df), cols, seed).repartition(tasks, "station", "tree")
    return dealt.groupBy("station", "tree").applyInPandas(_grow(seed), NODE_SCHEMA)


def _packed(nodes: pd.DataFrame) -> tuple:
    """A station's trees as flat arrays; a leaf leads to itself."""
    nodes = nodes.sort_values(["tree", "id"])
    sizes = nodes.groupby("tree", sort=True).size().to_numpy()
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    leaf = nodes["feature"].to_numpy() < 0
    child = np.where(leaf, np.arange(len(nodes)), nodes["child"].to_numpy() + np.repeat(roots, sizes))
    split = np.where(leaf, np.inf, nodes["split"].to_numpy())
    scale = float(mean_depth(int(nodes["sampled"].max())))
    return (roots, np.maximum(nodes["feature"].to_numpy(), 0), split, child, nodes["length"].to_numpy(),
            scale if scale > 0 else 1.0)


def _scores(x: np.ndarray, trees: tuple) -> np.ndarray:
    roots, feature, split, child, length, scale = trees
    at = np.broadcast_to(roots, (len(x), len(roots)))
    rows = np.arange(len(x))[:, None]
    for _ in range(DEPTH):
        at = child[at] + (x[rows, feature[at]] > split[at])
    return np.power(2.0, -length[at].mean(axis=1) / scale)


def with_scores(df: DataFrame, cols: list[str], forest: DataFrame,
                broadcast_nodes: int = BROADCAST_NODES, out: str = "_score") -> DataFrame:
    """``df`` with the anomaly score of each row; scores above 0.5 are outliers.

    A forest of up to ``broadcast_nodes`` nodes is sent to every task and rows stay
    where they are; beyond, rows and their station's trees meet by (station, part).
    A station without trees scores 0.0.
    """
    forest = materialise(ready_workers(forest))
    if forest.count() <= broadcast_nodes:
        table = {key: _packed(part) for key, part in forest.withColumn("station", _key()).toPandas().groupby("station")}
        shared = df.sparkSession.sparkContext.broadcast(table)

        @F.pandas_udf("double")
        def score(station: pd.Series, *values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(np.float64) for v in values])
            scores = np.zeros(len(x))
            for key, at in station.groupby(station).indices.items():
                if key in shared.value:
                    scores[at] = _scores(x[at], shared.value[key])
            return pd.Series(scores)

        return df.withColumn(out, score(_key(), *[_value(c) for c in cols]))
    names = [f"_x{i}" for i in range(len(cols))]
    parts = materialise(df.groupBy("station").agg(
        F.ceil(F.count(F.lit(1)) / SCORE_ROWS).alias("_parts")))
    dealt = join_station(df.withColumns({n: _value(c) for c, n in zip(cols, names)}), parts).withColumn(
        "_part", F.pmod(F.xxhash64("row_id"), F.col("_parts"))).select(_key().alias("_station"), "_part", F.struct(*df.columns).alias("_row"), *names)
    trees = join_station(forest, parts).select(
        _key().alias("_station"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"),
        "tree", "id", "feature", "split", "child", "length", "sampled")

    def score_part(rows: pa.Table, own: pa.Table) -> pa.Table:
        scores = np.zeros(rows.num_rows)
        if rows.num_rows and own.num_rows:
            x = np.column_stack([rows[n].to_numpy() for n in names])
            scores = _scores(x, _packed(own.to_pandas()))
        return pa.table({"_row": rows["_row"], out: pa.array(scores)})

    kind = df.select(F.struct(*df.columns).alias("_row")).schema["_row"].dataType
    scored = dealt.groupBy("_station", "_part").cogroup(trees.groupBy("_station", "_part")).applyInArrow(
        score_part, StructType([StructField("_row", kind), StructField(out, DoubleType())]))
    return scored.select("_row.*", out)


def anomaly_scores(df: DataFrame, cols: list[str], forest: DataFrame,
                   broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``(station, row_id, score)``; scores above 0.5 are outliers."""
    return with_scores(df, cols, forest, broadcast_nodes, "score").select("station", "row_id", "score")


def treat_by_forest(df: DataFrame, cols: list[str], treatment: str, seed: int = 42,
                    limit: int = GROUP_ROW_LIMIT, broadcast_nodes: int = BROADCAST_NODES) -> tuple[DataFrame, DataFrame]:
    """Clip flagged rows to each column's 1st and 99th percentile.

    Returns the table and ``(station, outliers)``.  Rows are scored where they
    stand and written once; only the percentiles, one row per station, join them.
    """
    scored = with_scores(df, cols, grow_forest(df, cols, seed), broadcast_nodes)
    flagged = materialise(scored.withColumn("_out", F.col("_score") > ANOMALY_SCORE).drop("_score"))
    found = flagged.groupBy("station").agg(F.count(F.when(F.col("_out"), 1)).alias("outliers"))
    if treatment == "none":
        return df, found
    tails = materialise(exact_percentiles(df, cols, [0.01, 0.99], limit).select(
        "station", *[F.col(c).alias(f"_q_{c}") for c in cols]))
    marked = join_station(flagged, tails, "left")
    treated = {c: F.when(F.col("_out"), clamp(F.col(c).cast("double"), F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]))
               .otherwise(F.col(c).cast("double")) for c in cols}
    return marked.withColumns(treated).select(*df.columns), found
