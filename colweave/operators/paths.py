"""Reachability and shortest paths over edge tables, all graphs in one plan.

Each round is a join of the frontier with the edges.  Rounds are written to the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.operators.graphs import GRAPH_KEYS
from colweave.session import materialise, max_group_rows, ready_workers

# Two path lengths closer than this share of their size are equally short.
LENGTH_TOLERANCE = 1e-12
# Graphs up to this many nodes (table columns) fit their N x N lengths in one
# row and are solved by array expressions, all graphs in parallel and without
# rounds.  Larger ones take the join rounds.
ROW_NODES = 200
# Sources that one task sweeps a larger graph from.
SWEEP_SOURCES = 512


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ordered links by column index: ``(keys, s, t, weight, directed)``; undirected ones both ways."""
    start = nodes.select(*GRAPH_KEYS, F.col("node").alias("source"), F.col("idx").alias("s"))
    end = nodes.select(*GRAPH_KEYS, F.col("node").alias("target"), F.col("idx").alias("t"))
    one_way = (edges.join(start, [*GRAPH_KEYS, "source"]).join(end, [*GRAPH_KEYS, "target"])
               .select(*GRAPH_KEYS, "directed", "s", "t", "weight"))
    keep = F.struct("s", "t")
    flip = F.struct(F.col("t").alias("s"), F.col("s").alias("t"))
    sides = F.when(F.col("directed"), F.array(keep)).otherwise(F.array(keep, flip))
    return one_way.select(*GRAPH_KEYS, "directed", "weight", F.inline(sides))


def two_way(ordered: DataFrame) -> DataFrame:
    """Links with the direction forgotten, once per ordered pair."""
    flip = F.inline(F.array(F.struct("s", "t"), F.struct(F.col("t").alias("s"), F.col("s").alias("t"))))
    return ordered.select(*GRAPH_KEYS, flip).distinct()


def _row_lengths(nodes: DataFrame, hops: DataFrame, keys: list[str]) -> DataFrame:
    """Shortest lengths of small graphs as ``(keys, s, t, d)`` from ``hops(keys, s, t, length)``.

    One row per graph holds its N x N lengths; paths through each node in turn
    shorten them (Floyd-Warshall).
    """
    far = F.lit(float("inf"))
    place = nodes.groupBy(*keys).agg(F.sort_array(F.collect_list("idx")).alias("order"))
    out = hops.groupBy(*keys, F.col("s").alias("idx")).agg(F.collect_list(F.struct("t", "length")).alias("out"))
    per_node = (nodes.select(*keys, "idx").join(place, keys).join(out, [*keys, "idx"], "left")
                .select(*keys, "order", "idx", F.transform("order", lambda j: F.when(
                    j == F.col("idx"), F.lit(0.0)).otherwise(F.coalesce(F.array_min(F.transform(F.filter(
                        F.col("out"), lambda e: e["t"] == j), lambda e: e["length"])), far))).alias("row")))
    grid = per_node.groupBy(*keys, "order").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "row"))), lambda r: r["row"]).alias("grid"))
    solved = F.aggregate(
        F.sequence(F.lit(0), F.size("order") - 1), F.col("grid"),
        lambda grid, k: F.transform(grid, lambda row: F.zip_with(
            row, grid[k], lambda direct, rest: F.least(direct, row[k] + rest))))
    rows = grid.select(*keys, "order", F.posexplode(solved).alias("i", "lengths"))
    return (rows.select(*keys, F.col("order")[F.col("i")].alias("s"),
                        F.inline(F.arrays_zip(F.col("order").alias("t"), F.col("lengths").alias("d"))))
            .where(F.col("d") < far))


def fits_rows(nodes: DataFrame, keys: list[str], limit: int = ROW_NODES) -> bool:
    return max_group_rows(nodes, keys) <= limit


def components(nodes: DataFrame, ordered: DataFrame, row_nodes: int = ROW_NODES) -> DataFrame:
    """``(keys, idx, label)``: smallest node index reachable, directions ignored.

    In the join form every round takes the smallest label among the neighbours
    and then the label of that label, so chains halve instead of shrinking by one.
    """
    if fits_rows(nodes, GRAPH_KEYS, row_nodes):
        reach = _row_lengths(nodes, two_way(ordered).withColumn("length", F.lit(1.0)), GRAPH_KEYS)
        return labels_from_reach(reach)
    near = materialise(two_way(ordered))
    state = materialise(nodes.select(*GRAPH_KEYS, "idx", F.col("idx").alias("label")))
    while True:
        lowest = (near.join(state.withColumnRenamed("idx", "t"), [*GRAPH_KEYS, "t"])
                  .groupBy(*GRAPH_KEYS, F.col("s").alias("idx")).agg(F.min("label").alias("low")))
        hooked = state.join(lowest, [*GRAPH_KEYS, "idx"], "left").withColumn(
            "hook", F.least("label", F.coalesce("low", "label")))
        jump = state.select(*GRAPH_KEYS, F.col("idx").alias("hook"), F.col("label").alias("far"))
        state = materialise(hooked.join(jump, [*GRAPH_KEYS, "hook"], "left").select(
            *GRAPH_KEYS, "idx", F.least("hook", F.coalesce("far", "hook")).alias("label"),
            F.col("label").alias("was")))
        if not has_rows(state.where("label <> was")):
            return state.select(*GRAPH_KEYS, "idx", "label")
        state = state.drop("was")


def labels_from_reach(reach: DataFrame) -> DataFrame:
    return reach.groupBy(*GRAPH_KEYS, F.col("s").alias("idx")).agg(F.min("t").alias("label"))


def _sweep(pairs: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Breadth-first sweeps from a block of sources at once, one bit per source and node."""
    starts = np.unique(sources["idx"].to_numpy())
    s, t = pairs["s"].to_numpy(), pairs["t"].to_numpy()
    names = np.unique(np.concatenate([starts, s, t]))
    place = np.searchsorted(names, starts)
    words = -(-len(starts) // 64)
    bit = np.arange(len(starts))
    seen = np.zeros((len(names), words), dtype=np.uint64)
    seen[place, bit // 64] |= np.uint64(1) << (bit % 64).astype(np.uint64)
    order = np.argsort(t, kind="stable")
    leave, arrive = np.searchsorted(names, s[order]), np.searchsorted(names, t[order])
    opens = np.flatnonzero(np.diff(arrive, prepend=-1))
    front, far, hops = seen.copy(), np.zeros(len(starts), dtype=np.int64), 0
    while len(opens):
        hops += 1
        fresh = np.zeros_like(seen)
        fresh[arrive[opens]] = np.bitwise_or.reduceat(front[leave], opens, axis=0)
        fresh &= ~seen
        alive = np.unpackbits(np.bitwise_or.reduce(fresh, axis=0).view(np.uint8), bitorder="little")[:len(starts)].astype(bool)
        if not alive.any():
            break
        far[alive] = hops
        seen |= fresh
        front = fresh
    reached, least = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(names))
    for low in range(0, len(names), 4096):
        bits = np.unpackbits(seen[low:low + 4096].view(np.uint8), axis=1, bitorder="little")[:, :len(starts)]
        reached += bits.sum(axis=0, dtype=np.int64)
        first = np.where(bits.any(axis=0), low + bits.argmax(axis=0), len(names))
        least = np.minimum(least, first)
    return pd.DataFrame({"idx": starts, "far": far, "reached": reached, "least": names[least]})


def reaches(nodes: DataFrame, near: DataFrame, keys: list[str], row_nodes: int = ROW_NODES, block: int = SWEEP_SOURCES) -> DataFrame:
    """Per node the hops to its farthest reachable node, how many it reaches, and the least: ``(keys, idx, far, reached, least)``.

    Larger graphs are swept by blocks of sources: a block meets its graph's links in one
    task and gives one row per source, never one per pair.  Nodes linked to all others
    need no sweep.
    """
    if fits_rows(nodes, keys, row_nodes):
        lengths = _row_lengths(nodes, near.withColumn("length", F.lit(1.0)), keys)
        return lengths.groupBy(*keys, F.col("s").alias("idx")).agg(
            F.max(F.col("d").cast("int")).alias("far"), F.count(F.lit(1)).alias("reached"), F.min("t").alias("least"))
    near = materialise(near.where("s <> t").select(*keys, "s", "t").distinct())
    nodes = materialise(nodes.select(*keys, "idx"))
    size = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("lowest"))
    out = near.groupBy(*keys, F.col("s").alias("idx")).agg(F.count(F.lit(1)).alias("out"))
    known = materialise(nodes.join(size, keys).join(out, [*keys, "idx"], "left").fillna(0, ["out"]))
    whole = F.col("out") == F.col("n") - 1
    direct = known.where(whole | (F.col("out") == 0)).select(
        *keys, "idx", F.when(F.col("out") > 0, 1).otherwise(0).alias("far"), (F.col("out") + 1).alias("reached"),
        F.when(F.col("out") > 0, F.col("lowest")).otherwise(F.col("idx")).alias("least"))
    rank = Window.partitionBy(*keys).orderBy("idx")
    swept = (known.where(~whole & (F.col("out") > 0)).withColumn("_at", F.row_number().over(rank) - 1)
             .select(*keys, "idx", F.floor(F.col("_at") / block).cast("long").alias("block")))
    blocks = materialise(swept.select(*keys, "block").distinct())
    sent = near.join(blocks, keys).repartition(F.col("block"), *keys)
    kinds = ", ".join(f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys)

    def sweep(key: tuple, pairs: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        return _sweep(pairs, sources).assign(**dict(zip(keys, key)))[[*keys, "idx", "far", "reached", "least"]]

    found = (ready_workers(sent).groupBy(*keys, "block").cogroup(ready_workers(swept).groupBy(*keys, "block"))
             .applyInPandas(sweep, f"{kinds}, idx {nodes.schema['idx'].dataType.simpleString()}, far int, reached long, "
                                   f"least {nodes.schema['idx'].dataType.simpleString()}"))
    return direct.select(*keys, "idx", F.col("far").cast("int").alias("far"), F.col("reached").cast("long").alias("reached"), "least").unionByName(found)


def shortest_lengths(nodes: DataFrame, ordered: DataFrame, row_nodes: int = ROW_NODES) -> DataFrame:
    """Shortest weighted length between reachable ordered pairs: ``(keys, s, t, d)``.

    ``ordered`` carries a positive ``distance``.  In the join form only pairs
    that improved in the last round are extended.
    """
    if fits_rows(nodes, GRAPH_KEYS, row_nodes):
        return _row_lengths(nodes, ordered.withColumnRenamed("distance", "length"), GRAPH_KEYS)
    hop = ordered.select(*GRAPH_KEYS, F.col("s").alias("t"), F.col("t").alias("next"), "distance")
    best = materialise(nodes.select(*GRAPH_KEYS, F.col("idx").alias("s"), F.col("idx").alias("t"),
                                    F.lit(0.0).alias("d"), F.lit(True).alias("improved")))
    while True:
        longer = (best.where("improved").join(hop, [*GRAPH_KEYS, "t"])
                  .select(*GRAPH_KEYS, "s", F.col("next").alias("t"),
                          (F.col("d") + F.col("distance")).alias("d"), F.lit(True).alias("fresh")))
        merged = best.select(*GRAPH_KEYS, "s", "t", "d", F.lit(False).alias("fresh")).unionByName(longer)
        best = materialise(merged.groupBy(*GRAPH_KEYS, "s", "t").agg(
            F.min("d").alias("d"), F.min(F.when(~F.col("fresh"), F.col("d"))).alias("old"))
            .select(*GRAPH_KEYS, "s", "t", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("improved")))
        if not has_rows(best.where("improved")):
            return best.select(*GRAPH_KEYS, "s", "t", "d")


def _lengths_from(source: int, first: np.ndarray, arrive: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Shortest length from one node to every node, infinite where it cannot go."""
    far = np.full(len(first) - 1, np.inf)
    far[source] = 0.0
    queue = [(0.0, source)]
    while queue:
        at, node = heapq.heappop(queue)
        if at > far[node]:
            continue
        ends = arrive[first[node]:first[node + 1]]
        reach = at + length[first[node]:first[node + 1]]
        shorter = reach < far[ends]
        ends, reach = ends[shorter], reach[shorter]
        np.minimum.at(far, ends, reach)
        for item in zip(reach.tolist(), ends.tolist()):
            heapq.heappush(queue, item)
    return far


def _fold_paths(hops: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums over all shortest paths from a block of sources, one row per node reached."""
    starts = np.unique(sources["idx"].to_numpy())
    s, t = hops["s"].to_numpy(), hops["t"].to_numpy()
    names = np.unique(np.concatenate([s, t]))
    order = np.argsort(s, kind="stable")
    leave, arrive = np.searchsorted(names, s[order]), np.searchsorted(names, t[order])
    length = hops["distance"].to_numpy(dtype=float)[order]
    first = np.searchsorted(leave, np.arange(len(names) + 1))
    flow, total = np.zeros(len(names)), np.zeros(len(names))
    others = np.zeros(len(names), dtype=np.int64)
    for source in np.searchsorted(names, starts).tolist():
        far = _lengths_from(source, first, arrive, length)
        usable = np.flatnonzero(np.isfinite(far[leave]) & (arrive != source))
        before, after = far[leave[usable]], far[arrive[usable]]
        tight = (before < after) & (np.abs(before + length[usable] - after) <= LENGTH_TOLERANCE * after)
        steps = usable[tight][np.argsort(after[tight], kind="stable")]
        # Out in order of distance: every path into a node is counted before it goes on.
        pairs = list(zip(leave[steps].tolist(), arrive[steps].tolist()))
        paths = [0.0] * len(names)
        paths[source] = 1.0
        for u, v in pairs:
            paths[v] += paths[u]
        # And back: a node passes on what it carries for the nodes behind it.
        carried = [0.0] * len(names)
        for u, v in reversed(pairs):
            carried[u] += paths[u] / paths[v] * (1.0 + carried[v])
        carried[source] = 0.0
        flow += carried
        reached = np.isfinite(far)
        reached[source] = False
        total[reached] += far[reached]
        others += reached
    met = others > 0
    return pd.DataFrame({"idx": names[met], "flow": flow[met], "total": total[met], "others": others[met]})


def path_sums(nodes: DataFrame, ordered: DataFrame, block: int = SWEEP_SOURCES) -> DataFrame:
    """Per node the shortest paths through and into it: ``(keys, idx, flow, total, others)``.

    ``flow`` is the share of shortest paths between other nodes that pass the node, ``total``
    the length of the shortest paths into it and ``others`` how many nodes reach it; nodes
    that none reaches have no row.  ``ordered`` carries a positive ``distance``.  Sources are
    dealt over tasks by blocks of column indices; a block meets its graph's links (columns,
    not rows of the table) in one task and gives one row per node, never one per pair or hop.
    """
    keys = GRAPH_KEYS
    hops = ordered.where("s <> t").select(*keys, "s", "t", "distance")
    at = F.floor(F.col("idx") / block).cast("long").alias("block")
    sources = materialise(hops.select(*keys, F.col("s").alias("idx")).distinct().select(*keys, "idx", at))
    blocks = materialise(sources.select(*keys, "block").distinct())
    sent = hops.join(blocks, keys)
    kind = nodes.schema["idx"].dataType.simpleString()
    schema = ", ".join(f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys)

    def fold(key: tuple, links_of: pd.DataFrame, sources_of: pd.DataFrame) -> pd.DataFrame:
        return _fold_paths(links_of, sources_of).assign(**dict(zip(keys, key)))[[*keys, "idx", "flow", "total", "others"]]

    parts = (ready_workers(sent).groupBy(*keys, "block").cogroup(sources.groupBy(*keys, "block"))
             .applyInPandas(fold, f"{schema}, idx {kind}, flow double, total double, others long"))
    return parts.groupBy(*keys, "idx").agg(
        F.sum("flow").alias("flow"), F.sum("total").alias("total"), F.sum("others").alias("others"))
