"""Node centralities of all graphs in one plan.

Edge weights count by size: ``|w|`` for eigenvector and PageRank, and a link of
length ``1 / (|w| + 1e-6)`` for betweenness and closeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.stats import null_if_zero
from colweave.operators.graphs import GRAPH_KEYS
from colweave.operators.paths import SWEEP_SOURCES, has_rows, links, path_sums
from colweave.session import materialise, max_group_rows

MAX_ROUNDS = 1000
TOLERANCE = 1e-5
DAMPING = 0.85
# Links of one graph that fit in a single row; larger graphs iterate by joins.
ROW_LINKS = 250_000
CENTRALITIES = ["degree_centrality", "betweenness_centrality", "closeness_centrality",
                "eigenvector_centrality", "pagerank"]


def with_distance(ordered: DataFrame) -> DataFrame:
    return ordered.withColumn("distance", 1.0 / (F.abs("weight") + 1e-6))


def _sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*GRAPH_KEYS).agg(F.count(F.lit(1)).alias("n"))


def degree(nodes: DataFrame, ordered: DataFrame) -> DataFrame:
    """Total degree over ``n - 1``; a lone node has 1."""
    ends = F.when(F.col("directed"), F.array("s", "t")).otherwise(F.array("s"))
    counts = (ordered.select(*GRAPH_KEYS, F.explode(ends).alias("idx"))
              .groupBy(*GRAPH_KEYS, "idx").agg(F.count(F.lit(1)).alias("degree")))
    share = F.coalesce("degree", F.lit(0)) / null_if_zero(F.col("n") - 1)
    return (nodes.join(_sizes(nodes), GRAPH_KEYS).join(counts, [*GRAPH_KEYS, "idx"], "left")
            .select(*GRAPH_KEYS, "idx", F.coalesce(share, F.lit(1.0)).alias("degree_centrality")))


def length_sums(lengths: DataFrame) -> DataFrame:
    """Lengths of pairs added up by the node they end in: ``(keys, idx, total, others)``."""
    return (lengths.where("s <> t").groupBy(*GRAPH_KEYS, F.col("t").alias("idx"))
            .agg(F.sum("d").alias("total"), F.count(F.lit(1)).alias("others")))


def closeness(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """Incoming closeness, scaled by the share of nodes that reach the node."""
    reach = sums.select(*GRAPH_KEYS, "idx", "total", "others")
    value = F.col("others") / null_if_zero(F.col("total")) * (F.col("others") / null_if_zero(F.col("n") - 1))
    return (nodes.join(_sizes(nodes), GRAPH_KEYS).join(reach, [*GRAPH_KEYS, "idx"], "left")
            .select(*GRAPH_KEYS, "idx", F.coalesce(value, F.lit(0.0)).alias("closeness_centrality")))


def betweenness(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """Share of shortest paths through a node, ends excluded, over ``(n-1)(n-2)``."""
    flows = sums.select(*GRAPH_KEYS, "idx", "flow")
    room = null_if_zero((F.col("n") - 1) * (F.col("n") - 2))
    return (nodes.join(_sizes(nodes), GRAPH_KEYS).join(flows, [*GRAPH_KEYS, "idx"], "left")
            .select(*GRAPH_KEYS, "idx",
                    F.coalesce(F.col("flow") / room, F.lit(0.0)).alias("betweenness_centrality")))


# ------------------------------------------------------------ power iterations

def _incoming(nodes: DataFrame, weighted: DataFrame) -> DataFrame:
    """One row per graph: for each node in index order, its incoming (source place, weight) list."""
    rank = nodes.groupBy(*GRAPH_KEYS).agg(F.sort_array(F.collect_list("idx")).alias("order"))
    lists = weighted.groupBy(*GRAPH_KEYS, F.col("t").alias("idx")).agg(
        F.sort_array(F.collect_list(F.struct("s", "w"))).alias("links"))
    per_node = nodes.join(lists, [*GRAPH_KEYS, "idx"], "left").select(
        *GRAPH_KEYS, "idx", F.coalesce("links", F.array().cast("array<struct<s:int,w:double>>")).alias("links"))
    rows = per_node.groupBy(*GRAPH_KEYS).agg(F.sort_array(F.collect_list(F.struct("idx", "links"))).alias("rows"))
    place = rows.join(rank, GRAPH_KEYS)
    # Column indices become places in the vector.
    return place.select(*GRAPH_KEYS, "order", F.size("order").alias("n"), F.transform(
        "rows", lambda r: F.transform(r["links"], lambda e: F.struct(
            (F.array_position(F.col("order"), e["s"]) - 1).cast("int").alias("p"), e["w"].alias("w")))).alias("rows"))


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), use)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _iterate(step) -> Column:
    """Repeat ``step`` on the vector until it says done; zeros if it never does."""
    start = F.struct(F.array_repeat(1.0 / F.col("n").cast("double"), F.col("n")).alias("x"),
                     F.lit(False).alias("done"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_ROUNDS)), start,
                       lambda acc, _: F.when(acc["done"], acc).otherwise(step(acc["x"])))
    return _let(last, lambda s: F.when(s["done"], s["x"]).otherwise(F.array_repeat(F.lit(0.0), F.col("n"))))


def _settled(new: Column, old: Column) -> Column:
    change = _total(F.zip_with(new, old, lambda a, b: F.abs(a - b)))
    return F.struct(new.alias("x"), (change < F.col("n") * TOLERANCE).alias("done"))


def _eigen_step(x: Column) -> Column:
    grown = F.transform("rows", lambda row, i: F.aggregate(
        row, x[i], lambda a, e: a + e["w"] * x[e["p"]]))
    return _let(grown, lambda y: _let(
        F.coalesce(null_if_zero(F.sqrt(_total(F.transform(y, lambda v: v * v)))), F.lit(1.0)),
        lambda norm: _let(F.transform(y, lambda v: v / norm), lambda new: _settled(new, x))))


def _rank_step(x: Column) -> Column:
    stuck = _total(F.zip_with(x, F.col("stuck"), lambda a, b: a * b))
    rest = (DAMPING * stuck + (1.0 - DAMPING)) / F.col("n")
    moved = F.transform("rows", lambda row: DAMPING * F.aggregate(
        row, F.lit(0.0), lambda a, e: a + e["w"] * x[e["p"]]) + rest)
    return _let(moved, lambda new: _settled(new, x))


def _spread(rows: DataFrame, vector: Column, name: str) -> DataFrame:
    return rows.select(*GRAPH_KEYS, F.inline(F.arrays_zip(F.col("order").alias("idx"), vector.alias(name)))).toDF(
        *GRAPH_KEYS, "idx", name)


def eigenvector(nodes: DataFrame, ordered: DataFrame, row_links: int = ROW_LINKS) -> DataFrame:
    """Dominant eigenvector by iterating ``x + Ax`` on incoming ``|w|``; 0 without convergence."""
    weighted = ordered.select(*GRAPH_KEYS, "s", "t", F.abs("weight").alias("w"))
    if max_group_rows(weighted, GRAPH_KEYS) > row_links:
        return _by_joins(nodes, weighted, "eigenvector_centrality", rank=False)
    rows = _incoming(nodes, weighted)
    return _spread(rows, _iterate(_eigen_step), "eigenvector_centrality")


def pagerank(nodes: DataFrame, ordered: DataFrame, row_links: int = ROW_LINKS) -> DataFrame:
    """PageRank on ``|w|`` with uniform treatment of dead ends; 0 without convergence."""
    weighted = _out_shares(ordered)
    if max_group_rows(weighted, GRAPH_KEYS) > row_links:
        return _by_joins(nodes, weighted, "pagerank", rank=True)
    rows = _incoming(nodes, weighted).join(
        nodes.join(_dead_ends(nodes, weighted), [*GRAPH_KEYS, "idx"])
        .groupBy(*GRAPH_KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "stuck"))),
                                              lambda e: e["stuck"]).alias("stuck")), GRAPH_KEYS)
    return _spread(rows, _iterate(_rank_step), "pagerank")


def _out_shares(ordered: DataFrame) -> DataFrame:
    sized = ordered.select(*GRAPH_KEYS, "s", "t", F.abs("weight").alias("w")).where("w > 0")
    out = sized.groupBy(*GRAPH_KEYS, "s").agg(F.sum("w").alias("out"))
    return sized.join(out, [*GRAPH_KEYS, "s"]).select(*GRAPH_KEYS, "s", "t", (F.col("w") / F.col("out")).alias("w"))


def _dead_ends(nodes: DataFrame, weighted: DataFrame) -> DataFrame:
    sources = weighted.select(*GRAPH_KEYS, F.col("s").alias("idx")).distinct().withColumn("stuck", F.lit(0.0))
    return nodes.select(*GRAPH_KEYS, "idx").join(sources, [*GRAPH_KEYS, "idx"], "left").withColumn(
        "stuck", F.coalesce("stuck", F.lit(1.0)))


def _by_joins(nodes: DataFrame, weighted: DataFrame, name: str, rank: bool) -> DataFrame:
    """The same iteration over edge rows, for graphs too large for one row."""
    weighted = materialise(weighted)
    state = materialise(_dead_ends(nodes, weighted).join(_sizes(nodes), GRAPH_KEYS)
                        .select("*", (1.0 / F.col("n")).alias("x"), F.lit(False).alias("done")))
    for _ in range(MAX_ROUNDS):
        pushed = (weighted.join(state.select(*GRAPH_KEYS, F.col("idx").alias("s"), "x"), [*GRAPH_KEYS, "s"])
                  .groupBy(*GRAPH_KEYS, F.col("t").alias("idx")).agg(F.sum(F.col("w") * F.col("x")).alias("got")))
        got = F.coalesce("got", F.lit(0.0))
        joined = state.join(pushed, [*GRAPH_KEYS, "idx"], "left")
        if rank:
            stuck = state.groupBy(*GRAPH_KEYS).agg(F.sum(F.col("x") * F.col("stuck")).alias("held"))
            new = DAMPING * got + (DAMPING * F.col("held") + (1.0 - DAMPING)) / F.col("n")
            moved = joined.join(stuck, GRAPH_KEYS).withColumn("y", new)
        else:
            grown = joined.withColumn("raw", F.col("x") + got)
            norms = grown.groupBy(*GRAPH_KEYS).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
            moved = grown.join(norms, GRAPH_KEYS).withColumn(
                "y", F.col("raw") / F.coalesce(null_if_zero(F.col("norm")), F.lit(1.0)))
        moved = moved.withColumn("y", F.when(F.col("done"), F.col("x")).otherwise(F.col("y")))
        change = moved.groupBy(*GRAPH_KEYS).agg(F.sum(F.abs(F.col("y") - F.col("x"))).alias("change"))
        state = materialise(moved.join(change, GRAPH_KEYS).select(
            *GRAPH_KEYS, "idx", "stuck", "n", F.col("y").alias("x"),
            (F.col("done") | (F.col("change") < F.col("n") * TOLERANCE)).alias("done")))
        if not has_rows(state.where("not done")):
            break
    return state.select(*GRAPH_KEYS, "idx", F.when(F.col("done"), F.col("x")).otherwise(0.0).alias(name))


def centralities(nodes: DataFrame, edges: DataFrame, block: int = SWEEP_SOURCES) -> DataFrame:
    """All five centralities: one row per node of every graph."""
    nodes = materialise(nodes)
    ordered = materialise(with_distance(links(nodes, edges)))
    sums = materialise(path_sums(nodes, ordered, block))
    out = nodes.select(*GRAPH_KEYS, "node", "idx")
    for part in (degree(nodes, ordered), betweenness(nodes, sums), closeness(nodes, sums),
                 eigenvector(nodes, ordered), pagerank(nodes, ordered)):
        out = out.join(part, [*GRAPH_KEYS, "idx"], "left")
    return out.fillna(0.0, CENTRALITIES)
