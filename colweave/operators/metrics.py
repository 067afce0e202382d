"""Structure of every graph: counts, density, components, clustering, diameter, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.functions.stats import null_if_zero
from colweave.operators.graphs import GRAPH_KEYS
from colweave.operators.paths import ROW_NODES, links, reaches, two_way
from colweave.session import materialise

METRICS = ["node_count", "edge_count", "density", "avg_degree", "connected_components", "isolated_nodes",
           "clustering_coefficient", "diameter", "radius"]


def basic_counts(nodes: DataFrame, ordered: DataFrame) -> DataFrame:
    """Nodes, edges, directedness, mean total degree and density per graph.

    ``ordered`` are links, where an undirected edge appears once each way.
    """
    n = nodes.groupBy(*GRAPH_KEYS).agg(F.count(F.lit(1)).alias("node_count"))
    halves = F.sum(F.when(F.col("directed"), 2).otherwise(1))
    m = ordered.groupBy(*GRAPH_KEYS).agg(F.floor(halves / 2).alias("edge_count"),
                                         F.bool_or("directed").alias("directed"))
    size, count = F.col("node_count"), F.coalesce("edge_count", F.lit(0))
    possible = null_if_zero(size * (size - 1))
    factor = F.when(F.coalesce("directed", F.lit(False)), 1.0).otherwise(2.0)
    return n.join(m, GRAPH_KEYS, "left").select(
        *GRAPH_KEYS, "node_count", count.alias("edge_count"),
        F.coalesce("directed", F.col("graph_type") == "top_k").alias("directed"),
        (2.0 * count / size).alias("avg_degree"),
        F.coalesce(factor * count / possible, F.lit(0.0)).alias("density"))


def isolated_nodes(nodes: DataFrame, ordered: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    touched = two_way(ordered).select(*GRAPH_KEYS, F.col("s").alias("idx")).distinct()
    return nodes.join(touched, [*GRAPH_KEYS, "idx"], "left_anti")


def clustering(nodes: DataFrame, ordered: DataFrame) -> DataFrame:
    """Mean unweighted clustering over all nodes; directed graphs count directed triangles.

    Each triangle is listed once, from its node with the fewest links; those of complete
    graphs are not listed.  A pair linked both ways has multiplicity 2, which yields the
    directed count.
    """
    pairs = materialise(
        ordered.where("s <> t").groupBy(*GRAPH_KEYS, F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
        .agg(F.count(F.when(F.col("directed"), 1)).alias("ways"))
        # An undirected edge appears in both orders but is one link.
        .select(*GRAPH_KEYS, "a", "b", F.greatest("ways", F.lit(1)).alias("ways")))
    directed = ordered.groupBy(*GRAPH_KEYS).agg(F.bool_or("directed").alias("directed"))
    # Where every pair is linked in every way, each node's neighbours are all linked: nothing to list.
    size = nodes.groupBy(*GRAPH_KEYS).agg(F.count(F.lit(1)).alias("n"))
    full = materialise(
        pairs.groupBy(*GRAPH_KEYS).agg(F.count(F.lit(1)).alias("links"), F.min("ways").alias("least"))
        .join(size, GRAPH_KEYS).join(directed, GRAPH_KEYS)
        .where("2 * links = n * (n - 1) AND (NOT directed OR least = 2)").select(*GRAPH_KEYS, "n"))
    open_pairs = pairs.join(full, GRAPH_KEYS, "left_anti")
    # A link leads from its node with fewer links, so a hub's links all lead to it and no node has
    # more than about the root of twice the links going out: the paths of two links stay few.
    links = (open_pairs.select(*GRAPH_KEYS, F.explode(F.array("a", "b")).alias("idx"))
             .groupBy(*GRAPH_KEYS, "idx").agg(F.count(F.lit(1)).alias("links")))
    ends = (open_pairs.join(links.select(*GRAPH_KEYS, F.col("idx").alias("a"), F.col("links").alias("la")), [*GRAPH_KEYS, "a"])
            .join(links.select(*GRAPH_KEYS, F.col("idx").alias("b"), F.col("links").alias("lb")), [*GRAPH_KEYS, "b"]))
    forward = F.struct("la", "a") < F.struct("lb", "b")
    led = materialise(ends.select(*GRAPH_KEYS, F.when(forward, F.col("a")).otherwise(F.col("b")).alias("s"),
                                  F.when(forward, F.col("b")).otherwise(F.col("a")).alias("t"), "ways"))
    one = led.select(*GRAPH_KEYS, "s", F.col("t").alias("b"), F.col("ways").alias("w1"))
    two = led.select(*GRAPH_KEYS, "s", F.col("t").alias("c"), F.col("ways").alias("w2"))
    wedges = one.join(two, [*GRAPH_KEYS, "s"]).where("b < c")
    closing = open_pairs.select(*GRAPH_KEYS, F.col("a").alias("b"), F.col("b").alias("c"), F.col("ways").alias("w3"))
    triangles = (wedges.join(closing, [*GRAPH_KEYS, "b", "c"])
                 .withColumn("found", F.col("w1") * F.col("w2") * F.col("w3")))
    per_node = (triangles.select(*GRAPH_KEYS, "found", F.explode(F.array("s", "b", "c")).alias("idx"))
                .groupBy(*GRAPH_KEYS, "idx").agg(F.sum("found").alias("found")))
    degrees = (pairs.select(*GRAPH_KEYS, "ways", F.explode(F.array("a", "b")).alias("idx"))
               .groupBy(*GRAPH_KEYS, "idx").agg(F.sum("ways").alias("degree"),
                                                F.count(F.when(F.col("ways") == 2, 1)).alias("mutual")))
    room = F.col("degree") * (F.col("degree") - 1)
    local = F.when(F.col("directed"), F.col("found") / null_if_zero(room - 2 * F.col("mutual"))).otherwise(
        2 * F.col("found") / null_if_zero(room))
    return (nodes.join(degrees, [*GRAPH_KEYS, "idx"], "left").join(per_node, [*GRAPH_KEYS, "idx"], "left")
            .join(directed, GRAPH_KEYS, "left").join(full, GRAPH_KEYS, "left")
            .groupBy(*GRAPH_KEYS).agg(F.avg(F.when(F.col("n") >= 3, 1.0).when(F.col("n") < 3, 0.0)
                                            .otherwise(F.coalesce(local, F.lit(0.0)))).alias("clustering_coefficient")))


def extent(nodes: DataFrame, ordered: DataFrame, counts: DataFrame, row_nodes: int = ROW_NODES) -> DataFrame:
    """Components, hop diameter and radius, and whether these describe only the largest component.

    A directed graph uses directed paths when it is strongly connected.  In every
    other disconnected case the largest component (lowest index first on ties) is
    measured with directions ignored; -1 where nothing can be measured.
    """
    variant = [*GRAPH_KEYS, "variant"]
    near = (two_way(ordered).withColumn("variant", F.lit("any"))
            .unionByName(ordered.where("directed").select(*GRAPH_KEYS, "s", "t", F.lit("along").alias("variant"))))
    starts = nodes.select(*GRAPH_KEYS, "idx", F.lit("any").alias("variant")).unionByName(
        nodes.join(counts.where("directed"), GRAPH_KEYS, "left_semi")
        .select(*GRAPH_KEYS, "idx", F.lit("along").alias("variant")))
    far = materialise(reaches(starts, near, variant, row_nodes))
    parts = far.where("variant = 'any'").select(*GRAPH_KEYS, "idx", F.col("least").alias("label"))
    strong = far.where("variant = 'along'").groupBy(*GRAPH_KEYS).agg(F.sum("reached").alias("pairs"))
    sizes = parts.groupBy(*GRAPH_KEYS, "label").agg(F.count(F.lit(1)).alias("size"))
    largest = Window.partitionBy(*GRAPH_KEYS).orderBy(F.col("size").desc(), "label")
    main = sizes.withColumn("rank", F.row_number().over(largest)).where("rank = 1").select(*GRAPH_KEYS, "label", "size")
    tally = sizes.groupBy(*GRAPH_KEYS).agg(F.count(F.lit(1)).alias("connected_components"))
    whole = F.when(F.col("directed"), F.col("pairs") == F.col("node_count") * F.col("node_count")).otherwise(
        F.col("connected_components") == 1)
    facts = (counts.join(tally, GRAPH_KEYS).join(main, GRAPH_KEYS).join(strong, GRAPH_KEYS, "left")
             .withColumn("whole", F.coalesce(whole, F.lit(False)))
             .withColumn("variant", F.when(F.col("whole") & F.col("directed"), "along").otherwise("any")))
    measured = (far.join(facts.select(*GRAPH_KEYS, "variant", "whole", "label"), variant)
                .join(parts.withColumnRenamed("label", "own"), [*GRAPH_KEYS, "idx"])
                .where(F.col("whole") | (F.col("own") == F.col("label")))
                .groupBy(*GRAPH_KEYS).agg(F.max("far").alias("diameter"), F.min("far").alias("radius")))
    usable = (F.col("node_count") > 1) & (F.col("whole") | (F.col("size") > 1))

    def or_none(name: str):
        return F.when(usable, F.col(name).cast("double")).otherwise(-1.0).alias(name)

    return facts.join(measured, GRAPH_KEYS, "left").select(
        *GRAPH_KEYS, "connected_components", or_none("diameter"), or_none("radius"),
        ((F.col("node_count") > 1) & ~F.col("whole")).alias("partial"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, row_nodes: int = ROW_NODES) -> DataFrame:
    """All structure metrics and warnings, one row per graph.

    ``nodes`` is read several times and should be a cheap or written table.
    """
    ordered = materialise(links(nodes, edges))
    counts = basic_counts(nodes, ordered)
    lonely = isolated_nodes(nodes, ordered).groupBy(*GRAPH_KEYS).agg(F.count(F.lit(1)).alias("isolated_nodes"))
    table = (counts.join(extent(nodes, ordered, counts, row_nodes), GRAPH_KEYS)
             .join(clustering(nodes, ordered), GRAPH_KEYS)
             .join(lonely, GRAPH_KEYS, "left").fillna(0, ["isolated_nodes"]))
    return table.select(*GRAPH_KEYS, *METRICS, warnings().alias("warnings"))


def warnings():
    """Fixed messages, in reporting order."""
    def text(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    return F.array_compact(F.array(
        F.when(F.col("partial"), "Disconnected Graph: Diameter and radius computed on the largest component."),
        F.when(F.col("edge_count") == 0, "Degenerate Graph: No edges exist."),
        F.when(F.col("node_count") < 5, text(
            "Small Graph Warning: Graph contains only ", F.col("node_count").cast("string"), " nodes.")),
        F.when(F.col("connected_components") > 1, text(
            "Disconnected Graph: Contains ", F.col("connected_components").cast("string"), " connected components.")),
        F.when(F.col("isolated_nodes") > 0, text(
            "Isolated Nodes Warning: ", F.col("isolated_nodes").cast("string"), " nodes have no connections."))))
