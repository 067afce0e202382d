"""A Merkle manifest of a dataset, its proofs, and their verification.

Each tree's leaves are numbered in order and cut into superblocks of a fixed number of
leaves.  A first pass reduces every superblock to one node; these nodes form a smaller
table that is cut and reduced in the same way, until one node per tree is left.  On the
way back each superblock is cogrouped with the outer nodes that its proofs need (the
siblings of its own node up to the root), and one function finishes the local
reduction, joins the proofs and folds them.  No group holds more than a superblock.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colweave.session import materialise, ready_workers

# Leaves of a superblock: two to this power.
HEIGHT = 10
# How a sibling stands: before or after the node on the path; a node without siblings is hashed alone.
LEFT, RIGHT, ALONE = "<", ">", "="
ROOT_TREE = "root"
# Fixed value: tampering adds 1 to n_chars where this divides the crc32 of doc_id.
TAMPERED = 7


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column | None = None) -> Column:
    """The leaf of a document: its columns by name, each ``-`` if null, else byte count, ``:`` and value."""
    values = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text")]
    return F.sha2(F.concat(*(_field(v) for v in values)), 256)


def tampered_chars() -> Column:
    """``n_chars`` after tampering; nulls stay, as do documents without id."""
    struck = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    return F.when(struck, F.col("n_chars").cast("long") + 1).otherwise(F.col("n_chars").cast("long"))


def reduce_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level: each two consecutive ones become their digest, a last single one too."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def levels_of(size: int) -> int:
    """Levels above the leaves of a tree."""
    return max(0, size - 1).bit_length()


def local_path(levels: list[list[str]], place: int) -> list[str]:
    """The siblings of a leaf from its level up, each marked by its side."""
    out = []
    for nodes in levels[:-1]:
        other = place ^ 1
        out.append(ALONE if other >= len(nodes) else (LEFT if place & 1 else RIGHT) + nodes[other])
        place >>= 1
    return out


def fold(node: str, path: list[str]) -> str:
    """The root that ``node`` and its siblings give."""
    for step in path:
        if step[0] == LEFT:
            node = digest(step[1:], node)
        else:
            node = digest(node, step[1:])
    return node


def numbered(rows: DataFrame, tree: str, order: list[str | Column]) -> DataFrame:
    """``rows`` with ``place`` and ``size``: the number within the tree, from 0, and the tree's number of rows.

    Rows are range partitioned by tree and order, so a large tree lies in many slices and
    the rows before each slice come from counts of slices.  Rows equal in all of these
    are parted by where they were read.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(tree), *(F.col(c) if isinstance(c, str) else c for c in order), F.col("_tie")]
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = materialise(spread.repartitionByRange(slices, *by).sortWithinPartitions(*by)
                         .withColumn("_slice", F.spark_partition_id())
                         .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    within = Window.partitionBy(tree)
    starts = (sliced.groupBy(tree, "_slice").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
              .select(tree, "_slice", "_first", F.sum("_n").over(within).alias("size"),
                      F.coalesce(F.sum("_n").over(within.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                      .alias("_before")))
    return (sliced.join(materialise(starts), [tree, "_slice"])
            .withColumn("place", F.col("_before") + F.col("_row") - F.col("_first"))
            .drop("_tie", "_slice", "_row", "_first", "_before"))


@dataclass
class Forest:
    """Tables of one reduction: ``layers[0]`` are the leaves, the last layer fits one superblock per tree."""

    height: int
    layers: list[DataFrame]
    roots: DataFrame


def _reduce_block(height: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        size = int(group["size"].iloc[0])
        top = reduce_levels(group["node"].tolist(), min(height, levels_of(size)))[-1][0]
        # Each layer above has a node for every superblock below.
        return pd.DataFrame({"tree": group["tree"].iloc[:1].tolist(), "place": [int(group["place"].iloc[0]) >> height],
                             "size": [-(-size // (1 << height))], "node": [top]})

    return run


def reduce_forest(nodes: DataFrame, height: int = HEIGHT) -> Forest:
    """All trees of ``nodes(tree, place, size, node)`` reduced to ``roots(tree, root)``, layer by layer."""
    schema = "tree string, place long, size long, node string"
    layers = [nodes]
    while True:
        block = F.shiftright("place", height)
        above = materialise(ready_workers(layers[-1]).select("tree", "place", "size", "node", block.alias("block"))
                            .groupBy("tree", "block").applyInPandas(_reduce_block(height), schema))
        most = above.agg(F.max("size")).first()[0]
        if most is None or most == 1:
            return Forest(height, layers, above.select("tree", F.col("node").alias("root")))
        # Trees that have ended wait above; their single node is its own superblock.
        layers.append(above)


def _cogrouped(inner: DataFrame, outer: DataFrame, height: int, finish, schema: str) -> DataFrame:
    """``finish(node, path)`` for each inner node, from its superblock and the superblock's outer path."""
    def run(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame({name.split()[0]: pd.Series(dtype=object) for name in schema.split(", ")})
        nodes = nodes.sort_values("place").reset_index(drop=True)
        levels = reduce_levels(nodes["node"].tolist(), min(height, levels_of(int(nodes["size"].iloc[0]))))
        beyond = list(above["path"].iloc[0]) if len(above) else []
        paths = [local_path(levels, k) + beyond for k in range(len(nodes))]
        return finish(nodes, paths, above)

    block = F.shiftright("place", height)
    left = ready_workers(inner).withColumn("block", block).groupBy("tree", "block")
    return left.cogroup(outer.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInPandas(run, schema)


def _path_only(nodes: pd.DataFrame, paths: list, above: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"tree": nodes["tree"], "place": nodes["place"], "path": paths})


def outer_paths(forest: Forest, crown: DataFrame) -> DataFrame:
    """``(tree, place, path)`` of each superblock of leaves: from its node through the layers above and the crown.

    ``crown(tree, path)`` is each root's own path (none if it is the end).
    """
    paths = crown.select("tree", F.lit(0).cast("long").alias("place"), "path")
    for layer in reversed(forest.layers[1:]):
        paths = materialise(_cogrouped(layer, paths, forest.height, _path_only, "tree string, place long, path array<string>"))
    return paths


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof, folded_root, verified)``, one row per row of ``leaves``.

    ``leaves(doc_id, lang, leaf, held_leaf)``: ``held_leaf`` is the leaf as found at
    verification.  ``proof`` lists the siblings from the leaf up through its language's
    subroot to the root, each with its side in front (``<`` before, ``>`` after, ``=`` none).

    Leaves of one language ascend by doc_id, null first, then by leaf; repeated rows have
    places (and proofs) of their own.  Languages ascend bytewise, null first.  A single
    leaf is its language's subroot, a single subroot the root.  An empty table gives none.
    """
    spark = leaves.sparkSession
    # The mark keeps a null language apart from an empty one, and first.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    written = materialise(leaves.select(tree.alias("tree"), "doc_id", F.col("leaf").alias("node"), "held_leaf"))
    nodes = materialise(numbered(written, "tree", ["doc_id", "node"]))
    forest = reduce_forest(nodes.select("tree", "place", "size", "node"), height)
    subroots = forest.roots.select(F.lit(ROOT_TREE).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node"))
    crown_nodes = materialise(numbered(subroots, "tree", ["name"]))
    crown_forest = reduce_forest(crown_nodes.select("tree", "place", "size", "node"), height)
    top = crown_forest.roots.select(F.col("tree").alias("root_tree"), "root")
    none = spark.createDataFrame([(ROOT_TREE, [])], "tree string, path array<string>")
    crown = materialise(_cogrouped(crown_nodes.select("tree", "place", "size", "node"), outer_paths(crown_forest, none), height,
                                   _path_only, "tree string, place long, path array<string>"))
    # Each language's subroot with its path to the root, one row a language.
    named = materialise(crown_nodes.select("tree", "place", F.col("name"), F.col("node").alias("subroot"))
                        .join(crown.select("place", "path"), "place").join(top, F.col("tree") == F.col("root_tree"))
                        .select(F.col("name").alias("tree"), "subroot", "root", "path"))
    outer = materialise(outer_paths(forest, named.select("tree", "path"))
                        .join(named.select("tree", "subroot", "root"), "tree"))
    kind = leaves.schema["doc_id"].dataType

    def finish(nodes: pd.DataFrame, paths: list, above: pd.DataFrame) -> pd.DataFrame:
        root = above["root"].iloc[0]
        folded = [fold(node, path) for node, path in zip(nodes["held_leaf"], paths)]
        return pd.DataFrame({"doc_id": nodes["doc_id"], "leaf": nodes["node"], "subroot": above["subroot"].iloc[0], "root": root,
                             "proof": paths, "folded_root": folded, "verified": [x == root for x in folded]})

    # As text the id passes through Python unchanged, also where some are null.
    found = _cogrouped(nodes.select("tree", "place", "size", "node", "held_leaf", F.col("doc_id").cast("string").alias("doc_id")),
                       outer, height, finish, "doc_id string, leaf string, subroot string, root string, proof array<string>, "
                                              "folded_root string, verified boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, leaf, held_leaf)`` of documents, where tampering meets some between writing and verifying.

    Other columns are ignored; any column may be null.
    """
    return docs.select("doc_id", "lang", leaf_digest().alias("leaf"), leaf_digest(tampered_chars()).alias("held_leaf"))


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, sides left out."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.substring(x, 2, 64)), ""), 256)
