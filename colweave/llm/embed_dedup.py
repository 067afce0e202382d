"""Embedding near-duplicates within spherical k-means cells.

Vectors go to the cell of their nearest centroid.  A vector also visits every other
cell that a linked vector could lie in: two linked unit vectors are at most
``sqrt(2 - 2 * threshold)`` apart, so a vector visits a cell when it is no farther
than that from the plane between the two centroids.  Comparing a cell's own vectors
with all that are present then finds every link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from colweave.llm.components import components
from colweave.session import materialise, ready_workers

# The k-means fit sees at most this many vectors; every vector is assigned.
FIT_ROWS = 16_384
MAX_CELLS = 1024
# Vectors that meet in one task: blocks of a cell's own and of all present.
BLOCK_ROWS = 8192
OWN, PRESENT, BOTH = 0, 1, 2


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of unit length in double precision."""
    rows = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    # Scaled first, so that very large or small components neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of spherical k-means on unit rows."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1)
        good = length > 1e-12
        centres[good] = sums[good] / length[good, None]
    return centres


def visits(rows: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own cell, and which cells ``(rows, cells)`` it has to be present in."""
    products = rows @ centres.T
    own = products.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (centres @ centres.T)))[own]
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-6
    return own, products[np.arange(len(rows)), own][:, None] - products <= reach * apart + 1e-9


def _deal(centres: np.ndarray, threshold: float, kind: str, own_blocks, present_blocks):
    """Rows of (cell, block of own, block of present, role, node, copies, vector); only counts if blocks are None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            own, present = visits(unit_rows(batch.column(2).to_pylist(), kind), centres, threshold)
            row, cell = np.nonzero(present)
            mine = own[row] == cell
            if own_blocks is None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(centres))), pa.array(np.bincount(cell[mine], minlength=len(centres))),
                     pa.array(np.bincount(cell, minlength=len(centres)))], ["cell", "own", "present"])
                continue
            # The node is a digest, so its first digits deal evenly and alike in every attempt.
            spread = np.array([int(x[:8], 16) for x in batch.column(0).to_pylist()])[row]
            a_count, b_count = own_blocks[cell], present_blocks[cell]
            single = (a_count == 1) & (b_count == 1)
            parts = [(row[single], cell[single], np.zeros(single.sum(), int), np.zeros(single.sum(), int),
                      np.where(mine[single], BOTH, PRESENT))]
            for many, role, counts, others in ((~single & mine, OWN, a_count, b_count), (~single, PRESENT, b_count, a_count)):
                times = others[many]
                at = np.repeat(np.flatnonzero(many), times)
                other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                block = spread[at] % counts[at]
                a, b = (block, other) if role == OWN else (other, block)
                parts.append((row[at], cell[at], a, b, np.full(len(at), role)))
            row, cell, a, b, role = (np.concatenate(x) for x in zip(*parts))
            for low in range(0, len(row), 20_000):
                cut = slice(low, low + 20_000)
                take = pa.array(row[cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[cut]), pa.array(a[cut]), pa.array(b[cut]), pa.array(role[cut].astype(np.int32)),
                     batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)],
                    ["cell", "a", "b", "role", "node", "copies", "vector"])

    return run


def link_block(own: np.ndarray, present: np.ndarray, same: np.ndarray, copies: np.ndarray, threshold: float):
    """Links between own and present unit rows: ``(counts of own, class of present)``.

    ``same[i]`` is own row i's place among the present rows, or -1.  Counts add the
    copies of linked rows other than itself; two present rows linked through own rows
    get the same class.  Products are screened in single precision and decided in
    double, a strip at a time.
    """
    counts = np.zeros(len(own), dtype=np.int64)
    label = np.arange(len(present) + len(own))
    at_own = np.where(same >= 0, same, len(present) + np.arange(len(own)))
    small_own, small_present = own.astype(np.float32), present.astype(np.float32).T.copy()
    for low in range(0, len(own), 256):
        i, j = np.nonzero(small_own[low:low + 256] @ small_present >= threshold - 1e-4)
        i += low
        apart = at_own[i] != j
        i, j = i[apart], j[apart]
        for part in range(0, len(i), 1 << 16):
            x, y = i[part:part + (1 << 16)], j[part:part + (1 << 16)]
            near = np.einsum("nd,nd->n", own[x], present[y]) >= threshold
            x, y = x[near], y[near]
            np.add.at(counts, x, copies[y])
            _join(label, at_own[x], y)
    return counts, label


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped


def _compare(threshold: float, kind: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = unit_rows(list(group["vector"]), kind)
        role = group["role"].to_numpy()
        node = group["node"].to_numpy()
        own_at, present_at = np.flatnonzero(role != PRESENT), np.flatnonzero(role != OWN)
        place = {name: k for k, name in enumerate(node[present_at])}
        same = np.array([place.get(name, -1) for name in node[own_at]], dtype=np.int64)
        counts, label = link_block(rows[own_at], rows[present_at], same, group["copies"].to_numpy()[present_at], threshold)
        names = np.concatenate([node[present_at], node[own_at]])
        moved = np.flatnonzero(label != np.arange(len(label)))
        linked = counts > 0
        return pd.concat([
            pd.DataFrame({"node": node[own_at][linked], "links": counts[linked], "other": None}),
            pd.DataFrame({"node": names[moved], "links": 0, "other": names[label[moved]]})])

    return run


def embedding_components(vectors: DataFrame, threshold: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors(vec_id, embedding)``.

    Vectors link at a cosine of ``threshold`` or more, in double precision, whatever
    their other columns.  ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id reachable, ``kept`` marks
    ``vec_id = component_id``: one representative per group (all rows that repeat its id).

    A vector that is null, empty, all zero, or holds a null, NaN or infinite component
    links with nothing and is its own component, as does a row without a vec_id (its
    component is null, ``kept`` false).  Vectors of different lengths count as padded
    with zeros.  Equal vectors are compared once and counted as often as they stand;
    for each vector beyond that the work grows with the vectors near its cell.

    k-means is fitted on at most ``FIT_ROWS`` vectors (smallest hashes); cells grow in
    number with the square root of the input, up to ``MAX_CELLS``.  A cell with more
    than ``block_rows`` vectors is compared as pairs of blocks in separate tasks.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(
        vectors.schema["embedding"].dataType.elementType, FloatType)
    kind, part = ("<f4", "float") if single else ("<f8", "double")
    finite = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
                    " AND exists(embedding, x -> x <> 0)")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{part}>").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    width = base.where(usable).agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1):
                if not row.is_valid:
                    out.append(None)
                    continue
                padded = np.zeros(width, dtype=kind)
                values = row.values.to_numpy(zero_copy_only=False)
                padded[:len(values)] = values
                # Adding zero makes -0.0 plain zero.
                out.append((padded + 0).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vector"])

    flat = ready_workers(base).select("vec_id", F.when(usable, F.col("embedding")).alias("embedding")).mapInArrow(
        to_bytes, "vec_id long, vector binary")
    named = materialise(flat.withColumn("node", F.md5("vector")))
    distinct = materialise(named.where("node IS NOT NULL").groupBy("node")
                           .agg(F.count("*").alias("copies"), F.first("vector").alias("vector"), F.min("vec_id").alias("least_id")))
    count = distinct.count()
    cells = max(1, min(MAX_CELLS, math.ceil(math.sqrt(count / 128))))
    # The node is a digest: its first digits are a fair draw.
    limit = min(1.0, 1.5 * FIT_ROWS / count) * (1 << 32)
    sample = (distinct.where(F.conv(F.substring("node", 1, 8), 16, 10).cast("long") <= int(limit))
              .orderBy("node").limit(FIT_ROWS).select("vector").toPandas())
    centres = fit_cells(unit_rows(list(sample["vector"]), kind), cells)
    rows = ready_workers(distinct).select("node", "copies", "vector")
    sizes = (rows.mapInArrow(_deal(centres, threshold, kind, None, None), "cell long, own long, present long")
             .groupBy("cell").agg(F.sum("own").alias("own"), F.sum("present").alias("present")).toPandas())
    own_blocks, present_blocks = np.ones(len(centres), dtype=np.int64), np.ones(len(centres), dtype=np.int64)
    at = sizes["cell"].to_numpy(dtype=np.int64)
    own_blocks[at] = np.maximum(1, -(-sizes["own"].to_numpy(dtype=np.int64) // block_rows))
    present_blocks[at] = np.maximum(1, -(-sizes["present"].to_numpy(dtype=np.int64) // block_rows))
    dealt = rows.mapInArrow(_deal(centres, threshold, kind, own_blocks, present_blocks),
                            "cell long, a long, b long, role int, node string, copies long, vector binary")
    found = materialise(dealt.groupBy("cell", "a", "b").applyInPandas(
        _compare(threshold, kind), "node string, links long, other string"))
    links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classed = (distinct.select("node", "copies", "least_id").join(links, "node", "left").join(roots, "node", "left")
               .select("node", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                       F.coalesce("root", "node").alias("class")))
    least = classed.groupBy("class").agg(F.min("least_id").alias("component"))
    labels = materialise(classed.join(least, "class").select("node", "links", "component"))
    component = F.coalesce("component", "vec_id")
    return (named.join(labels, "node", "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")))
