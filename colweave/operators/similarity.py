"""Pairwise similarity between columns: correlation, cosine and inner products.

Narrow tables use one wide aggregate (no explode, partial aggregation before
the only shuffle).  Wide tables multiply Arrow blocks inside the scan tasks and
add up N x N partial sums, so the data itself is never shuffled either way.
Both forms take NaN as missing and a NULL station as a station.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.stats import cosine, join_station, normalise_nan, null_if_zero, pearson
from colweave.session import materialise, ready_workers

# Columns up to which one aggregate with N(N-1)/2 expressions stays in codegen.
WIDE_LIMIT = 12
# Columns of a block; a task holds the sums of the pairs between two blocks.
TILE_COLS = 512
# Bytes of partial sums a task may hold before it hands them downstream.
PARTIAL_BYTES = 128 * 1024 * 1024

PARTIAL_SCHEMA = ("station string, i int, j int, n double, sx double, sy double, "
                  "sxx double, syy double, sxy double")


def _label(cols: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in cols]), index + 1)


def _wide_pairs(df: DataFrame, cols: list[str], expr, diagonal: bool) -> DataFrame:
    """One row per station and pair from one aggregate with an expression per pair."""
    index = [(i, j) for i, j in combinations(range(len(cols)), 2)]
    if diagonal:
        index += [(i, i) for i in range(len(cols))]
    wide = normalise_nan(df.select("station", *cols)).groupBy("station").agg(
        *[expr(F.col(cols[i]), F.col(cols[j])).alias(f"p{i}_{j}") for i, j in index])
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("source"),
                 F.lit(cols[j]).alias("target"), F.col(f"p{i}_{j}").alias("value"))
        for i, j in index])
    return wide.select("station", F.inline(cells))


def _tile_sums(left: list[int], right: list[int]):
    """Arrow batches of (station, left columns, right columns) -> partial sums per station and pair.

    ``left`` and ``right`` are column numbers; where they are the same, each pair counts once.
    """
    same = left == right
    at_i, at_j = np.triu_indices(len(left)) if same else np.indices((len(left), len(right))).reshape(2, -1)
    names_i, names_j = pa.array(np.array(left, dtype=np.int32)[at_i]), pa.array(np.array(right, dtype=np.int32)[at_j])

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for station, sums in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([station] * len(at_i), pa.string()), names_i, names_j, *(pa.array(x[at_i, at_j]) for x in sums)],
                names=["station", "i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    def matrix(column: pa.Array, rows: int, width: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        room = max(1, PARTIAL_BYTES // (6 * 8 * len(left) * len(right)))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column(1), batch.num_rows, len(left))
            y = x if same else matrix(batch.column(2), batch.num_rows, len(right))
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            keys = codes.dictionary.to_pylist()
            order = np.argsort(codes.indices.to_numpy(), kind="stable")
            bounds = np.searchsorted(codes.indices.to_numpy()[order], np.arange(len(keys) + 1))
            for pos, key in enumerate(keys):
                rows = order[bounds[pos]:bounds[pos + 1]]
                a = x[rows]
                in_a, a = (~np.isnan(a)).astype(np.float64), np.nan_to_num(a, nan=0.0)
                # The sum of a column over the rows where the other one is present too.
                if same:
                    sx, sxx = a.T @ in_a, (a * a).T @ in_a
                    sums = in_a.T @ in_a, sx, sx.T, sxx, sxx.T, a.T @ a
                else:
                    b = y[rows]
                    in_b, b = (~np.isnan(b)).astype(np.float64), np.nan_to_num(b, nan=0.0)
                    sums = in_a.T @ in_b, a.T @ in_b, in_a.T @ b, (a * a).T @ in_b, in_a.T @ (b * b), a.T @ b
                old = held.get(key)
                held[key] = sums if old is None else tuple(p + q for p, q in zip(old, sums))
            if len(held) >= room:
                yield from flush(held)
                held = {}
        yield from flush(held)

    return run


def _tile(df: DataFrame, cols: list[str], left: list[int], right: list[int], centred: bool) -> DataFrame:
    """Partial sums of the pairs between two blocks of columns, from a scan of these columns alone."""
    used = [cols[k] for k in (left if left == right else left + right)]
    part = normalise_nan(df.select("station", *used))
    if not centred:
        means = materialise(part.groupBy("station").agg(*[F.avg(c).alias(f"{c}__m") for c in used]))
        part = join_station(part, means)

    def values(block: list[int]) -> Column:
        return F.array(*[F.col(cols[k]).cast("double") if centred else F.col(cols[k]) - F.col(f"{cols[k]}__m") for k in block])

    sides = [values(left).alias("x")] + ([] if left == right else [values(right).alias("y")])
    blocks = part.select(F.col("station").cast("string").alias("station"), *sides)
    return ready_workers(blocks).mapInArrow(_tile_sums(left, right), PARTIAL_SCHEMA)


def pair_sums(df: DataFrame, cols: list[str], centred: bool = False, tile: int = TILE_COLS) -> DataFrame:
    """Sums over rows where both columns are present, for every pair i <= j.

    ``centred`` says the columns already have mean near 0.  Otherwise each
    station's column means are subtracted first so large offsets do not cancel;
    correlation does not change under that shift.

    More than ``tile`` columns are cut into blocks and each pair of blocks is a scan of
    its own columns, so a task holds sums of a tile of pairs however wide the table is.
    """
    blocks = [list(range(low, min(low + tile, len(cols)))) for low in range(0, len(cols), tile)]
    partial = reduce(lambda a, b: a.unionAll(b), [
        _tile(df, cols, left, right, centred) for k, left in enumerate(blocks) for right in blocks[k:]])
    return partial.groupBy("station", "i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def _named(pairs: DataFrame, cols: list[str], value: Column, name: str) -> DataFrame:
    return pairs.select(
        "station", "i", "j",
        _label(cols, F.col("i")).alias("source"), _label(cols, F.col("j")).alias("target"),
        value.alias(name))


def pearson_pairs(df: DataFrame, cols: list[str], centred: bool = False,
                  complete: bool = False, wide_limit: int = WIDE_LIMIT) -> DataFrame:
    """Pairwise-complete Pearson per station for i < j: ``(station,i,j,source,target,r)``."""
    if len(cols) <= wide_limit:
        pairs = _wide_pairs(df, cols, lambda a, b: pearson(a, b, complete), diagonal=False)
        return pairs.withColumnRenamed("value", "r")
    return pairs_from_sums(pair_sums(df, cols, centred), cols)


def pairs_from_sums(sums: DataFrame, cols: list[str]) -> DataFrame:
    """Correlations of pairs i < j from the sums of one pass."""
    n = null_if_zero(F.col("n"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    var_a = F.col("sxx") - F.col("sx") * F.col("sx") / n
    var_b = F.col("syy") - F.col("sy") * F.col("sy") / n
    # Rounding can leave a constant column a tiny residue; below it the pair is undefined.
    floor = F.lit(1e-14)
    ok = (var_a > floor * F.col("sxx")) & (var_b > floor * F.col("syy"))
    r = F.when(ok, F.greatest(F.least(cov / F.sqrt(null_if_zero(var_a * var_b)), F.lit(1.0)), F.lit(-1.0)))
    return _named(sums.where("i < j"), cols, F.coalesce(r, F.lit(0.0)), "r")


def grams_from_sums(sums: DataFrame, cols: list[str]) -> DataFrame:
    """Inner products of pairs i <= j from the sums of one pass over centred columns."""
    return _named(sums, cols, F.col("sxy"), "g")


def cosine_pairs(df: DataFrame, cols: list[str], wide_limit: int = WIDE_LIMIT) -> DataFrame:
    """Cosine similarity of columns per station for i < j, named ``r`` like correlation."""
    if len(cols) <= wide_limit:
        return _wide_pairs(df, cols, cosine, diagonal=False).withColumnRenamed("value", "r")
    return cosines_from_grams(gram_matrix(df, cols, wide_limit))


def cosines_from_grams(grams: DataFrame) -> DataFrame:
    """Cosine similarities for i < j from inner products, named ``r`` like correlation."""
    diag = grams.where("i = j").select("station", F.col("i").alias("d"), F.col("g").alias("sq"))
    left = diag.select(F.col("station").alias("station_i"), F.col("d").alias("d_i"), F.col("sq").alias("sq_i"))
    right = diag.select(F.col("station").alias("station_j"), F.col("d").alias("d_j"), F.col("sq").alias("sq_j"))
    of_i = F.col("station").eqNullSafe(F.col("station_i")) & (F.col("i") == F.col("d_i"))
    of_j = F.col("station").eqNullSafe(F.col("station_j")) & (F.col("j") == F.col("d_j"))
    value = F.col("g") / null_if_zero(F.sqrt("sq_i") * F.sqrt("sq_j"))
    return (grams.where("i < j").join(left, of_i).join(right, of_j)
            .select("station", "i", "j", "source", "target", F.coalesce(value, F.lit(0.0)).alias("r")))


def gram_matrix(df: DataFrame, cols: list[str], wide_limit: int = WIDE_LIMIT) -> DataFrame:
    """Inner products of columns for i <= j, missing counted as 0: ``(...,g)``."""
    if len(cols) <= wide_limit:
        pairs = _wide_pairs(df, cols, lambda a, b: F.coalesce(F.sum(a * b), F.lit(0.0)), diagonal=True)
        return pairs.withColumnRenamed("value", "g")
    return grams_from_sums(pair_sums(df, cols, centred=True), cols)


def row_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("station").agg(F.count(F.lit(1)).alias("rows"))
