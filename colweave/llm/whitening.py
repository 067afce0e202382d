"""Embedding whitening from a covariance found by polarisation.

Entries are whole numbers, so every sum here is exact.  Tasks add up the squares of
``n * x - S`` for each dimension and of ``(n * x_i - S_i) + (n * x_j - S_j)`` for each pair
of dimensions.  The square of a pair's sum less the squares of its two parts is twice
the product, so the cross-covariances follow from squares alone; the driver assembles
the matrix (dimensions squared, whatever the number of rows) and takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType, UserDefinedType

from colweave.session import materialise, ready_workers

SCALE, OFFSET = 1024, 100_000
# Scaled entries beyond this are held at it; any entry below 4e15 is exact.
LARGEST = 1 << 62
BLOCK_ROWS = 1024
# Squares are summed in limbs of this many bits, sums travel in digits of that many.
LIMB, DIGIT = 26, 40
COMPONENTS = 8
# A component whose eigenvalue is no more than this share of the trace has no direction of its own.
LEAST_SHARE = 1e-13


class WholeNumber(UserDefinedType):
    """Whole numbers of any size, past the 38 digits of decimals: ``int`` in Python, digits as a string in Spark."""

    @classmethod
    def sqlType(cls) -> StringType:
        return StringType()

    @classmethod
    def module(cls) -> str:
        return __name__

    def serialize(self, obj: int | None) -> str | None:
        return None if obj is None else str(obj)

    def deserialize(self, datum: str | None) -> int | None:
        return None if datum is None else int(datum)


def whole_entries(column: pa.Array, width: int) -> np.ndarray:
    """``floor(1024 * c) + 100000`` of each entry; a shorter vector counts as padded with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    c = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), size)
    c[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    # Clipped before it is scaled, so that nothing overflows.
    scaled = np.floor(SCALE * np.clip(c, -LARGEST / SCALE, LARGEST / SCALE))
    return scaled.astype(np.int64) + OFFSET


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python integers."""
    high, low = x >> 31, x & ((1 << 31) - 1)
    return [(int(h) << 31) + int(v) for h, v in zip(high.sum(axis=0), low.sum(axis=0))]


def square_sums(z: np.ndarray) -> list[int]:
    """Column sums of the squares, exact: at most ``BLOCK_ROWS`` rows of integers of any size."""
    if z.dtype == object:
        return [int(v) for v in (z * z).sum(axis=0)] if len(z) else [0] * z.shape[1]
    limbs, rest = [], z
    bits = int(np.abs(z).max(initial=0)).bit_length() + 1
    while bits > LIMB:
        limbs.append(rest & ((1 << LIMB) - 1))
        rest, bits = rest >> LIMB, bits - LIMB
    limbs.append(rest)
    out = [0] * z.shape[1]
    for i, a in enumerate(limbs):
        for j in range(i, len(limbs)):
            part = np.einsum("rc,rc->c", a, limbs[j])
            shift = LIMB * (i + j) + (i != j)
            out = [total + (int(v) << shift) for total, v in zip(out, part)]
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``; Python integers where 64 bits might not hold a sum of two of them."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 61:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def pair_slot(i: int, j: int, width: int) -> int:
    """The number of the pair ``i <= j``; ``i == j`` is the dimension itself."""
    return i * width - i * (i - 1) // 2 + j - i


def _digits(slots: list[int], values: list[int]) -> pa.RecordBatch:
    """Rows ``(slot, digit, value)`` whose sums, digit by digit, are sums of ``values``."""
    rows = []
    for slot, value in zip(slots, values):
        sign, value, digit = (-1 if value < 0 else 1), abs(value), 0
        while value:
            rows.append((slot, digit, sign * (value & ((1 << DIGIT) - 1))))
            value, digit = value >> DIGIT, digit + 1
    slot, digit, value = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(digit, pa.int32()), pa.array(value, pa.int64())],
                                      ["slot", "digit", "value"])


def _added(parts: DataFrame, size: int) -> list[int]:
    """The sums of all tasks, as Python integers: a few rows a slot come to the driver."""
    out = [0] * size
    for r in parts.groupBy("slot", "digit").agg(F.sum("value").alias("value")).collect():
        out[r["slot"]] += r["value"] << (DIGIT * r["digit"])
    return out


@dataclass
class Whitening:
    """The fit: ``axes`` holds the components as columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    axes: np.ndarray

    @property
    def explained(self) -> list[float | None]:
        trace = float(np.trace(self.covariance))
        return [float(v) / trace if trace > 0 else None for v in self.values]


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vector)`` without rows whose vector is null or holds a null, NaN or infinite entry."""
    base = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return base.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))


def fit(usable: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Means, covariance and components of all rows of ``usable``; None without rows or dimensions."""
    n, width = usable.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n or not width:
        return None
    column = ready_workers(usable).select("vector")

    def add_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                block = exact_sums(whole_entries(batch.column(0).slice(low, BLOCK_ROWS), width))
                total = [a + b for a, b in zip(total, block)]
        yield _digits(list(range(width)), total)

    schema = "slot long, digit int, value long"
    sums = _added(column.mapInArrow(add_entries, schema), width)

    def add_squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (width - i) for i in range(width)]
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                y = centred(whole_entries(batch.column(0).slice(low, BLOCK_ROWS), width), n, sums)
                for i in range(width):
                    # The dimension itself, then its sum with each later one.
                    z = y[:, i:].copy()
                    z[:, 1:] += y[:, i:i + 1]
                    total[i] = [a + b for a, b in zip(total[i], square_sums(z))]
        for i in range(width):
            yield _digits(list(range(pair_slot(i, i, width), pair_slot(i, i, width) + width - i)), total[i])

    squares = _added(column.mapInArrow(add_squares, schema), width * (width + 1) // 2)
    covariance = np.zeros((width, width))
    for i in range(width):
        own = squares[pair_slot(i, i, width)]
        covariance[i, i] = float(Fraction(own, n ** 3))
        for j in range(i + 1, width):
            twice = squares[pair_slot(i, j, width)] - own - squares[pair_slot(j, j, width)]
            covariance[i, j] = covariance[j, i] = float(Fraction(twice, 2 * n ** 3))
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    # Of the two signs, the one with a positive largest entry.
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    return Whitening(n, sums, covariance, values, axes)


def project(usable: DataFrame, model: Whitening) -> DataFrame:
    """``(vec_id, deviation, whitened)`` per row: the exact squared distance from the mean times n, and the projections.

    ``deviation`` is a :class:`WholeNumber`; a projection on an axis without variance is null.
    """
    n, sums, width = model.n, model.sums, len(model.sums)
    some = model.values > LEAST_SHARE * max(float(np.trace(model.covariance)), 0.0)
    scaled = np.where(some, model.axes / np.sqrt(np.where(some, model.values, 1.0)), np.nan)
    schema = StructType([usable.schema["vec_id"], StructField("deviation", WholeNumber()),
                         StructField("whitened", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                y = centred(whole_entries(part.column(1), width), n, sums)
                far = square_sums(np.ascontiguousarray(y.T))
                values = pa.array([str(v) for v in far], pa.string())
                at = (y / n).astype(np.float64) @ np.nan_to_num(scaled)
                flat = pa.array(np.where(some, at, 0.0).ravel(), mask=np.broadcast_to(~some, at.shape).ravel())
                rows = pa.ListArray.from_arrays(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), values, rows], schema.names)

    return ready_workers(usable).select("vec_id", "vector").mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per row and component.

    Rows of ``vectors(vec_id, embedding)`` whose vector is null or holds a null, NaN or
    infinite entry are dropped; all others are the fit list, repeated rows and rows
    without a vec_id too.  Vectors shorter than the longest, empty ones included, count
    as padded with zeros; entries beyond 4e15 are held there.  Other columns are ignored.
    Without rows, or if all vectors are empty, the result is empty.

    There are ``min(components, dimensions)`` components.  On one without variance (equal
    vectors, fewer rows than dimensions) ``whitened`` is null; ``explained`` is null if
    nothing varies, and ``identity_error`` covers the components with variance (null if
    none has).  Equal eigenvalues may turn their axes.  ``deviation`` is a
    :class:`WholeNumber`; its cast to a string gives the digits.
    """
    usable = usable_vectors(vectors)
    model = fit(usable, components)
    names = "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    if model is None:
        return usable.where("false").select(
            "vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in zip(
                names[1:], ("int", "long", WholeNumber(), "double", "double", "double"))))
    count = len(model.values)
    # Written once: the check of the fit and the result both read it.
    rows = materialise(project(usable, model))
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    found = rows.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    errors = [abs(v - (i == j)) for (i, j), v in zip(pairs, found) if v is not None]
    listed = (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
              .withColumn("component", (F.col("at") + 1).cast("int")))
    shares = F.array(*(F.lit(v).cast("double") for v in model.explained))
    return listed.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                         shares[F.col("at")].alias("explained"), F.lit(max(errors) if errors else None).cast("double").alias("identity_error"))
