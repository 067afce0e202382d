"""Guarded column expressions: no NaN leaves them and no division raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)
INTEGERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOATS)


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGERS)


def is_numeric(dtype: T.DataType) -> bool:
    return is_float(dtype) or is_integer(dtype)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def null_if_zero(value: Column) -> Column:
    return F.when(value != 0, value)


def missing_if_not_finite(value: Column) -> Column:
    """NaN and +-inf become NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def is_infinite(value: Column) -> Column:
    return F.coalesce(F.abs(value) == F.lit(float("inf")), F.lit(False))


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float column, so aggregates see one kind of missing."""
    return df.withColumns({
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields if is_float(f.dataType)
    })


def join_station(df: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` with the columns of a per-station table; a NULL station is a station too."""
    own = small.withColumnRenamed("station", "_own_station")
    return df.join(own, F.col("station").eqNullSafe(F.col("_own_station")), how).drop("_own_station")


def pearson(a: Column, b: Column, complete: bool = False) -> Column:
    """Pairwise-complete Pearson correlation as an aggregate; undefined gives 0.

    ``complete`` says neither side holds NULL, so one deviation per column is
    shared by all its pairs.
    """
    left = a if complete else F.when(b.isNotNull(), a)
    right = b if complete else F.when(a.isNotNull(), b)
    scale = null_if_zero(F.stddev_pop(left) * F.stddev_pop(right))
    r = F.covar_pop(a, b) / scale
    # Rounding can carry a perfect correlation past 1; least and greatest would skip an undefined one.
    return F.coalesce(clamp(r, F.lit(-1.0), F.lit(1.0)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two columns as an aggregate; a zero column gives 0."""
    scale = null_if_zero(F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b)))
    return F.coalesce(F.sum(a * b) / scale, F.lit(0.0))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, high), low))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)
