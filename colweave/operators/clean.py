"""Row dedupe, missing values and the three column drops.

Each drop is a small table ``(station, column, reason)``: a column may leave one
station and stay in another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.stats import is_float, is_infinite, missing_if_not_finite
from colweave.operators.roles import IDENTIFIER, NUMERIC, SEQUENCE, TIMESTAMP
from colweave.session import materialise

# Roles that the sparse and constant drops leave alone.
PROTECTED = (TIMESTAMP, IDENTIFIER, SEQUENCE)


def dedupe_rows(df: DataFrame, cols: list[str], row_id: str = "row_id") -> DataFrame:
    """One row per distinct content, the first by ``row_id``; NULLs are equal."""
    kept = df.groupBy("station", *cols).agg(F.min(row_id).alias(row_id))
    return kept.select("station", row_id, *cols)


def infinite_to_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: missing_if_not_finite(F.col(c)) for c in cols if is_float(df.schema[c].dataType)})


def infinite_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    counts = df.groupBy("station").agg(*[
        F.count(F.when(is_infinite(F.col(c)), 1)).alias(f"n_{i}") for i, c in enumerate(cols)])
    return counts.select("station", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("infinite")) for i, c in enumerate(cols)])))


def _column_measure(df: DataFrame, cols: list[str], measure, name: str) -> DataFrame:
    wide = df.groupBy("station").agg(*[measure(c).alias(f"m_{i}") for i, c in enumerate(cols)])
    return wide.select("station", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").cast("double").alias(name))
        for i, c in enumerate(cols)])))


def _unprotected(measures: DataFrame, roles: DataFrame | None) -> DataFrame:
    if roles is None:
        return measures
    guarded = roles.where(F.col("role").isin(*PROTECTED)).select("station", "column")
    return measures.join(guarded, ["station", "column"], "left_anti")


def sparse_columns(df: DataFrame, cols: list[str], threshold: float, roles: DataFrame | None = None) -> DataFrame:
    """Columns whose share of missing values is above the threshold."""
    ratios = _column_measure(df, cols, lambda c: F.avg(F.col(c).isNull().cast("double")), "null_ratio")
    return _unprotected(ratios, roles).where(F.col("null_ratio") > threshold)


def constant_columns(df: DataFrame, cols: list[str], threshold: float, roles: DataFrame | None = None) -> DataFrame:
    """Numeric columns whose population variance is undefined or at most the threshold."""
    variances = _column_measure(df, cols, F.var_pop, "variance")
    return _unprotected(variances, roles).where(
        F.col("variance").isNull() | (F.col("variance") <= threshold))


def redundant_columns(pairs: DataFrame, threshold: float) -> DataFrame:
    """Columns that correlate above the threshold with any earlier column.

    The earlier column counts even when it is dropped itself.
    """
    return (pairs.where(F.abs("r") > threshold)
            .groupBy("station", F.col("target").alias("column"))
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "source"))),
                             lambda s: s["source"]).alias("correlated_with")))


def selected_features(roles: DataFrame, drops: DataFrame) -> DataFrame:
    """Numeric features that survived the drops: the graph nodes."""
    return (roles.where(F.col("role") == NUMERIC).select("station", "column", "idx")
            .join(drops.select("station", "column").distinct(), ["station", "column"], "left_anti"))


def feature_guard(features: DataFrame, stations: DataFrame) -> DataFrame:
    """Feature count per station with its status: below 2 fails, below 3 has no embeddings."""
    n = F.coalesce(F.col("features"), F.lit(0))
    counts = features.groupBy("station").agg(F.count(F.lit(1)).alias("features"))
    return stations.select("station").distinct().join(counts, "station", "left").select(
        "station", n.alias("features"),
        F.when(n < 2, "Failed").otherwise("Success").alias("status"),
        (n < 3).alias("embeddings_skipped"),
        F.when(n < 2, "insufficient features").when(n < 3, "embeddings skipped")
        .when(n < 5, "fewer than 5 nodes").when(n < 10, "fewer than 10 nodes").otherwise("").alias("warning"))


def split_by_status(reports: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Successful and failed stations; strict mode raises when any failed."""
    failed = reports.where("status = 'Failed'")
    if strict:
        count = failed.count()
        if count:
            raise RuntimeError(f"{count} station(s) failed in strict mode.")
    return reports.where("status <> 'Failed'"), failed


def apply_drops(df: DataFrame, drops: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Blank dropped columns per station; remove those that every station drops.

    Returns the table and the columns that are left.
    """
    if not drops.limit(1).count():
        return df, cols
    flags = materialise(
        df.select("station").distinct()
        .join(drops.groupBy("station").agg(F.collect_set("column").alias("gone")), "station", "left"))
    everywhere = flags.agg(*[
        F.bool_and(F.coalesce(F.array_contains("gone", c), F.lit(False))).alias(f"g_{i}")
        for i, c in enumerate(cols)]).first()
    left = [c for i, c in enumerate(cols) if not everywhere[i]]
    removed = [c for c in cols if c not in left]
    blank = {c: F.when(~F.coalesce(F.array_contains("gone", c), F.lit(False)), F.col(c)) for c in left}
    if not blank:
        return df.drop(*removed), left
    return df.drop(*removed).join(flags, "station").withColumns(blank).drop("gone"), left
