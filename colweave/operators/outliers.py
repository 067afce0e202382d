"""Outlier treatment of numeric features by fences, z-scores or an isolation forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.stats import clamp, join_station
from colweave.operators import profile
from colweave.operators.quantiles import exact_percentiles
from colweave.session import GROUP_ROW_LIMIT, materialise


def outlier_report(df: DataFrame, cols: list[str], method: str, limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Columns with outliers: ``(station, column, outliers, lower_bound, upper_bound)``."""
    found = (profile.iqr_outliers(df, cols, limit) if method == "iqr" else profile.zscore_outliers(df, cols))
    return found.where("outliers > 0")


def treat_outliers(df: DataFrame, cols: list[str], method: str, treatment: str,
                   limit: int = GROUP_ROW_LIMIT, report: DataFrame | None = None) -> DataFrame:
    """Clip to the bounds, or winsorise every value to the 1st and 99th percentile.

    Both act only on columns that have an outlier in the station.  A ``report``
    of the same rows saves finding them again.
    """
    if treatment == "none" or not cols:
        return df
    if report is None:
        report = outlier_report(df, cols, method, limit)
    bounds = report.groupBy("station").agg(*[
        agg for c in cols for agg in (
            F.max(F.when(F.col("column") == c, F.col("lower_bound"))).alias(f"_lo_{c}"),
            F.max(F.when(F.col("column") == c, F.col("upper_bound"))).alias(f"_hi_{c}"))])
    if treatment == "winsorize":
        tails = exact_percentiles(df, cols, [0.01, 0.99], limit)
        tails = tails.select("station", *[F.col(c).alias(f"_q_{c}") for c in cols])
        bounds = join_station(bounds, tails).withColumns({
            name: F.when(F.col(f"_lo_{c}").isNotNull(), F.col(f"_q_{c}")[side])
            for c in cols for side, name in ((0, f"_lo_{c}_w"), (1, f"_hi_{c}_w"))})
        bounds = bounds.select("station", *[
            col for c in cols for col in (F.col(f"_lo_{c}_w").alias(f"_lo_{c}"), F.col(f"_hi_{c}_w").alias(f"_hi_{c}"))])
    joined = join_station(df, materialise(bounds), "left")
    treated = {c: F.when(F.col(f"_lo_{c}").isNotNull(),
                         clamp(F.col(c).cast("double"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")))
               .otherwise(F.col(c).cast("double")) for c in cols}
    return joined.withColumns(treated).select(*df.columns)
