"""Missing value strategies: time interpolation, nearest neighbours, median and mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.stats import is_numeric, join_station
from colweave.operators.neighbours import impute_knn
from colweave.operators.ordered import fill_both_ways, interpolate_in_time
from colweave.operators.quantiles import medians, value_modes
from colweave.session import GROUP_ROW_LIMIT, materialise

MISSING_TEXT = "missing"


def choose_strategy(stations: DataFrame, setting: str) -> DataFrame:
    """``(station, has_timestamp)`` -> the strategy each station uses.

    ``auto`` interpolates where there is a time column and takes the median elsewhere;
    the number of rows never picks the strategy.
    """
    chosen = F.when(F.col("has_timestamp"), "interpolate").otherwise("median") if setting == "auto" else F.lit(setting)
    return stations.withColumn("strategy", chosen)


def impute_median_mode(df: DataFrame, cols: list[str], limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Numbers take the median (0.0 if undefined), others the mode ('missing' if undefined)."""
    numbers = [c for c in cols if is_numeric(df.schema[c].dataType)]
    texts = [c for c in cols if c not in numbers]
    out = df
    if numbers:
        fills = materialise(medians(df, numbers, limit).select("station", *[F.col(c).alias(f"_m_{c}") for c in numbers]))
        out = join_station(out, fills).withColumns(
            {c: F.coalesce(F.col(c).cast("double"), f"_m_{c}") for c in numbers}).drop(*[f"_m_{c}" for c in numbers])
    if texts:
        modes = value_modes(df, texts).groupBy("station").agg(*[
            F.coalesce(F.max(F.when(F.col("column") == c, F.col("value"))), F.lit(MISSING_TEXT)).alias(f"_m_{c}")
            for c in texts])
        out = join_station(out, materialise(modes)).withColumns(
            {c: F.coalesce(c, f"_m_{c}") for c in texts}).drop(*[f"_m_{c}" for c in texts])
    return out.select(*df.columns)


def impute_in_time(df: DataFrame, cols: list[str], ts: str = "ts", limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Numbers are interpolated over time, others filled forward then backward."""
    numbers = [c for c in cols if is_numeric(df.schema[c].dataType)]
    texts = [c for c in cols if c not in numbers]
    out = interpolate_in_time(df, numbers, ts, limit) if numbers else df
    return (fill_both_ways(out, texts, ts, limit) if texts else out).select(*df.columns)


def impute(df: DataFrame, cols: list[str], strategies: DataFrame, ts: str = "ts",
           limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Impute each station with its own strategy; ``cols`` are the eligible columns."""
    if not cols:
        return df
    chosen = materialise(strategies.select("station", "strategy"))
    # At most four names.
    present = sorted(r["strategy"] for r in chosen.select("strategy").distinct().collect())
    numbers = [c for c in cols if is_numeric(df.schema[c].dataType)]
    texts = [c for c in cols if c not in numbers]
    # One result type for all branches.
    df = df.withColumns({c: F.col(c).cast("double") for c in numbers})
    parts = []
    for strategy in present:
        rows = df.join(chosen.where(F.col("strategy") == strategy), "station", "left_semi")
        if strategy == "interpolate":
            parts.append(impute_in_time(rows, cols, ts, limit))
        elif strategy == "knn" and numbers:
            near = impute_knn(rows, numbers)
            parts.append(impute_median_mode(near, texts, limit) if texts else near)
        else:
            parts.append(impute_median_mode(rows, cols, limit))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
