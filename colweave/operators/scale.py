"""Standard scaling per station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.stats import join_station, null_if_zero
from colweave.session import materialise


def scaling_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per station: mean and population deviation of each column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.groupBy("station").agg(*aggs)


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(x - mean) / std`` with the population deviation; constant columns become 0.

    The statistics are one small row per station.  They are written once, so the
    join broadcasts them when they are small and shuffles when there are very
    many stations.  All other columns pass through untouched.
    """
    if not cols:
        return df
    stats = materialise(scaling_stats(df, cols))
    joined = join_station(df, stats)
    scaled = {
        c: (F.col(c) - F.col(f"{c}__mean")) / F.coalesce(null_if_zero(F.col(f"{c}__std")), F.lit(1.0))
        for c in cols
    }
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])
