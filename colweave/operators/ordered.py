"""Operators that depend on row order within a station.

A station may hold a third of all rows, so a window over a whole station is used
only when its row count is known to be small.  Larger inputs are range
partitioned by (station, order): each range is an independent *slice*, windows
run inside slices, and one small row per slice carries state across them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colweave.session import GROUP_ROW_LIMIT, materialise, max_group_rows

SLICE = "_slice"


def sliced(df: DataFrame, keys: list[str], order: list[str],
           limit: int = GROUP_ROW_LIMIT) -> tuple[DataFrame, bool]:
    """``df`` with a slice number that grows with the order inside each group.

    Range boundaries come from sampling, so the numbered table is written before
    it is read twice.
    """
    if max_group_rows(df, keys) <= limit:
        return df.withColumn(SLICE, F.lit(0)), False
    ranged = df.repartitionByRange(*keys, *order).withColumn(SLICE, F.spark_partition_id())
    return materialise(ranged), True


def numbered(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``df`` with the row ids ``(file, block, pos)`` of loaded rows as one whole number in the same order; others stay.

    A number is compared and kept by aggregates where it stands; they would sort all rows by
    content to keep the least of a struct.  Read twice, so ``df`` has to be a written table.
    """
    kind = df.schema[row_id].dataType
    if not isinstance(kind, T.StructType) or kind.names != ["file", "block", "pos"]:
        return df
    # One row per split of a file; the places within a split count on from those before.
    splits = df.groupBy(f"{row_id}.file", f"{row_id}.block").agg(F.min(f"{row_id}.pos").alias("_least"), F.max(f"{row_id}.pos").alias("_most"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "_least", F.coalesce(
        F.sum(F.col("_most") - F.col("_least") + 1).over(before), F.lit(0)).alias("_start"))
    own = (F.col(f"{row_id}.file") == F.col("_file")) & (F.col(f"{row_id}.block") == F.col("_block"))
    return df.join(materialise(starts), own).withColumn(
        row_id, F.col("_start") + F.col(f"{row_id}.pos") - F.col("_least")).select(*df.columns)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                  limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Inclusive running sum of ``value`` in order within each group."""
    parts, many = sliced(df, keys, order, limit)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.withColumn(out, F.sum(value).over(inside))
    if many:
        before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = (parts.groupBy(*keys, SLICE).agg(F.sum(value).alias("_t"))
                 .withColumn("_carry", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t"))
        totals = (totals.join(materialise(carry), [*keys, SLICE])
                  .withColumn(out, F.col(out) + F.col("_carry")).drop("_carry"))
    return totals.drop(SLICE)


def with_neighbours(df: DataFrame, cols: list[str], ts: str = "ts", row_id: str = "row_id",
                    limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Adds ``_prev_c`` and ``_next_c``: the nearest present (time, value) at or
    before, and at or after, each row.

    The look ahead is a look back over the reversed order: a frame that ends at
    the last row would be re-evaluated for every row.
    """
    keys, order = ["station"], [ts, row_id]
    parts, many = sliced(df, keys, order, limit)
    seen = {c: F.when(F.col(c).isNotNull(),
                      F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(c).alias("v")))
            for c in cols}
    span = (Window.unboundedPreceding, 0)
    group = Window.partitionBy(*keys, SLICE)
    past = group.orderBy(*order).rowsBetween(*span)
    future = group.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(*span)
    out = parts.withColumns({f"_prev_{c}": F.last(seen[c], True).over(past) for c in cols})
    out = out.withColumns({f"_next_{c}": F.last(seen[c], True).over(future) for c in cols})
    if many:
        place = F.struct(*[F.col(c) for c in order])
        ends = parts.groupBy(*keys, SLICE).agg(*[
            agg for c in cols for agg in (
                F.max_by(seen[c], F.when(F.col(c).isNotNull(), place)).alias(f"_last_{c}"),
                F.min_by(seen[c], F.when(F.col(c).isNotNull(), place)).alias(f"_first_{c}"))])
        back = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        ahead = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(*keys, SLICE, *[
            col for c in cols for col in (
                F.last(f"_last_{c}", True).over(back).alias(f"_from_{c}"),
                F.last(f"_first_{c}", True).over(ahead).alias(f"_to_{c}"))])
        out = out.join(materialise(carry), [*keys, SLICE]).withColumns({
            **{f"_prev_{c}": F.coalesce(f"_prev_{c}", f"_from_{c}") for c in cols},
            **{f"_next_{c}": F.coalesce(f"_next_{c}", f"_to_{c}") for c in cols},
        }).drop(*[f"_from_{c}" for c in cols], *[f"_to_{c}" for c in cols])
    return out.drop(SLICE)


def _drop_neighbours(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols])


def fill_both_ways(df: DataFrame, cols: list[str], ts: str = "ts", limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Forward fill in time order, then backward fill of the leading gap."""
    out = with_neighbours(df, cols, ts, limit=limit).withColumns(
        {c: F.coalesce(F.col(f"_prev_{c}.v"), F.col(f"_next_{c}.v")) for c in cols})
    return _drop_neighbours(out, cols)


def interpolate_in_time(df: DataFrame, cols: list[str], ts: str = "ts",
                        limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Linear in elapsed time between neighbours; outer gaps take the nearest value."""
    now = F.unix_micros(F.col(ts).cast("timestamp"))

    def filled(c: str):
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = F.try_divide((now - prev["t"]).cast("double"), (nxt["t"] - prev["t"]).cast("double"))
        return F.coalesce(F.col(c).cast("double"), prev["v"] + (nxt["v"] - prev["v"]) * share, prev["v"], nxt["v"])

    out = with_neighbours(df, cols, ts, limit=limit).withColumns({c: filled(c) for c in cols})
    return _drop_neighbours(out, cols)


def sequence_tests(df: DataFrame, cols: list[str], order: list[str],
                   limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Per station and column: never decreasing, and always one more than before."""
    parts, _ = sliced(df, ["station"], order, limit)
    inside = Window.partitionBy("station", SLICE).orderBy(*order)
    steps = parts.select("station", SLICE, *order, *[F.col(c).alias(f"_v_{c}") for c in cols], *[
        (F.col(c) - F.lag(c).over(inside)).alias(f"_d_{c}") for c in cols])
    place = F.struct(*[F.col(c) for c in order])
    per_slice = steps.groupBy("station", SLICE).agg(*[
        agg for c in cols for agg in (
            F.min(f"_d_{c}").alias(f"_lo_{c}"), F.max(f"_d_{c}").alias(f"_hi_{c}"),
            F.min_by(f"_v_{c}", place).alias(f"_first_{c}"), F.max_by(f"_v_{c}", place).alias(f"_last_{c}"))])
    across = Window.partitionBy("station").orderBy(SLICE)
    joined = per_slice.select("station", *[
        col for c in cols for col in (
            F.col(f"_lo_{c}"), F.col(f"_hi_{c}"),
            (F.col(f"_first_{c}") - F.lag(f"_last_{c}").over(across)).alias(f"_gap_{c}"))])
    result = joined.groupBy("station").agg(*[
        agg for c in cols for agg in (
            F.least(F.min(f"_lo_{c}"), F.min(f"_gap_{c}")).alias(f"_lo_{c}"),
            F.greatest(F.max(f"_hi_{c}"), F.max(f"_gap_{c}")).alias(f"_hi_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              F.coalesce(F.col(f"_lo_{c}") >= 0, F.lit(True)).alias("monotonic"),
                              F.coalesce((F.col(f"_lo_{c}") == 1) & (F.col(f"_hi_{c}") == 1), F.lit(True))
                              .alias("consecutive")) for c in cols])
    return result.select("station", F.inline(rows))


def head_sample(long: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` present values of every column of a long table.

    The rank filter is also applied before the shuffle, so a station sends at
    most ``n`` rows per column from each task.
    """
    first = Window.partitionBy("station", "column").orderBy(*order)
    return (long.where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n))


def chronological(df: DataFrame, ts: str = "ts", row_id: str = "row_id") -> DataFrame:
    """Globally sorted by station and time through range partitioning."""
    return df.orderBy("station", ts, row_id)
