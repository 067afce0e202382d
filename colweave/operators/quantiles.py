"""Exact percentiles with linear interpolation, at any station size, in two scans.

The first scan keeps a mergeable quantile sketch per station and column; for every wanted
percentile it gives two values that enclose its rank.  The second scan counts what lies
below each pair and keeps, counted by value, only what lies within it; the wanted ranks
are read off the running totals of these few values.  Sketches and counts are combined
before the shuffle, so no task ever holds a station's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.stats import join_station
from colweave.operators.ordered import running_total
from colweave.session import GROUP_ROW_LIMIT, materialise

# The sketch's rank error is one in so many rows; a pair of values encloses about four of these.
ACCURACY = 2000
# A sketch keeps so many values for each of these; then 99 of 100 err by less than half of what a pair allows for.
KEPT_VALUES = 4
MOST_KEPT = 65_535


def exact_percentiles(df: DataFrame, cols: list[str], probs: list[float], limit: int = GROUP_ROW_LIMIT,
                      accuracy: int = ACCURACY) -> DataFrame:
    """One row per station; each column becomes the array of its percentiles, NULL without values.

    ``limit`` is the number of distinct values of one bracket that a window may order in one task.
    """
    values = df.select("station", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    cells = _bracketed(values, len(cols), probs, accuracy)
    counted = _counted(values, cells, len(cols), len(probs))
    found = _ranks(cells, counted, limit)
    # A sketch may err by more than it states; such ranks are sought among all values of the column.
    missed = cells.join(found, ["cell"], "left").where("(at IS NULL OR after IS NULL) AND held > 0")
    if missed.limit(1).count():
        wider = materialise(cells.join(missed.select("cell"), "cell", "left_semi").withColumn("low", F.col("least")).withColumn("high", F.col("most")))
        found = found.where("at IS NOT NULL AND after IS NOT NULL").unionByName(
            _ranks(wider, _counted(values, wider, len(cols), len(probs)), limit))
    share = F.col("position") - F.floor("position")
    quantile = F.when(share == 0, F.col("at")).otherwise(F.col("at") + (F.col("after") - F.col("at")) * share)
    placed = cells.join(found, "cell", "left").select("station", "i", "k", quantile.alias("q"))
    wide = placed.groupBy("station").agg(*[
        F.expr(_array(f"max(CASE WHEN i = {i} AND k = {k} THEN q END)" for k in range(len(probs)))).alias(c)
        for i, c in enumerate(cols)])
    return wide.select("station", *[F.when(F.col(f"`{c}`")[0].isNotNull(), F.col(f"`{c}`")).alias(c) for c in cols])


# Expressions over all columns and percentiles are written as SQL text: one call each, however many they hold.
def _array(parts) -> str:
    return f"array({', '.join(parts)})"


def _bracketed(values: DataFrame, width: int, probs: list[float], accuracy: int) -> DataFrame:
    """A row per station, column and percentile: ``cell``, the values ``low`` and ``high`` around it, and counts."""
    spread = 2.0 / accuracy
    ends = sorted({min(1.0, max(0.0, p + side * spread)) for p in probs for side in (-1, 1)})
    sketch = values.groupBy("station").agg(*[F.expr(agg) for i in range(width) for agg in (
        f"count(v{i}) AS n{i}", f"min(v{i}) AS a{i}", f"max(v{i}) AS z{i}",
        f"kll_sketch_agg_double(v{i}, {min(MOST_KEPT, max(8, KEPT_VALUES * accuracy))}) AS s{i}")])

    def end(i: int, p: float, side: int) -> str:
        # Of a few values all lie within; the outermost ranks are the least and the greatest.
        outer = f"{'az'[side > 0]}{i}"
        place = ends.index(min(1.0, max(0.0, p + side * spread)))
        return f"if(n{i} <= {4 * accuracy}, {outer}, kll_sketch_get_quantile_double(s{i}, {ends[place]!r}D))" if 0 < ends[place] < 1 else outer

    rows = sketch.selectExpr("station", "inline(" + _array(
        f"struct({i} AS i, {k} AS k, n{i} AS held, a{i} AS least, z{i} AS most, {end(i, p, -1)} AS low, "
        f"{end(i, p, 1)} AS high, {float(p)!r}D * (n{i} - 1) AS position)"
        for i in range(width) for k, p in enumerate(probs)) + ")")
    return materialise(rows.withColumn("cell", F.monotonically_increasing_id()))


def _counted(values: DataFrame, cells: DataFrame, width: int, percentiles: int) -> DataFrame:
    """``(cell, value, n, below)``: values within brackets with their number; ``below`` on rows without a value."""
    pairs = [(i, k) for i in range(width) for k in range(percentiles)]
    brackets = cells.groupBy("station").agg(*[
        F.expr(f"max(CASE WHEN i = {i} AND k = {k} THEN struct(cell, low, high) END) AS b{i}_{k}") for i, k in pairs])
    rows = join_station(values, materialise(brackets))
    lies = {(i, k): f"v{i} BETWEEN b{i}_{k}.low AND b{i}_{k}.high" for i, k in pairs}
    within = "filter(" + _array(
        f"CASE WHEN {lies[i, k]} THEN struct(b{i}_{k}.cell AS cell, v{i} AS value) END" for i, k in pairs) + ", x -> x IS NOT NULL)"
    # Most rows lie in no bracket: for these no array is made.
    flagged = rows.selectExpr("station", *[f"v{i} < b{i}_{k}.low AS u{i}_{k}" for i, k in pairs],
                              f"CASE WHEN {' OR '.join(lies.values())} THEN {within} END AS events")
    # A row counts once for what it is below of, whatever number of brackets it lies in.
    events = flagged.selectExpr("station", *[f"u{i}_{k}" for i, k in pairs], "posexplode_outer(events) AS (at, event)")
    counts = materialise(events.groupBy("station", F.col("event.cell").alias("cell"), F.col("event.value").alias("value")).agg(
        F.count("*").alias("n"), *[F.expr(
            f"count(CASE WHEN coalesce(at = 0, true) AND u{i}_{k} THEN 1 END) AS c{i}_{k}") for i, k in pairs]))
    below = counts.groupBy("station").agg(*[F.expr(f"sum(c{i}_{k}) AS c{i}_{k}") for i, k in pairs])
    below = below.selectExpr("station", "inline(" + _array(
        f"struct({i} AS i, {k} AS k, c{i}_{k} AS below)" for i, k in pairs) + ")")
    own = cells.select(F.col("station").alias("_own"), "i", "k", "cell")
    placed = below.join(own, F.col("station").eqNullSafe(F.col("_own")) & (below.i == own.i) & (below.k == own.k))
    inside = counts.where("cell IS NOT NULL").groupBy("cell", "value").agg(F.sum("n").alias("n"))
    return inside.select("cell", "value", "n", F.lit(None).cast("long").alias("below")).unionAll(
        placed.select("cell", F.lit(None).cast("double"), F.lit(None).cast("long"), "below"))


def _ranks(cells: DataFrame, counted: DataFrame, limit: int) -> DataFrame:
    """``(cell, at, after)``: the values of the ranks at or below each percentile's position, and after it."""
    counted = materialise(counted)
    below = counted.where("below IS NOT NULL").select("cell", "below")
    totals = running_total(counted.where("value IS NOT NULL").select("cell", "value", "n"), ["cell"], ["value"], "n", "upto", limit)
    seen = totals.join(cells.select("cell", "position"), "cell").join(below, "cell")
    last = F.col("below") + F.col("upto")
    known = F.col("below") <= F.floor("position")
    return seen.groupBy("cell").agg(
        F.min(F.when(known & (last > F.floor("position")), F.col("value"))).alias("at"),
        F.min(F.when(known & (last > F.ceil("position")), F.col("value"))).alias("after"))


def medians(df: DataFrame, cols: list[str], limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Median per station and column; 0.0 for a column without values."""
    q = exact_percentiles(df, cols, [0.5], limit)
    return q.select("station", *[F.coalesce(F.col(c)[0], F.lit(0.0)).alias(c) for c in cols])


def value_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent value per station and column, smallest on ties: ``(station,column,value)``.

    Counting by value first spreads a large station over all tasks.
    """
    long = df.unpivot(["station"], cols, "column", "value")
    counts = long.groupBy("station", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    top = counts.groupBy("station", "column").agg(F.max(F.when(present, F.col("n"))).alias("top"))
    return (counts.join(top, ["station", "column"])
            .groupBy("station", "column")
            .agg(F.min(F.when(present & (F.col("n") == F.col("top")), F.col("value"))).alias("value")))
