"""Imputation by nearest neighbours at any number of rows.

A distance is never below the difference in one shared coordinate.  Values of every
column are therefore cut into sorted slices; a row finds enough neighbours in its own
slices, which bounds how far the nearest ones can be, and then visits only the slices
that reach into that distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.stats import join_station
from colweave.session import materialise, ready_workers

NEIGHBOURS = 5
# Values of one slice, and rows that meet a slice in one task.
SLICE_ROWS = 512
VISIT_ROWS = 2048
# Rows whose distances to a slice are held at once.
_CHUNK = 256
_NO = "_knn_no"
# A slice's number is its part of the sorted table, then its place there.
_PART_BITS = 30
# Rounding in a radius must not lose a neighbour at its rim.
_RIM = 1 + 1e-9


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([table[n].to_numpy() for n in names]).astype(np.float64)


def _distances(take: np.ndarray, give: np.ndarray, used: int) -> np.ndarray:
    """Squared distances over shared coordinates, scaled up by the share; inf without any."""
    total = np.zeros((len(take), len(give)))
    shared = np.zeros((len(take), len(give)))
    for i in range(take.shape[1]):
        step = (take[:, i, None] - give[None, :, i]) ** 2
        known = ~np.isnan(step)
        total += np.where(known, step, 0.0)
        shared += known
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, total * (used / shared), np.inf)


def _radius(names: list[str], k: int):
    def run(table: pa.Table) -> pa.Table:
        give = _matrix(table, names)
        used = int(table["used"][0].as_py())
        own = np.array([n in set(table["targets"][0].as_py()) for n in names])
        gaps = np.isnan(give) & own
        asked = np.flatnonzero(gaps.any(axis=1))
        reach = np.zeros(len(asked))
        for low in range(0, len(asked), _CHUNK):
            part = asked[low:low + _CHUNK]
            far = _distances(give[part], give, used)
            for i in np.flatnonzero(own):
                near = far[:, ~np.isnan(give[:, i])]
                kth = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] >= k else np.full(len(part), np.inf)
                reach[low:low + _CHUNK] = np.maximum(reach[low:low + _CHUNK], np.where(gaps[part, i], kth, 0.0))
        return pa.table({_NO: table[_NO].take(pa.array(asked)), "reach": pa.array(reach)})

    return run


def _nearest(names: list[str], k: int):
    def run(rows: pa.Table, slices: pa.Table) -> pa.Table:
        found = {_NO: [], "target": [], "distance": [], "donor": [], "value": []}
        if rows.num_rows and slices.num_rows:
            used, axis = int(rows["used"][0].as_py()), int(rows["axis"][0].as_py())
            targets = set(rows["targets"][0].as_py())
            slices = slices.sort_by(_NO)
            give, donor = _matrix(slices, names), slices[_NO].to_numpy()
            take, numbers = _matrix(rows, names), rows[_NO].to_numpy()
            for low in range(0, len(take), _CHUNK):
                part = take[low:low + _CHUNK]
                far = _distances(part, give, used)
                # A pair is met on the first coordinate that both rows have.
                for i in range(axis):
                    far[~np.isnan(part[:, i])[:, None] & ~np.isnan(give[:, i])[None, :]] = np.inf
                for i in (i for i, n in enumerate(names) if n in targets):
                    at = np.flatnonzero(np.isnan(part[:, i]))
                    have = np.flatnonzero(~np.isnan(give[:, i]))
                    if not len(at) or not len(have):
                        continue
                    near = far[np.ix_(at, have)]
                    kth = np.partition(near, k - 1, axis=1)[:, k - 1] if len(have) > k else np.full(len(at), np.inf)
                    r, d = np.nonzero((near <= kth[:, None]) & np.isfinite(near))
                    # Donors are in row order, so equal distances stay in it.
                    order = np.lexsort((near[r, d], r))
                    r, d = r[order], d[order]
                    first = np.searchsorted(r, r)
                    best = np.arange(len(r)) - first < k
                    r, d = r[best], d[best]
                    found[_NO].append(numbers[low + at[r]])
                    found["target"].append(np.full(len(r), i, dtype=np.int32))
                    found["distance"].append(near[r, d])
                    found["donor"].append(donor[have[d]])
                    found["value"].append(give[have[d], i])
        kinds = {_NO: np.int64, "target": np.int32, "distance": np.float64, "donor": np.int64, "value": np.float64}
        return pa.table({n: pa.array(np.concatenate(found[n]) if found[n] else np.empty(0), type=pa.from_numpy_dtype(t))
                         for n, t in kinds.items()})

    return run


def impute_knn(df: DataFrame, cols: list[str], k: int = NEIGHBOURS, slice_rows: int = SLICE_ROWS,
               visit_rows: int = VISIT_ROWS) -> DataFrame:
    """Mean of the ``k`` nearest rows that have the value, by NaN-aware Euclidean distance.

    Distances use the columns being imputed (those with gaps in the station),
    scaled by the share of coordinates both rows have; ties go to the lower row
    id and a row without any usable distance takes the column mean.  The result is
    exact for stations of any size.  NaN counts as missing.
    """
    names = [f"_x{i}" for i in range(len(cols))]
    # Numbers that grow with the row id stand for it.
    placed = materialise(df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in cols})
                         .repartitionByRange("row_id").sortWithinPartitions("row_id")
                         .withColumn(_NO, F.monotonically_increasing_id()))
    gappy = [F.max(F.col(c).isNull()) for c in cols]
    stats = materialise(placed.groupBy("station").agg(
        F.array_compact(F.array(*[F.when(g, F.lit(n)) for g, n in zip(gappy, names)])).alias("targets"),
        *[F.avg(c).alias(f"_m_{c}") for c in cols]).withColumn("used", F.size("targets")))
    rows = join_station(placed.select("station", _NO, *[F.col(c).alias(n) for c, n in zip(cols, names)]),
                        stats.select("station", "targets", "used"))
    rows = rows.withColumns({n: F.when(F.array_contains("targets", n), F.col(n)) for n in names})
    cells = rows.withColumn("cell", F.explode(F.array(*[
        F.struct(F.lit(i).alias("axis"), F.col(n).alias("at")) for i, n in enumerate(names)]))).where("cell.at is not null")
    cells = cells.select("station", "cell.axis", "cell.at", _NO, "targets", "used", *names)
    index = F.monotonically_increasing_id()
    slices = materialise(
        cells.repartitionByRange("station", "axis", "at", _NO).sortWithinPartitions("station", "axis", "at", _NO)
        .withColumn("slice", F.shiftright(index, 33) * (1 << _PART_BITS)
                    + F.floor(index.bitwiseAND(F.lit((1 << 33) - 1)) / slice_rows)))
    key = ["station", "axis", "slice"]
    # A stated partition count keeps small but compute-heavy groups apart.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = materialise(
        ready_workers(slices).repartition(tasks, *key).groupBy(*key).applyInArrow(_radius(names, k), f"{_NO} long, reach double")
        .groupBy(_NO).agg(F.min("reach").alias("reach")))
    bounds = materialise(slices.groupBy(*key).agg(F.min("at").alias("low"), F.max("at").alias("high"))
                         .withColumn("part", F.shiftright("slice", _PART_BITS)))
    parts = materialise(bounds.groupBy("station", "axis", "part").agg(F.min("low").alias("low"), F.max("high").alias("high")))

    known = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    wide = F.sqrt(F.col("reach") * known / F.col("used")) * _RIM
    asking = cells.join(reach, _NO).withColumns({"from": F.col("at") - wide, "to": F.col("at") + wide})

    def meeting(side: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
        """Rows with the spans of values that reach into theirs; ``keys`` besides station and axis are equal."""
        own = spans.select(*[F.col(c).alias(f"_{c}") for c in spans.columns])
        same = F.col("station").eqNullSafe(F.col("_station"))
        for c in ("axis", *keys):
            same = same & (F.col(c) == F.col(f"_{c}"))
        return side.join(own, same & (F.col("_low") <= F.col("to")) & (F.col("_high") >= F.col("from")))

    # First the parts of the sorted table, then the slices of these: never all slices.
    near = meeting(asking, parts).withColumnRenamed("_part", "part").drop("_station", "_axis", "_low", "_high")
    visits = materialise(meeting(near, bounds, "part").withColumnRenamed("_slice", "slice").select(
        *key, _NO, "targets", "used", *names))
    # A slice that many rows visit meets them block by block.
    blocks = materialise(visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / visit_rows).alias("blocks"))).select(
        F.col("station").alias("_s"), F.col("axis").alias("_a"), F.col("slice").alias("_l"), "blocks")

    def dealt(side: DataFrame) -> DataFrame:
        same = F.col("station").eqNullSafe(F.col("_s")) & (F.col("axis") == F.col("_a")) & (F.col("slice") == F.col("_l"))
        return side.join(blocks, same).drop("_s", "_a", "_l")

    asked = dealt(visits).withColumn("block", F.pmod(F.xxhash64(_NO), F.col("blocks"))).drop("blocks")
    donors = dealt(slices.select(*key, _NO, *names)).select(
        *key, _NO, *names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    # The two sides come from the same tables: own names keep their columns apart.
    donors = donors.select(*[F.col(c).alias(f"d_{c}") for c in key], F.col("other").alias("d_block"), _NO, *names)
    group = [*key, "block"]
    asked = asked.repartition(tasks, *group)
    donors = donors.repartition(tasks, *[f"d_{c}" for c in group])
    found = asked.groupBy(*group).cogroup(donors.groupBy(*[f"d_{c}" for c in group])).applyInArrow(
        _nearest(names, k), f"{_NO} long, target int, distance double, donor long, value double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "donor", "value"))), 1, k)
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x["value"]) / F.size(best)
    fills = (found.groupBy(_NO, "target").agg(mean.alias("value")).groupBy(_NO).agg(*[
        F.max(F.when(F.col("target") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]))
    out = join_station(placed.join(materialise(fills), _NO, "left"), stats.drop("targets", "used"))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(n), F.col(f"_m_{c}")) for c, n in zip(cols, names)}).select(*df.columns)
