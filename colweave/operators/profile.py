"""Table and column profiles per station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colweave.functions.stats import is_numeric, join_station, null_if_zero
from colweave.operators.quantiles import exact_percentiles
from colweave.session import GROUP_ROW_LIMIT, materialise

# Bytes of a fixed-width value.
WIDTHS = {T.LongType: 8, T.IntegerType: 4, T.ShortType: 2, T.ByteType: 1, T.DoubleType: 8,
          T.FloatType: 4, T.BooleanType: 1, T.TimestampType: 8, T.TimestampNTZType: 8, T.DateType: 4}
# Texts beyond this many bytes are told apart by a hash of 128 bits.
HASHED_BYTES = 32
# Logarithm of the cells of a distinct sketch.
SKETCH_BITS = 14
# Columns of one type up to which each is counted by a scan of its own of a written table.
SCANNED_COLS = 12
# Bits of the parts a hash is added up in; their sums stay whole numbers of 64 bits over 2 ** 41 rows.
HASH_PARTS = ((42, 22), (21, 21), (0, 21))
Z_LIMIT = 3.0
FENCE = 1.5


def table_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, columns and data bytes: string lengths plus fixed widths."""
    fixed = sum(WIDTHS.get(type(df.schema[c].dataType), 0) for c in cols)
    texts = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    size = F.count(F.lit(1)) * F.lit(fixed).cast("long")
    for c in texts:
        size = size + F.coalesce(F.sum(F.octet_length(c).cast("long")), F.lit(0))
    return df.groupBy("station").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(cols)).cast("long").alias("cols"), size.alias("bytes"))


def column_profile(df: DataFrame, cols: list[str], written: bool = False) -> DataFrame:
    """Rows, nulls and distinct values (NULL counts as one) of every column.

    Columns of one type are unpivoted together and counted by value, so the
    work of a large station is spread by value and a repeated value is combined
    before the shuffle.  Long texts travel as their 128-bit hash.  Where an estimate will
    do, ``distinct_sketches`` shuffles no values at all.  ``written`` says that ``df`` is a
    written table: each of a few columns is then read alone, which makes no row per cell.
    """
    families: dict[str, list[str]] = {}
    for c in cols:
        families.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out = None
    for dtype, members in families.items():
        told = [_told_apart(F.col(c)).alias(c) for c in members] if dtype == "string" else members
        shown = df.select("station", *told)
        if written and len(members) <= SCANNED_COLS:
            counted = [shown.select("station", F.lit(c).alias("column"), F.col(c).alias("value")) for c in members]
        else:
            counted = [shown.unpivot(["station"], members, "column", "value")]
        for cells in counted:
            values = cells.groupBy("station", "column", "value").agg(F.count(F.lit(1)).alias("n"))
            part = values.groupBy("station", "column").agg(
                F.lit(dtype).alias("dtype"), F.sum("n").alias("rows"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
                F.count(F.lit(1)).alias("distinct_values"))
            out = part if out is None else out.unionByName(part)
    return out.withColumn("null_ratio", F.col("nulls") / F.col("rows"))


def _told_apart(text: Column) -> Column:
    """A text, or if longer a mark and its hash, which is longer than any text left as it is."""
    return F.when(F.octet_length(text) > HASHED_BYTES, F.concat(F.lit("#"), F.md5(text))).otherwise(text)


def distinct_sketches(df: DataFrame, cols: list[str], by: list[str] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """``(station, *by, column, dtype, rows, nulls, sketch)``: one mergeable sketch per column and group.

    One aggregate of the scan; a group sends one row.  Kept per file (``by`` the file's
    column), the table answers for any set of files: drop the rows of files that went, add
    those of new ones, and give the rest to ``profile_of_sketches``.
    """
    keys = ["station", *(by or [])]
    hashed = {c: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in cols}
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[
        part for i, c in enumerate(cols) for part in (
            F.count(F.when(F.col(c).isNull(), 1)).alias(f"_nulls{i}"), F.hll_sketch_agg(hashed[c], bits).alias(f"_sketch{i}"))])
    cells = F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col("_rows").alias("rows"),
        F.col(f"_nulls{i}").alias("nulls"), F.col(f"_sketch{i}").alias("sketch")) for i, c in enumerate(cols)])
    return wide.select(*keys, F.inline(cells))


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """The columns of ``column_profile`` from sketches, united by station and column.

    Rows and nulls are exact; ``distinct_values`` is an estimate with a standard error of
    about 0.8 % at the default size of a sketch (1.04 / sqrt(2 ** bits)).
    """
    united = sketches.groupBy("station", "column").agg(
        F.max("dtype").alias("dtype"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))).alias("estimate"))
    values = F.col("estimate") + F.when(F.col("nulls") > 0, 1).otherwise(0)
    return united.select("station", "column", "dtype", "rows", "nulls", values.cast("long").alias("distinct_values"),
                         (F.col("nulls") / F.col("rows")).alias("null_ratio"))


def duplicate_rows(df: DataFrame, cols: list[str], kept: DataFrame | None = None) -> DataFrame:
    """Rows beyond the first of each identical group.

    Only a hash per row is shuffled first; full rows are compared just where a
    hash occurs more than once.  ``kept(station, rows)`` is the number of different rows, if
    these were told apart before: what is missing of a station's rows was a repetition.
    """
    if kept is not None:
        totals = df.groupBy("station").agg(F.count(F.lit(1)).alias("rows"))
        return join_station(totals, kept.withColumnRenamed("rows", "different")).select(
            "station", "rows", (F.col("rows") - F.col("different")).alias("duplicate_rows"))
    hashed = df.select("station", F.xxhash64(*cols).alias("_h"), *cols)
    repeated = (hashed.groupBy("station", "_h").agg(F.count(F.lit(1)).alias("n"))
                .where("n > 1").select("station", "_h"))
    suspects = hashed.join(repeated, ["station", "_h"], "left_semi")
    extra = (suspects.groupBy("station", *cols).agg((F.count(F.lit(1)) - 1).alias("extra"))
             .groupBy("station").agg(F.sum("extra").alias("extra")))
    totals = df.groupBy("station").agg(F.count(F.lit(1)).alias("rows"))
    return totals.join(extra, "station", "left").select(
        "station", "rows", F.coalesce("extra", F.lit(0)).alias("duplicate_rows"))


def duplicate_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs of same-typed columns with equal values in every row.

    An order-free hash sum per column finds candidates; each later column is then
    compared row by row with the first column that has its hash sum.  Both passes
    are aggregates of one row per station.
    """
    hashes = df.select("station", *[F.xxhash64(c).alias(f"x{i}") for i, c in enumerate(cols)])
    sums = hashes.groupBy("station").agg(*[
        F.sum(F.shiftright(f"x{i}", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))).alias(f"h{i}_{low}")
        for i in range(len(cols)) for low, bits in HASH_PARTS])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                               F.struct(*[F.col(f"h{i}_{low}").alias(f"h{low}") for low, _ in HASH_PARTS]).alias("h"))
                      for i, c in enumerate(cols)])
    firsts = materialise(
        sums.select("station", F.inline(cells)).groupBy("station", "dtype", "h")
        .agg(F.sort_array(F.collect_list("i")).alias("members")).where("size(members) > 1")
        .select("station", F.col("members")[0].alias("i"), F.explode("members").alias("j")).where("i < j"))
    # At most one pair of names per column: bounded by the schema.
    pairs = [(r["i"], r["j"]) for r in firsts.select("i", "j").distinct().collect()]
    if not pairs:
        return firsts.select("station", F.lit("").alias("first_column"), F.lit("").alias("duplicate_column"))
    equal = df.groupBy("station").agg(*[
        F.bool_and(F.col(cols[i]).eqNullSafe(F.col(cols[j]))).alias(f"e{i}_{j}") for i, j in pairs])
    verdicts = equal.select("station", F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("first_column"),
                 F.lit(cols[j]).alias("duplicate_column"), F.col(f"e{i}_{j}").alias("same"))
        for i, j in pairs])))
    return (firsts.join(verdicts.where("same"), ["station", "i", "j"])
            .select("station", "first_column", "duplicate_column"))


def _per_column(wide: DataFrame, cols: list[str], fields: dict[str, str]) -> DataFrame:
    """Columns named ``<prefix>_<index>`` of one row per station -> one row per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"),
                               *[F.col(f"{prefix}_{i}").alias(name) for name, prefix in fields.items()])
                      for i, c in enumerate(cols)])
    return wide.select("station", F.inline(cells))


def iqr_outliers(df: DataFrame, cols: list[str], limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """Values outside the quartile fences; none where the quartiles coincide."""
    q = materialise(exact_percentiles(df, cols, [0.25, 0.75], limit).select(
        "station", *[F.col(c).alias(f"{c}__q") for c in cols]))
    rows = join_station(df.select("station", *cols), q)
    aggs = []
    for i, c in enumerate(cols):
        q1, q3 = F.col(f"{c}__q")[0], F.col(f"{c}__q")[1]
        low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
        out = (q3 > q1) & ((F.col(c) < low) | (F.col(c) > high))
        aggs += [F.count(F.when(out, 1)).alias(f"n_{i}"),
                 F.first(low).alias(f"l_{i}"), F.first(high).alias(f"h_{i}")]
    return _per_column(rows.groupBy("station").agg(*aggs), cols,
                       {"outliers": "n", "lower_bound": "l", "upper_bound": "h"})


def zscore_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values more than three sample deviations from the mean."""
    stats = materialise(df.groupBy("station").agg(*[
        agg for c in cols for agg in (F.avg(c).alias(f"{c}__m"), F.stddev_samp(c).alias(f"{c}__s"))]))
    rows = join_station(df.select("station", *cols), stats)
    aggs = []
    for i, c in enumerate(cols):
        mean, std = F.col(f"{c}__m"), F.col(f"{c}__s")
        z = (F.col(c) - mean) / null_if_zero(std)
        aggs += [F.count(F.when(F.abs(z) > Z_LIMIT, 1)).alias(f"n_{i}"),
                 F.first(mean - Z_LIMIT * std).alias(f"l_{i}"), F.first(mean + Z_LIMIT * std).alias(f"h_{i}")]
    return _per_column(rows.groupBy("station").agg(*aggs), cols,
                       {"outliers": "n", "lower_bound": "l", "upper_bound": "h"})


def node_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum; text that is no number is missing."""
    def number(c: str):
        return F.col(c) if is_numeric(df.schema[c].dataType) else F.expr(f"try_cast(`{c}` as double)")

    aggs = []
    for i, c in enumerate(cols):
        v = number(c)
        aggs += [F.avg(v).alias(f"mean_{i}"), F.stddev_pop(v).alias(f"std_{i}"),
                 F.min(v.cast("double")).alias(f"min_{i}"), F.max(v.cast("double")).alias(f"max_{i}")]
    return _per_column(df.groupBy("station").agg(*aggs), cols,
                       {"mean": "mean", "std": "std", "min": "min", "max": "max"}).withColumnRenamed("column", "node")


def audit(df: DataFrame, cols: list[str], limit: int = GROUP_ROW_LIMIT, stats: DataFrame | None = None,
          kept: DataFrame | None = None) -> DataFrame:
    """The whole profile as one nested row per station.

    ``stats`` is a column profile made before, ``kept`` the number of different rows.
    """
    numeric = [c for c in cols if is_numeric(df.schema[c].dataType)]
    columns = column_profile(df, cols) if stats is None else stats
    if numeric:
        iqr = iqr_outliers(df, numeric, limit).select("station", "column", F.col("outliers").alias("outliers_iqr"))
        z = zscore_outliers(df, numeric).select("station", "column", F.col("outliers").alias("outliers_zscore"))
        columns = columns.join(iqr, ["station", "column"], "left").join(z, ["station", "column"], "left")
    else:
        columns = columns.withColumns({"outliers_iqr": F.lit(None).cast("long"),
                                       "outliers_zscore": F.lit(None).cast("long")})
    columns = columns.withColumn("is_numeric", F.col("column").isin(numeric))
    order = F.array(*[F.lit(c) for c in cols])
    # One entry per column of the schema.
    listed = columns.groupBy("station").agg(F.sort_array(F.collect_list(F.struct(
        F.array_position(order, F.col("column")).alias("position"), "column", "dtype", "nulls", "null_ratio",
        "distinct_values", "is_numeric", "outliers_iqr", "outliers_zscore"))).alias("columns"))
    twins = duplicate_columns(df, cols).groupBy("station").agg(
        F.sort_array(F.collect_list(F.struct("first_column", "duplicate_column"))).alias("duplicate_columns"))
    return (table_profile(df, cols)
            .join(duplicate_rows(df, cols, kept).select("station", "duplicate_rows"), "station")
            .join(twins, "station", "left").join(listed, "station"))
