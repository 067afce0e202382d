"""Semantic role of every column and the search for the time column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colweave.functions.stats import is_integer, is_numeric
from colweave.functions.timeparse import may_be_time, parse_attempts
from colweave.operators.ordered import sequence_tests
from colweave.operators.profile import column_profile
from colweave.session import GROUP_ROW_LIMIT, materialise

# Fixed name lists.
TARGET_NAMES = ("target", "label", "outcome", "y_val", "class_label")
TIME_NAMES = ("time", "date", "timestamp", "epoch", "datetime", "ts")
INDEX_NAMES = ("index", "idx", "row_num", "rownum")
ID_NAMES = ("id", "key", "uuid", "guid", "station", "code", "pk", "fk")
EXACT_TIME_NAMES = ("timestamp", "datetime", "date_time", "time", "date", "epoch", "ts")
TIME_FRAGMENTS = ("timestamp", "datetime", "date", "time")

# Role names.
TARGET, TIMESTAMP, SEQUENCE = "Target Candidate", "Timestamp", "Sequential Index"
IDENTIFIER, CATEGORICAL, NUMERIC, UNKNOWN = "Identifier", "Categorical Feature", "Numeric Feature", "Unknown"

LARGE_INTEGER = 1e9


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def named_like_target(name: Column) -> Column:
    low = F.lower(name)
    return _any([(low == k) | low.endswith("_" + k) for k in TARGET_NAMES])


def named_like_time(name: Column, strict: bool = False) -> Column:
    low = F.lower(name)
    if strict:
        return F.arrays_overlap(F.split(low, "_"), F.array(*[F.lit(k) for k in TIME_NAMES]))
    return _any([low.contains(k) for k in TIME_NAMES])


def named_like_index(name: Column) -> Column:
    return F.lower(name).isin(*INDEX_NAMES)


def named_like_id(name: Column) -> Column:
    low = F.lower(name)
    return _any([(low == k) | low.endswith("_" + k) | low.startswith(k + "_") for k in ID_NAMES])


def time_name_score(name: Column) -> Column:
    """3 for an exact time name, 2 for a name part, 1 for a fragment, else 0."""
    low = F.lower(name)
    exact = F.array(*[F.lit(k) for k in EXACT_TIME_NAMES])
    return (F.when(low.isin(*EXACT_TIME_NAMES), 3)
            .when(F.arrays_overlap(F.split(low, "_"), exact), 2)
            .when(_any([low.contains(k) for k in TIME_FRAGMENTS]), 1).otherwise(0))


def extremes(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(station, column, largest, values_differ)`` of columns that are no text; one aggregate."""
    wide = df.groupBy("station").agg(*[agg for i, c in enumerate(cols) for agg in (
        F.min(F.col(c)).alias(f"a{i}"), F.max(F.col(c)).alias(f"z{i}"))])
    return wide.select("station", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 (F.col(f"z{i}").cast("double") if is_numeric(df.schema[c].dataType) else F.lit(None).cast("double")).alias("largest"),
                 (F.col(f"a{i}") != F.col(f"z{i}")).alias("values_differ")) for i, c in enumerate(cols)])))


def parse_quality(df: DataFrame, cols: list[str]) -> DataFrame:
    """Best share of a text column's values that one layout parses, and whether its times differ.

    ``(station, column, parse_ratio, times_differ)``.  Values are counted first, those
    without the shape of a time all together, so a layout reads each distinct value
    once and long texts are never shuffled.
    """
    shaped = [F.when(may_be_time(F.col(c)), F.col(c)).alias("value") for c in cols]
    cells = df.select("station", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("present"), value) for c, value in zip(cols, shaped)])))
    counts = cells.where("present").groupBy("station", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    attempts = parse_attempts(F.col("value"))
    per_layout = counts.groupBy("station", "column").agg(
        F.sum("n").alias("present"),
        F.array(*[F.struct(F.sum(F.when(a.isNotNull(), F.col("n")).otherwise(0)).alias("parsed"), (F.min(a) != F.max(a)).alias("differ"))
                  for a in attempts]).alias("layouts"))
    return (per_layout.withColumn("best", F.array_max("layouts"))
            .select("station", "column", (F.col("best.parsed") / F.col("present")).alias("parse_ratio"),
                    F.coalesce("best.differ", F.lit(False)).alias("times_differ")))


def column_roles(df: DataFrame, cols: list[str], order: list[str], strict_time_names: bool = False,
                 limit: int = GROUP_ROW_LIMIT, stats: DataFrame | None = None) -> DataFrame:
    """``(station, column, idx, dtype, role)``; the first matching rule wins.

    A column counts as integer only while it has no missing value.  ``stats`` is
    a column profile made before.
    """
    kinds = {c: df.schema[c].dataType for c in cols}
    integers = [c for c in cols if is_integer(kinds[c])]
    texts = [c for c in cols if isinstance(kinds[c], T.StringType)]
    dates = [c for c in cols if isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType, T.DateType))]
    numbers = [c for c in cols if is_numeric(kinds[c])]
    flags = [c for c in cols if isinstance(kinds[c], T.BooleanType)]

    stats = materialise(column_profile(df, cols)) if stats is None else stats
    name = F.col("column")
    if texts:
        stats = stats.join(parse_quality(df, texts), ["station", "column"], "left")
    else:
        stats = stats.selectExpr("*", "0D parse_ratio", "false times_differ")
    if integers:
        stats = stats.join(extremes(df, integers), ["station", "column"], "left")
    else:
        stats = stats.selectExpr("*", "0D largest", "false values_differ")
    if integers:
        stats = stats.join(sequence_tests(df, integers, order, limit), ["station", "column"], "left")
    else:
        stats = stats.selectExpr("*", "false monotonic", "false consecutive")

    present = F.col("distinct_values") - F.when(F.col("nulls") > 0, 1).otherwise(0)
    ratio = present / F.col("rows")
    whole = name.isin(integers) & (F.col("nulls") == 0)
    text = name.isin(texts)
    integer_time = (whole & (named_like_time(name, strict_time_names) | (F.col("largest") > LARGE_INTEGER))
                    & F.col("values_differ"))
    text_time = text & (F.col("parse_ratio") > 0.8) & F.col("times_differ")
    role = (F.when(named_like_target(name), TARGET)
            .when(name.isin(dates) | integer_time | text_time, TIMESTAMP)
            .when(whole & F.col("monotonic") & (F.col("consecutive") | named_like_index(name)), SEQUENCE)
            .when(named_like_id(name) & ((ratio > 0.8) | text), IDENTIFIER)
            .when(text & (ratio == 1.0), IDENTIFIER)
            .when(text | name.isin(flags), CATEGORICAL)
            .when(whole & ((present <= 20) | ((ratio < 0.05) & (present < 100))), CATEGORICAL)
            .when(name.isin(numbers), NUMERIC)
            .otherwise(UNKNOWN))
    position = F.array_position(F.array(*[F.lit(c) for c in cols]), name) - 1
    return stats.select("station", "column", position.cast("int").alias("idx"), "dtype", "rows", "nulls",
                        "distinct_values", role.alias("role"))


def likely_timestamp(df: DataFrame, cols: list[str], order: list[str],
                     preferred: str | None = None) -> DataFrame:
    """The time column of each station: ``(station, column, score, parse_ratio)``.

    A configured column wins when it exists.  Otherwise the best name score, then
    the best parse ratio, then the first column.
    """
    if preferred and preferred in cols:
        return df.select("station").distinct().select(
            "station", F.lit(preferred).alias("column"), F.lit(3).alias("score"), F.lit(1.0).alias("parse_ratio"))
    kinds = {c: df.schema[c].dataType for c in cols}
    low = {c: c.lower() for c in cols}
    # Only columns whose names can score are parsed at all.
    usable = [c for c in cols if not isinstance(kinds[c], T.BooleanType) and (
        any(f in low[c] for f in TIME_FRAGMENTS) or low[c] in EXACT_TIME_NAMES
        or set(low[c].split("_")) & set(EXACT_TIME_NAMES))]
    if not usable:
        return df.select("station").limit(0).selectExpr(
            "station", "'' column", "0 score", "0D parse_ratio")
    texts = [c for c in usable if isinstance(kinds[c], T.StringType)]
    native = [c for c in usable if c not in texts]
    parts = []
    if texts:
        parts.append(parse_quality(df, texts).withColumnRenamed("times_differ", "differ"))
    if native:
        parts.append(extremes(df, native).select("station", "column", F.lit(1.0).alias("parse_ratio"), F.col("values_differ").alias("differ")))
    ranked = reduce(lambda a, b: a.unionByName(b), parts).select(
        "station", "column", time_name_score(F.col("column")).alias("score"), "parse_ratio", "differ",
        F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("column")).alias("idx"))
    best = Window.partitionBy("station").orderBy(F.col("score").desc(), F.col("parse_ratio").desc(), "idx")
    return (ranked.where("parse_ratio >= 0.8 and differ")
            .withColumn("rank", F.row_number().over(best)).where("rank = 1")
            .select("station", "column", "score", "parse_ratio"))
