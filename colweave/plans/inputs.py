"""Feature tables derived from the given tables, as DataFrames and as SQL text.

Each derivation keeps every row of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Line items: five price columns that depend on each other, one station per return flag.
LINE_COLS = ["quantity", "price", "net", "charge", "discount_amt"]


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("station"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        net.alias("net"), (net * (1 + F.col("l_tax"))).alias("charge"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amt"))


LINE_SQL = """
line AS (
  SELECT l_returnflag AS station, l_quantity AS quantity, l_extendedprice AS price,
         l_extendedprice * (1 - l_discount) AS net,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
         l_extendedprice * l_discount AS discount_amt
  FROM lineitem)"""

LINE_STATS_SQL = LINE_SQL + """,
line_stats AS (
  SELECT station, """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE_COLS) + """
  FROM line GROUP BY station),
scaled AS (
  SELECT station, """ + ", ".join(
    f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in LINE_COLS) + """
  FROM line JOIN line_stats USING (station))"""

# Raw line item columns: practically uncorrelated, so their graph has isolated nodes.
RAW_COLS = ["quantity", "price", "discount", "tax"]


def raw_line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("station"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


RAW_SQL = """
raw AS (
  SELECT l_returnflag AS station, l_quantity AS quantity, l_extendedprice AS price,
         l_discount AS discount, l_tax AS tax
  FROM lineitem)"""

# Embedding vectors as 64 numeric columns in one station.
VECTOR_COLS = [f"d{i:02d}" for i in range(64)]


def vector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.lit("vectors").alias("station"), F.col("vec_id").alias("row_id"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VECTOR_COLS)])


VECTOR_SQL = """
cells AS (
  SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings)"""

# Events as a wide sensor log: each row carries the one signal that fired.
EVENT_COLS = ["click", "error", "purchase", "signup", "view"]


def event_signals(spark: SparkSession, sf_dir: str, station: str = "'log'") -> DataFrame:
    """Row per event, one column per type, NULL where another type fired."""
    return table(spark, sf_dir, "events").select(
        F.expr(station).alias("station"), "ts", F.col("event_id").alias("row_id"),
        *[F.when(F.col("event_type") == c, F.col("value")).alias(c) for c in EVENT_COLS])


def event_signals_sql(station: str = "'log'") -> str:
    return f"""
signals AS (
  SELECT {station} AS station, ts, event_id AS row_id, """ + ", ".join(
        f"CASE WHEN event_type = '{c}' THEN value END AS {c}" for c in EVENT_COLS) + """
  FROM events)"""


# One row per user and day, total value per event type (to the cent), NULL where none happened.
def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return (events.groupBy("user_id", F.to_date("ts").alias("day"))
            .agg(*[F.round(F.sum(F.when(F.col("event_type") == c, F.col("value"))), 2).alias(c) for c in EVENT_COLS])
            .select(F.lit("users").alias("station"),
                    F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("row_id"),
                    *EVENT_COLS))


USER_DAYS_SQL = """
user_days AS (
  SELECT 'users' AS station, user_id::VARCHAR || '/' || CAST(ts AS DATE)::VARCHAR AS row_id, """ + ", ".join(
    f"round(sum(value) FILTER (WHERE event_type = '{c}'), 2) AS {c}" for c in EVENT_COLS) + """
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station"), F.col("event_id").alias("row_id"), "ts", "value")


EVENT_VALUES_SQL = """
readings AS (SELECT event_type AS station, event_id AS row_id, ts, value FROM events)"""


def pair_union_sql(cols: list[str], cell: str, source: str, diagonal: bool = False) -> str:
    """One grouped SELECT per column pair, joined by UNION ALL; ``{a}``/``{b}`` name the pair."""
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j or (diagonal and i == j):
                parts.append(f"SELECT station, {i} AS i, {j} AS j, '{a}' AS source, '{b}' AS target, "
                             f"{cell.format(a=a, b=b)} AS value FROM {source} GROUP BY station")
    return "\n  UNION ALL ".join(parts)


PEARSON_CELL = ("coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) * "
                "stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL), 0), 0)")
