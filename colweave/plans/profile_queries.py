"""Queries for table profiles, column roles and the time column search."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.functions.stats import rounded
from colweave.operators import ordered, profile, roles
from colweave.plans import inputs
from colweave.plans.inputs import (EVENT_VALUES_SQL, LINE_COLS, LINE_SQL, table)
from colweave.plans.registry import query
from colweave.session import materialise

DOC_COLS = ["source", "text", "n_chars"]


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("station"), F.col("doc_id").alias("row_id"), *DOC_COLS)


@query("table_profile", """
SELECT lang AS station, count(*) AS rows, 3::BIGINT AS cols,
       (8 * count(*) + sum(strlen(source)) + sum(strlen(text)))::BIGINT AS bytes
FROM documents GROUP BY lang""")
def table_profile(spark, sf_dir):
    return profile.table_profile(documents(spark, sf_dir), DOC_COLS)


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.lit("orders").alias("station"), *ORDER_COLS)


ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}


def _column_profile_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT station, '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
        count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_values,
        round((count(*) - count({c})) / count(*), 6) + 0.0 AS null_ratio FROM {source} GROUP BY station"""
        for c in cols)


@query("column_profile", f"""WITH {inputs.USER_DAYS_SQL}
{_column_profile_sql("user_days", inputs.EVENT_COLS)}""".replace("AS distinct_values", "AS distinct_values"))
def column_profile(spark, sf_dir):
    out = profile.column_profile(inputs.user_days(spark, sf_dir), inputs.EVENT_COLS)
    return out.select("station", "column", "rows", "nulls", "distinct_values",
                      rounded(F.col("null_ratio")).alias("null_ratio"))


@query("column_profile_orders", f"""WITH o AS (SELECT 'orders' AS station, * FROM orders)
{_column_profile_sql("o", ORDER_COLS)}""")
def column_profile_orders(spark, sf_dir):
    out = profile.column_profile(orders(spark, sf_dir), ORDER_COLS)
    return out.select("station", "column", "rows", "nulls", "distinct_values",
                      rounded(F.col("null_ratio")).alias("null_ratio"))


@query("column_profile_sketched", """WITH d AS (SELECT lang AS station, doc_id, source, text, n_chars FROM documents)
""" + " UNION ALL ".join(
    f"""SELECT station, '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, true AS within FROM d GROUP BY station"""
    for c in ("doc_id", "source", "text", "n_chars")))
def column_profile_sketched(spark, sf_dir):
    """Estimates from sketches kept per source lie within 4 % of the exact counts (five standard errors), or one value."""
    cols = ["doc_id", "source", "text", "n_chars"]
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("station"), *cols, F.col("source").alias("part"))
    about = profile.profile_of_sketches(profile.distinct_sketches(docs, cols, ["part"]))
    exact = profile.column_profile(docs, cols).select(
        F.col("station").alias("s"), F.col("column").alias("c"), F.col("distinct_values").alias("values"))
    off = F.abs(F.col("distinct_values") - F.col("values")) <= F.greatest(F.lit(1.0), 0.04 * F.col("values"))
    return (about.join(exact, F.col("station").eqNullSafe(F.col("s")) & (F.col("column") == F.col("c")))
            .select("station", "column", "rows", "nulls", off.alias("within")))


@query("duplicate_row_counts", """
SELECT lang AS station, count(*) AS rows, count(*) - count(DISTINCT text) AS duplicate_rows
FROM documents GROUP BY lang""")
def duplicate_row_counts(spark, sf_dir):
    return profile.duplicate_rows(documents(spark, sf_dir), ["text"])


@query("duplicate_columns", f"""WITH {LINE_SQL},
wide AS (SELECT *, quantity AS units, price AS list_price, price + 1 AS raised, price AS amount FROM line)
""" + " UNION ALL ".join(
    f"SELECT station, '{a}' AS first_column, '{b}' AS duplicate_column FROM wide GROUP BY station "
    f"HAVING bool_and({a} IS NOT DISTINCT FROM {b})"
    for a, b in [("quantity", "units"), ("price", "list_price"), ("price", "amount"), ("price", "raised"),
                 ("quantity", "price"), ("net", "charge"), ("price", "net")]))
def duplicate_columns(spark, sf_dir):
    wide = inputs.line_features(spark, sf_dir).select(
        "*", F.col("quantity").alias("units"), F.col("price").alias("list_price"),
        (F.col("price") + 1).alias("raised"), F.col("price").alias("amount"))
    return profile.duplicate_columns(wide, [*LINE_COLS, "units", "list_price", "raised", "amount"])


def _iqr_sql(source: str, c: str) -> str:
    return f"""SELECT t.station, '{c}' AS "column",
    count(*) FILTER (WHERE q3 > q1 AND (t.{c} < q1 - 1.5 * (q3 - q1) OR t.{c} > q3 + 1.5 * (q3 - q1))) AS outliers,
    round(any_value(q1 - 1.5 * (q3 - q1)), 4) + 0.0 AS lower_bound,
    round(any_value(q3 + 1.5 * (q3 - q1)), 4) + 0.0 AS upper_bound
    FROM {source} t JOIN (SELECT station, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3
                          FROM {source} GROUP BY station) f USING (station) GROUP BY t.station"""


def _z_sql(source: str, c: str) -> str:
    return f"""SELECT t.station, '{c}' AS "column",
    count(*) FILTER (WHERE abs((t.{c} - m) / nullif(s, 0)) > 3) AS outliers,
    round(any_value(m - 3 * s), 4) + 0.0 AS lower_bound, round(any_value(m + 3 * s), 4) + 0.0 AS upper_bound
    FROM {source} t JOIN (SELECT station, avg({c}) AS m, stddev_samp({c}) AS s
                          FROM {source} GROUP BY station) f USING (station) GROUP BY t.station"""


def _bounds(found):
    return found.select("station", "column", "outliers", rounded(F.col("lower_bound"), 4).alias("lower_bound"),
                        rounded(F.col("upper_bound"), 4).alias("upper_bound"))


@query("iqr_outlier_counts", f"WITH {EVENT_VALUES_SQL} {_iqr_sql('readings', 'value')}")
def iqr_outlier_counts(spark, sf_dir):
    return _bounds(profile.iqr_outliers(inputs.event_values(spark, sf_dir), ["value"]))


@query("iqr_outlier_counts_lines", f"WITH {LINE_SQL} " + " UNION ALL ".join(_iqr_sql("line", c) for c in LINE_COLS))
def iqr_outlier_counts_lines(spark, sf_dir):
    return _bounds(profile.iqr_outliers(inputs.line_features(spark, sf_dir), LINE_COLS))


@query("zscore_outlier_counts", f"WITH {EVENT_VALUES_SQL} {_z_sql('readings', 'value')}")
def zscore_outlier_counts(spark, sf_dir):
    return _bounds(profile.zscore_outliers(inputs.event_values(spark, sf_dir), ["value"]))


@query("zscore_outlier_counts_lines", f"WITH {LINE_SQL} " + " UNION ALL ".join(_z_sql("line", c) for c in LINE_COLS))
def zscore_outlier_counts_lines(spark, sf_dir):
    return _bounds(profile.zscore_outliers(inputs.line_features(spark, sf_dir), LINE_COLS))


@query("node_stats", """
WITH coded AS (
  SELECT event_type AS station, value, props, json_extract_string(props, '$.k') AS k,
         CASE WHEN value > 100 THEN 'high' ELSE value::VARCHAR END AS reading FROM events)
""" + " UNION ALL ".join(f"""SELECT station, '{c}' AS node, round(avg(try_cast({c} AS DOUBLE)), 6) + 0.0 AS mean,
  round(stddev_pop(try_cast({c} AS DOUBLE)), 6) + 0.0 AS std, min(try_cast({c} AS DOUBLE)) AS min,
  max(try_cast({c} AS DOUBLE)) AS max FROM coded GROUP BY station""" for c in ("value", "k", "reading")))
def node_stats(spark, sf_dir):
    """Text columns are read as numbers where they are numbers."""
    coded = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station"), "value", F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("value") > 100, "high").otherwise(F.col("value").cast("string")).alias("reading"))
    out = profile.node_stats(coded, ["value", "k", "reading"])
    return out.select("station", "node", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"),
                      "min", "max")


@query("audit_report", f"""WITH {EVENT_VALUES_SQL},
prof AS (SELECT station, count(*) AS rows, 2::BIGINT AS cols, 16 * count(*) AS bytes,
         count(*) - count(DISTINCT (ts, value)) AS duplicate_rows FROM readings GROUP BY station),
iqr AS ({_iqr_sql('readings', 'value')}), z AS ({_z_sql('readings', 'value')}),
d AS (SELECT station, count(DISTINCT value) AS distinct_values, count(*) - count(value) AS nulls
      FROM readings GROUP BY station)
SELECT station, rows, cols, bytes, duplicate_rows, distinct_values, nulls,
       iqr.outliers AS outliers_iqr, z.outliers AS outliers_zscore
FROM prof JOIN iqr USING (station) JOIN z USING (station) JOIN d USING (station)""")
def audit_report(spark, sf_dir):
    """The nested audit, flattened for its ``value`` column."""
    out = profile.audit(inputs.event_values(spark, sf_dir).drop("row_id"), ["ts", "value"])
    value = F.element_at(F.filter("columns", lambda c: c["column"] == "value"), 1)
    return out.select("station", "rows", "cols", "bytes", "duplicate_rows",
                      *[value[n].alias(n) for n in ("distinct_values", "nulls", "outliers_iqr", "outliers_zscore")])


# ---------------------------------------------------------------- order and roles

@query("chronological_sort", """
SELECT event_type AS station, event_id AS row_id, ts,
       row_number() OVER (ORDER BY event_type, ts, event_id) AS place FROM events""")
def chronological_sort(spark, sf_dir):
    """Global place of every event in the sorted table."""
    rows = ordered.chronological(inputs.event_values(spark, sf_dir)).select(
        "station", "row_id", "ts", F.lit("all").alias("everything"), F.lit(1).alias("one"),
        F.monotonically_increasing_id().alias("at"))
    # Numbers given after the sort grow with it; their running count has no gaps.
    placed = ordered.running_total(materialise(rows), ["everything"], ["at"], "one", "place", limit=100)
    return placed.select("station", "row_id", F.col("ts").cast("timestamp").alias("ts"), "place")


@query("sequence_tests", """
WITH steps AS (
  SELECT *, event_id - lag(event_id) OVER w AS d_id, user_id - lag(user_id) OVER w AS d_user
  FROM events WINDOW w AS (ORDER BY ts, event_id))
SELECT 'log' AS station, 'event_id' AS "column", coalesce(bool_and(d_id >= 0), true) AS monotonic,
       coalesce(bool_and(d_id = 1), true) AS consecutive FROM steps
UNION ALL
SELECT 'log', 'user_id', coalesce(bool_and(d_user >= 0), true), coalesce(bool_and(d_user = 1), true) FROM steps""")
def sequence_tests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit("log").alias("station"), "ts", "event_id", "user_id")
    return ordered.sequence_tests(rows, ["event_id", "user_id"], ["ts", "event_id"])


@query("head_sample", " UNION ALL ".join(f"""
SELECT station, '{c}' AS "column", value, rank FROM (
  SELECT event_type AS station, {c} AS value, event_id,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank
  FROM (SELECT event_type, ts, event_id, value,
               CASE WHEN value > 5 THEN value * 2 END AS doubled FROM events) WHERE {c} IS NOT NULL)
WHERE rank <= 100""" for c in ("value", "doubled")))
def head_sample(spark, sf_dir):
    rows = inputs.event_values(spark, sf_dir).withColumn("doubled", F.when(F.col("value") > 5, F.col("value") * 2))
    long = rows.unpivot(["station", "ts", "row_id"], ["value", "doubled"], "column", "value")
    return ordered.head_sample(long, 100, ["ts", "row_id"]).select("station", "column", "value", "rank")


def _role_sql(source: str, kinds: dict[str, str], order: str) -> str:
    """The role rules for one station, one SELECT per column."""
    parts = []
    for c, kind in kinds.items():
        whole, text = kind == "bigint", kind == "string"
        name = f"'{c}'"
        id_like = " OR ".join(f"{name} = '{k}' OR ends_with({name}, '_{k}') OR starts_with({name}, '{k}_')"
                              for k in roles.ID_NAMES)
        target = " OR ".join(f"{name} = '{k}' OR ends_with({name}, '_{k}')" for k in roles.TARGET_NAMES)
        time_like = " OR ".join(f"contains({name}, '{k}')" for k in roles.TIME_NAMES)
        sample = f"(SELECT {c} AS v FROM {source} WHERE {c} IS NOT NULL)"
        is_time = "false"
        if kind == "timestamp":
            is_time = "true"
        elif whole:
            is_time = (f"(SELECT (({time_like}) OR max(v) > 1e9) AND count(DISTINCT v) > 1 FROM {sample})")
        elif text:
            is_time = (f"(SELECT count(try_cast(v AS TIMESTAMP)) / count(*) > 0.8 "
                       f"AND count(DISTINCT try_cast(v AS TIMESTAMP)) > 1 FROM {sample})")
        sequence = "false"
        if whole:
            sequence = (f"(SELECT bool_and(d >= 0) AND bool_and(d = 1) FROM "
                        f"(SELECT {c} - lag({c}) OVER (ORDER BY {order}) AS d FROM {source}))")
        ratio = f"(SELECT count(DISTINCT {c}) / count(*) FROM {source})"
        few = f"(SELECT count(DISTINCT {c}) <= 20 FROM {source})"
        parts.append(f"""SELECT 'orders' AS station, {name} AS "column", CASE WHEN {target} THEN 'Target Candidate'
          WHEN {is_time} THEN 'Timestamp' WHEN {sequence} THEN 'Sequential Index'
          WHEN ({id_like}) AND ({ratio} > 0.8 OR {str(text).lower()}) THEN 'Identifier'
          WHEN {str(text).lower()} AND {ratio} = 1.0 THEN 'Identifier'
          WHEN {str(text).lower()} THEN 'Categorical Feature'
          WHEN {str(whole).lower()} AND ({few} OR ({ratio} < 0.05 AND
            (SELECT count(DISTINCT {c}) < 100 FROM {source}))) THEN 'Categorical Feature'
          ELSE 'Numeric Feature' END AS role""")
    return " UNION ALL ".join(parts)


ROLE_KINDS = {**ORDER_TYPES, "order_day": "string", "weekday": "bigint", "customer_id": "bigint",
              "status_label": "string", "order_code": "string"}


@query("column_roles", f"""WITH o AS (
  SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS order_day, dayofweek(o_orderdate)::BIGINT AS weekday,
         o_custkey AS customer_id, o_orderstatus AS status_label, 'C' || o_orderkey AS order_code FROM orders)
{_role_sql("o", ROLE_KINDS, "o_orderkey")}""")
def column_roles(spark, sf_dir):
    wide = orders(spark, sf_dir).withColumns({
        "order_day": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "weekday": (F.dayofweek("o_orderdate") - 1).cast("long"), "customer_id": F.col("o_custkey"),
        "status_label": F.col("o_orderstatus"),
        "order_code": F.concat(F.lit("C"), F.col("o_orderkey").cast("string"))})
    return roles.column_roles(wide, list(ROLE_KINDS), ["o_orderkey"]).select("station", "column", "role")


@query("timestamp_search", """
WITH t AS (
  SELECT event_type AS station, ts, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_ts,
         CASE WHEN value > 3 THEN strftime(ts, '%Y-%m-%d') ELSE 'unknown' END AS date,
         strftime(ts, '%Y-%m-%d') AS update_day FROM events),
s AS (
  SELECT station, 'created_ts' AS "column", 2 AS score, created_ts AS v, 1 AS idx FROM t
  UNION ALL SELECT station, 'date', 3, date, 2 FROM t
  UNION ALL SELECT station, 'update_day', 1, update_day, 3 FROM t),
q AS (
  SELECT station, "column", score, idx, count(try_cast(v AS TIMESTAMP)) / count(*) AS ratio,
         count(DISTINCT try_cast(v AS TIMESTAMP)) AS times FROM s
  GROUP BY station, "column", score, idx)
SELECT station, "column", score, round(ratio, 6) + 0.0 AS parse_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY score DESC, ratio DESC, idx) AS rk
  FROM q WHERE ratio >= 0.8 AND times > 1) WHERE rk = 1""")
def timestamp_search(spark, sf_dir):
    """Three candidate text columns; the best named one holds some text that is no date."""
    rows = inputs.event_values(spark, sf_dir).withColumns({
        "created_ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "date": F.when(F.col("value") > 3, F.date_format("ts", "yyyy-MM-dd")).otherwise("unknown"),
        "update_day": F.date_format("ts", "yyyy-MM-dd")})
    out = roles.likely_timestamp(rows, ["created_ts", "date", "update_day", "value"], ["ts", "row_id"])
    return out.select("station", "column", "score", rounded(F.col("parse_ratio")).alias("parse_ratio"))
