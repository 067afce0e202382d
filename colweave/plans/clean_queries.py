"""Queries for cleaning, imputation and outlier treatment."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.functions.stats import rounded
from colweave.operators import clean, impute, ordered, outliers, quantiles, roles, similarity
from colweave.plans import inputs
from colweave.plans.inputs import (EVENT_COLS, EVENT_VALUES_SQL, LINE_COLS, LINE_SQL, PEARSON_CELL, RAW_COLS,
                                   RAW_SQL, USER_DAYS_SQL, event_signals_sql, pair_union_sql, table)
from colweave.plans.profile_queries import documents
from colweave.plans.registry import query


@query("union_by_name", """
SELECT 'customer' AS station, c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def union_by_name(spark, sf_dir):
    """Two tables with the same columns in a different order."""
    customers = table(spark, sf_dir, "customer").selectExpr(
        "'customer' station", "c_custkey key", "c_name name", "c_nationkey nation", "c_acctbal balance")
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_acctbal balance", "s_name name", "'supplier' station", "s_suppkey key", "s_nationkey nation")
    return customers.unionByName(suppliers)


@query("row_dedupe", """
SELECT lang AS station, min(doc_id) AS row_id, md5(text) AS text_hash, n_chars
FROM documents GROUP BY lang, text, n_chars""")
def row_dedupe(spark, sf_dir):
    kept = clean.dedupe_rows(documents(spark, sf_dir), ["text", "n_chars"])
    return kept.select("station", "row_id", F.md5(F.col("text").cast("binary")).alias("text_hash"), "n_chars")


def priced(spark, sf_dir):
    """Line items with a discount rate that is infinite where there is no discount."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("station"),
        F.when(F.col("l_discount") == 0, F.lit(float("inf")))
        .otherwise(F.try_divide("l_extendedprice", "l_discount")).alias("per_discount"),
        F.when(F.col("l_tax") == 0, F.lit(float("-inf"))).otherwise(F.col("l_tax")).alias("tax"),
        F.col("l_quantity").alias("quantity"))


PRICED_SQL = """
priced AS (
  SELECT l_returnflag AS station,
         CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice / l_discount END AS per_discount,
         CASE WHEN l_tax = 0 THEN '-inf'::DOUBLE ELSE l_tax END AS tax, l_quantity AS quantity FROM lineitem)"""


@query("infinite_to_missing", f"""WITH {PRICED_SQL}
SELECT station, round(CASE WHEN isinf(per_discount) THEN NULL ELSE per_discount END, 4) + 0.0 AS per_discount,
       CASE WHEN isinf(tax) THEN NULL ELSE tax END AS tax, quantity FROM priced""")
def infinite_to_missing(spark, sf_dir):
    out = clean.infinite_to_missing(priced(spark, sf_dir), ["per_discount", "tax", "quantity"])
    return out.withColumn("per_discount", rounded(F.col("per_discount"), 4))


@query("infinite_counts", f"WITH {PRICED_SQL} " + " UNION ALL ".join(
    f"SELECT station, '{c}' AS \"column\", count(*) FILTER (WHERE isinf({c})) AS infinite FROM priced GROUP BY station"
    for c in ("per_discount", "tax", "quantity")))
def infinite_counts(spark, sf_dir):
    return clean.infinite_counts(priced(spark, sf_dir), ["per_discount", "tax", "quantity"])


@query("sparse_columns", f"WITH {USER_DAYS_SQL} " + " UNION ALL ".join(
    f"SELECT station, '{c}' AS \"column\", round(1 - count({c}) / count(*), 6) + 0.0 AS null_ratio FROM user_days "
    f"GROUP BY station HAVING 1 - count({c}) / count(*) > 0.5" for c in EVENT_COLS))
def sparse_columns(spark, sf_dir):
    out = clean.sparse_columns(inputs.user_days(spark, sf_dir), EVENT_COLS, 0.5)
    return out.withColumn("null_ratio", rounded(F.col("null_ratio")))


@query("constant_columns", f"WITH {RAW_SQL}, wide AS (SELECT *, 7.0::DOUBLE AS fixed FROM raw) " + " UNION ALL ".join(
    f"SELECT station, '{c}' AS \"column\", round(var_pop({c}), 8) + 0.0 AS variance FROM wide GROUP BY station "
    f"HAVING var_pop({c}) <= 0.0007" for c in [*RAW_COLS, "fixed"]))
def constant_columns(spark, sf_dir):
    wide = inputs.raw_line_features(spark, sf_dir).withColumn("fixed", F.lit(7.0))
    out = clean.constant_columns(wide, [*RAW_COLS, "fixed"], 0.0007)
    return out.withColumn("variance", rounded(F.col("variance"), 8))


@query("redundant_columns", f"""WITH {LINE_SQL},
pairs AS ({pair_union_sql(LINE_COLS, PEARSON_CELL, "line")})
SELECT station, target AS "column", string_agg(source, ',' ORDER BY i) AS correlated_with
FROM pairs WHERE abs(value) > 0.99 GROUP BY station, target""")
def redundant_columns(spark, sf_dir):
    pairs = similarity.pearson_pairs(inputs.line_features(spark, sf_dir), LINE_COLS)
    out = clean.redundant_columns(pairs, 0.99)
    return out.withColumn("correlated_with", F.concat_ws(",", "correlated_with"))


def order_roles(spark, sf_dir):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "discounted", "fee"]
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("station"), *cols[:5],
        (F.col("o_totalprice") * 0.9).alias("discounted"), F.sqrt("o_totalprice").alias("fee"))
    return rows, cols, roles.column_roles(rows, cols, ["o_orderkey"])


FEATURE_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice", "discounted", "fee"]
FEATURE_SQL = f"""
o AS (SELECT o_orderpriority AS station, *, o_totalprice * 0.9 AS discounted, sqrt(o_totalprice) AS fee FROM orders),
steps AS (SELECT *, o_orderkey - lag(o_orderkey) OVER w AS d_o_orderkey, o_custkey - lag(o_custkey) OVER w AS d_o_custkey
          FROM o WINDOW w AS (PARTITION BY station ORDER BY o_orderkey)),
numeric_features AS (
  """ + " UNION ALL ".join(f"""SELECT station, '{c}' AS "column" FROM steps GROUP BY station
  HAVING NOT bool_and(coalesce(d_{c} = 1, true)) AND count(DISTINCT {c}) > 20
     AND NOT (count(DISTINCT {c}) / count(*) < 0.05 AND count(DISTINCT {c}) < 100)"""
    for c in ("o_orderkey", "o_custkey")) + """
  UNION ALL SELECT DISTINCT station, c FROM o, (VALUES ('o_totalprice'), ('discounted'), ('fee')) v(c)),
pairs AS (""" + pair_union_sql(FEATURE_NUMBERS, PEARSON_CELL, "o") + """),
features AS (
  SELECT station, "column" FROM numeric_features f WHERE NOT EXISTS (
    SELECT 1 FROM pairs p WHERE p.station = f.station AND p.target = f."column" AND abs(p.value) > 0.9))"""


@query("feature_selection", f'WITH {FEATURE_SQL} SELECT station, "column" FROM features')
def feature_selection(spark, sf_dir):
    """Numeric features without the columns that follow an earlier one."""
    rows, cols, found = order_roles(spark, sf_dir)
    drops = clean.redundant_columns(similarity.pearson_pairs(rows, FEATURE_NUMBERS), 0.9)
    return clean.selected_features(found, drops).select("station", "column")


@query("feature_guard", f"""WITH {FEATURE_SQL},
n AS (SELECT o.station, count(DISTINCT f."column") AS features FROM o LEFT JOIN features f USING (station) GROUP BY o.station)
SELECT station, features, CASE WHEN features < 2 THEN 'Failed' ELSE 'Success' END AS status,
       features < 3 AS embeddings_skipped,
       CASE WHEN features < 2 THEN 'insufficient features' WHEN features < 3 THEN 'embeddings skipped'
            WHEN features < 5 THEN 'fewer than 5 nodes' WHEN features < 10 THEN 'fewer than 10 nodes'
            ELSE '' END AS warning FROM n""")
def feature_guard(spark, sf_dir):
    rows, _, _ = order_roles(spark, sf_dir)
    features = feature_selection(spark, sf_dir)
    return clean.feature_guard(features, rows)


@query("imputation_strategy", """
WITH s AS (
  SELECT event_type AS station, count(*) AS rows, true AS has_timestamp FROM events GROUP BY event_type
  UNION ALL SELECT 'docs-' || lang, count(*), false FROM documents GROUP BY lang
  UNION ALL SELECT 'lines-' || l_returnflag, count(*), false FROM lineitem GROUP BY l_returnflag)
SELECT station, rows, CASE WHEN has_timestamp THEN 'interpolate' ELSE 'median' END AS strategy FROM s""")
def imputation_strategy(spark, sf_dir):
    def counted(name, key, prefix, timed):
        return table(spark, sf_dir, name).groupBy(F.concat(F.lit(prefix), F.col(key)).alias("station")).agg(
            F.count(F.lit(1)).alias("rows"), F.lit(timed).alias("has_timestamp"))
    stations = (counted("events", "event_type", "", True).unionByName(counted("documents", "lang", "docs-", False))
                .unionByName(counted("lineitem", "l_returnflag", "lines-", False)))
    return impute.choose_strategy(stations, "auto").drop("has_timestamp")


FILL_SQL = """
filled AS (
  SELECT station, row_id, """ + ", ".join(
    f"""coalesce(last_value({c} IGNORE NULLS) OVER past,
          first_value({c} IGNORE NULLS) OVER future) AS {c}""" for c in EVENT_COLS) + """
  FROM signals
  WINDOW past AS (PARTITION BY station ORDER BY ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         future AS (PARTITION BY station ORDER BY ts, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("fill_both_ways", f"""WITH {event_signals_sql("'user ' || user_id")}, {FILL_SQL}
SELECT station, row_id, {", ".join(EVENT_COLS)} FROM filled""")
def fill_both_ways(spark, sf_dir):
    rows = inputs.event_signals(spark, sf_dir, "concat('user ', user_id)")
    return ordered.fill_both_ways(rows, EVENT_COLS).select("station", "row_id", *EVENT_COLS)


INTERPOLATE_SQL = """
near AS (
  SELECT station, row_id, epoch_us(ts) AS t, """ + ", ".join(f"""{c},
    last_value({c} IGNORE NULLS) OVER past AS v0_{c},
    last_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER past AS t0_{c},
    first_value({c} IGNORE NULLS) OVER future AS v1_{c},
    first_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER future AS t1_{c}"""
    for c in EVENT_COLS) + """
  FROM signals
  WINDOW past AS (PARTITION BY station ORDER BY ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         future AS (PARTITION BY station ORDER BY ts, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT station, row_id, """ + ", ".join(
    f"""round(coalesce({c}, v0_{c} + (v1_{c} - v0_{c}) * ((t - t0_{c}) / nullif(t1_{c} - t0_{c}, 0)),
          v0_{c}, v1_{c}), 6) + 0.0 AS {c}""" for c in EVENT_COLS) + " FROM near"


@query("time_interpolation", f"WITH {event_signals_sql()}, {INTERPOLATE_SQL}")
def time_interpolation(spark, sf_dir):
    """One station that holds every row."""
    out = ordered.interpolate_in_time(inputs.event_signals(spark, sf_dir), EVENT_COLS)
    return out.select("station", "row_id", *[rounded(F.col(c)).alias(c) for c in EVENT_COLS])


@query("time_interpolation_users", f"""WITH {event_signals_sql("'user ' || user_id")}, {INTERPOLATE_SQL}""")
def time_interpolation_users(spark, sf_dir):
    rows = inputs.event_signals(spark, sf_dir, "concat('user ', user_id)")
    out = ordered.interpolate_in_time(rows, EVENT_COLS)
    return out.select("station", "row_id", *[rounded(F.col(c)).alias(c) for c in EVENT_COLS])


@query("column_medians", f"""WITH {USER_DAYS_SQL}
SELECT station, {", ".join(f"round(coalesce(median({c}), 0), 6) + 0.0 AS {c}" for c in EVENT_COLS)}
FROM user_days GROUP BY station""")
def column_medians(spark, sf_dir):
    out = quantiles.medians(inputs.user_days(spark, sf_dir), EVENT_COLS)
    return out.select("station", *[rounded(F.col(c)).alias(c) for c in EVENT_COLS])


@query("column_modes", " UNION ALL ".join(f"""
SELECT station, '{c}' AS "column", value FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY n DESC, value) AS rk FROM (
    SELECT o_orderpriority AS station, {e} AS value, count(*) AS n FROM orders
    WHERE {e} IS NOT NULL GROUP BY o_orderpriority, {e})) WHERE rk = 1"""
    for c, e in (("status", "o_orderstatus"), ("day", "strftime(o_orderdate, '%Y-%m-%d')"))))
def column_modes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("station"), F.col("o_orderstatus").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return quantiles.value_modes(rows, ["status", "day"])


@query("impute_median_mode", f"""WITH {event_signals_sql("'user ' || user_id")},
coded AS (SELECT *, CASE WHEN click IS NOT NULL AND click > 10 THEN 'high'
                         WHEN click IS NOT NULL THEN 'low' END AS level FROM signals),
fills AS (SELECT station, {", ".join(f"coalesce(median({c}), 0) AS f_{c}" for c in EVENT_COLS)},
  CASE WHEN count(level) = 0 THEN 'missing'
       WHEN count(*) FILTER (WHERE level = 'low') > count(*) FILTER (WHERE level = 'high') THEN 'low'
       ELSE 'high' END AS f_level FROM coded GROUP BY station)
SELECT station, row_id, {", ".join(f"round(coalesce({c}, f_{c}), 6) + 0.0 AS {c}" for c in EVENT_COLS)},
       coalesce(level, f_level) AS level FROM coded JOIN fills USING (station)""")
def impute_median_mode(spark, sf_dir):
    rows = inputs.event_signals(spark, sf_dir, "concat('user ', user_id)").withColumn(
        "level", F.when(F.col("click") > 10, "high").when(F.col("click").isNotNull(), "low"))
    out = impute.impute_median_mode(rows, [*EVENT_COLS, "level"])
    return out.select("station", "row_id", *[rounded(F.col(c)).alias(c) for c in EVENT_COLS], "level")


def _knn_sql(cols: list[str]) -> str:
    total = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN power(r.{c} - d.{c}, 2) ELSE 0 END"
                       for c in cols)
    shared = " + ".join(f"(r.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in cols)
    gap = " OR ".join(f"r.{c} IS NULL" for c in cols)
    parts = ", ".join(
        f"""f_{c} AS (SELECT row_id, avg(v) AS v FROM (
      SELECT row_id, v, row_number() OVER (PARTITION BY row_id ORDER BY dist, donor) AS rk
      FROM (SELECT near.row_id, donor, dist, d.{c} AS v FROM near JOIN user_days d ON d.row_id = donor
            JOIN user_days r ON r.row_id = near.row_id WHERE r.{c} IS NULL AND d.{c} IS NOT NULL))
      WHERE rk <= 5 GROUP BY row_id)""" for c in cols)
    return f"""
near AS (SELECT * FROM (
  SELECT r.row_id, d.row_id AS donor, ({total}) * ({len(cols)} / nullif({shared}, 0)) AS dist
  FROM user_days r, user_days d
  WHERE {gap}) WHERE dist IS NOT NULL),
means AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in cols)} FROM user_days),
{parts}
SELECT 'users' AS station, u.row_id, """ + ", ".join(
        f"round(coalesce(u.{c}, f_{c}.v, m_{c}), 6) + 0.0 AS {c}"
        for c in cols) + " FROM user_days u CROSS JOIN means " + " ".join(
        f"LEFT JOIN f_{c} ON f_{c}.row_id = u.row_id" for c in cols)


@query("knn_imputation", f"WITH {USER_DAYS_SQL}, {_knn_sql(EVENT_COLS)}")
def knn_imputation(spark, sf_dir):
    """Neighbour imputation of one station that holds every row."""
    rows = inputs.user_days(spark, sf_dir)
    counts = similarity.row_counts(rows).withColumn("has_timestamp", F.lit(False))
    out = impute.impute(rows, EVENT_COLS, impute.choose_strategy(counts, "knn"))
    return out.select("station", "row_id", *[rounded(F.col(c)).alias(c) for c in EVENT_COLS])


BOUND_SQL = """
b AS (
  SELECT station, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
         quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99,
         avg(value) AS m, stddev_samp(value) AS s FROM readings GROUP BY station),
f AS (SELECT *, {low} AS lo, {high} AS hi FROM b),
n AS (SELECT station, count(*) FILTER (WHERE value < lo OR value > hi) AS hits
      FROM readings JOIN f USING (station) GROUP BY station)"""
IQR_BOUNDS = BOUND_SQL.format(low="q1 - 1.5 * (q3 - q1)", high="q3 + 1.5 * (q3 - q1)")
Z_BOUNDS = BOUND_SQL.format(low="m - 3 * s", high="m + 3 * s")


def _treated(spark, sf_dir, method, treatment):
    out = outliers.treat_outliers(inputs.event_values(spark, sf_dir), ["value"], method, treatment)
    return out.select("station", "row_id", rounded(F.col("value")).alias("value"))


for _method, _bounds in (("iqr", IQR_BOUNDS), ("z_score", Z_BOUNDS)):
    for _treatment, _low, _high in (("clip", "lo", "hi"), ("winsorize", "p1", "p99")):
        query(f"outliers_{_method}_{_treatment}", f"""WITH {EVENT_VALUES_SQL}, {_bounds}
SELECT station, row_id, round(CASE WHEN hits > 0 THEN greatest(least(value, {_high}), {_low}) ELSE value END, 6) + 0.0
       AS value FROM readings JOIN f USING (station) JOIN n USING (station)""")(
            lambda spark, sf_dir, m=_method, t=_treatment: _treated(spark, sf_dir, m, t))


@query("outlier_report", f"""WITH {EVENT_VALUES_SQL}, {IQR_BOUNDS}
SELECT station, 'value' AS "column", hits AS outliers, round(lo, 4) + 0.0 AS lower_bound,
       round(hi, 4) + 0.0 AS upper_bound FROM f JOIN n USING (station) WHERE hits > 0""")
def outlier_report(spark, sf_dir):
    out = outliers.outlier_report(inputs.event_values(spark, sf_dir), ["value"], "iqr")
    return out.select("station", "column", "outliers", rounded(F.col("lower_bound"), 4).alias("lower_bound"),
                      rounded(F.col("upper_bound"), 4).alias("upper_bound"))
