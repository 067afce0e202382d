import numpy as np
import pytest
from pyspark.sql import functions as F

from colweave.session import materialise
from colweave.operators import clean, impute, ordered, outliers, profile, quantiles, roles, scale, similarity


def test_one_column_per_role(spark):
    df = spark.createDataFrame([
        ("s", 0, "2026-06-01", 0, 1.2, "type_a", "ST_1", 100.0, True),
        ("s", 1, "2026-06-02", 1, 3.4, "type_b", "ST_1", 105.0, False),
        ("s", 2, "2026-06-03", 2, 5.6, "type_a", "ST_1", 110.0, True)],
        "station string, row_id long, timestamp_col string, index long, feature_1 double, feature_category string, "
        "station_id string, y_target double, flag boolean")
    cols = [c for c in df.columns if c not in ("station", "row_id")]
    got = {r["column"]: r["role"] for r in roles.column_roles(df, cols, ["row_id"]).collect()}
    assert got == {"timestamp_col": roles.TIMESTAMP, "index": roles.SEQUENCE, "feature_1": roles.NUMERIC,
                   "feature_category": roles.CATEGORICAL, "station_id": roles.IDENTIFIER,
                   "y_target": roles.TARGET, "flag": roles.CATEGORICAL}


def test_loose_time_names_and_gappy_integers(spark):
    data = [("s", i, 5 + i * 3 % 7, 1_700_000_000_000 + i, i if i % 5 else None, i * 37 % 101) for i in range(60)]
    df = spark.createDataFrame(data, "station string, row_id long, counts long, big long, gappy long, plain long")
    cols = ["counts", "big", "gappy", "plain"]
    got = {r["column"]: r["role"] for r in roles.column_roles(df, cols, ["row_id"]).collect()}
    # 'counts' contains 'ts'; a column with gaps is no integer column.
    assert got == {"counts": roles.TIMESTAMP, "big": roles.TIMESTAMP, "gappy": roles.NUMERIC, "plain": roles.NUMERIC}
    strict = {r["column"]: r["role"] for r in roles.column_roles(df, cols, ["row_id"], True).collect()}
    assert strict["counts"] == roles.CATEGORICAL


@pytest.fixture
def messy(spark):
    return spark.createDataFrame([
        ("s", 0, "2026-06-01", 5.0, 1.0, 10.0, 10.0), ("s", 1, "2026-06-02", 5.0, None, 15.0, 15.0),
        ("s", 2, "2026-06-03", 5.0, 3.0, 30.0, 30.0), ("s", 3, "2026-06-03", 5.0, 3.0, 30.0, 30.0)],
        "station string, row_id long, time string, feat_constant double, feat_missing double, feat_a double, "
        "feat_b double")


def test_cleaning_steps(messy, rows):
    cols = ["time", "feat_constant", "feat_missing", "feat_a", "feat_b"]
    kept = clean.dedupe_rows(messy, cols)
    assert rows(kept, "row_id") == [(0,), (1,), (2,)]
    filled = impute.impute_median_mode(kept, ["feat_missing"])
    assert rows(filled, "row_id", "feat_missing") == [(0, 1.0), (1, 2.0), (2, 3.0)]
    assert rows(clean.constant_columns(filled, cols[1:], 1e-5), "column") == [("feat_constant",)]
    pairs = similarity.pearson_pairs(filled, cols[2:])
    redundant = {r["column"]: r["correlated_with"] for r in clean.redundant_columns(pairs, 0.99).collect()}
    assert redundant["feat_b"] == ["feat_a"] or "feat_a" in redundant["feat_b"]
    drops = clean.redundant_columns(similarity.pearson_pairs(filled, cols[3:]), 0.99)
    out, left = clean.apply_drops(filled, drops, cols)
    assert left == cols[:4] and "feat_b" not in out.columns


def test_missing_kinds(spark, rows):
    df = spark.createDataFrame([("s", 1.0), ("s", float("nan")), ("s", float("inf")), ("s", None), ("s", -float("inf"))],
                               "station string, x double")
    assert rows(clean.infinite_counts(df, ["x"]), "infinite") == [(2,)]
    assert clean.infinite_to_missing(df, ["x"]).where("x is null").count() == 4


def test_scaling(spark, rows):
    df = spark.createDataFrame([("s", "a", 1.0, 5.0, 0.0), ("s", "b", 2.0, 5.0, 1.0), ("s", "c", 3.0, 5.0, 0.0)],
                               "station string, time string, f double, fixed double, target double")
    out = scale.standard_scale(df, ["f", "fixed"])
    x = np.array([1.0, 2.0, 3.0])
    want = [(round(v, 9),) for v in (x - x.mean()) / x.std()]
    assert rows(out, "f") == want
    assert rows(out, "fixed") == [(0.0,)] * 3
    assert rows(out, "time", "target") == [("a", 0.0), ("b", 1.0), ("c", 0.0)]


GAPS = [None, None, 2.0, None, 8.0, None, None]
HOURS = [0, 1, 2, 3, 6, 7, 9]


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_time_interpolation(spark, rows, limit):
    df = spark.createDataFrame([("s", i, f"2026-01-01 {h:02d}:00:00", v) for i, (h, v) in enumerate(zip(HOURS, GAPS))],
                               "station string, row_id long, t string, v double")
    df = df.withColumn("ts", F.to_timestamp("t"))
    got = [v for _, v in rows(ordered.interpolate_in_time(df, ["v"], limit=limit), "row_id", "v")]
    assert got == [2.0, 2.0, 2.0, 3.5, 8.0, 8.0, 8.0]
    got = [v for _, v in rows(ordered.fill_both_ways(df, ["v"], limit=limit), "row_id", "v")]
    assert got == [2.0, 2.0, 2.0, 2.0, 8.0, 8.0, 8.0]


def _random_log(spark, n=400):
    rng = np.random.default_rng(1)
    data = [("hot" if rng.random() < 0.8 else "cold", int(i), int(rng.integers(0, 120)),
             float(rng.normal()) if rng.random() < 0.2 else None, float(np.round(rng.gamma(2.0), 2))) for i in range(n)]
    return spark.createDataFrame(data, "station string, row_id long, sec long, v double, w double").withColumn(
        "ts", F.timestamp_seconds("sec"))


def test_slices_agree_with_plain_windows(spark, rows):
    """Hot station over many slices, with equal timestamps across their borders."""
    df = _random_log(spark)
    for run in (ordered.interpolate_in_time, ordered.fill_both_ways):
        assert rows(run(df, ["v"], limit=1), "row_id", "v") == rows(run(df, ["v"]), "row_id", "v")
    order = ["ts", "row_id"]
    wide = df.select("station", "ts", "row_id", F.col("row_id").alias("a"), F.col("sec").alias("b"))
    assert rows(ordered.sequence_tests(wide, ["a", "b"], order, 1)) == rows(ordered.sequence_tests(wide, ["a", "b"], order))
    one = df.withColumn("one", F.lit(1))
    assert (rows(ordered.running_total(one, ["station"], order, "one", "n", 1), "row_id", "n")
            == rows(ordered.running_total(one, ["station"], order, "one", "n"), "row_id", "n"))


def test_bracketed_percentiles(spark):
    df = _random_log(spark).withColumn("w", F.when(F.col("row_id") < 150, 1.0).otherwise(F.col("w")))
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    local = df.toPandas()
    # A coarse sketch, so that brackets leave most values out.
    for limit, accuracy in ((1_000_000, 2000), (1_000_000, 12), (1, 12)):
        for r in quantiles.exact_percentiles(df, ["v", "w"], probs, limit, accuracy).collect():
            part = local[local.station == r["station"]]
            for c in ("v", "w"):
                want = np.percentile(part[c].dropna(), [100 * p for p in probs])
                assert np.allclose(r[c], want, atol=1e-12), (limit, r["station"], c)


def test_percentiles_of_large_null_and_empty_stations(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=20_000), np.repeat(0.25, 15_000), [np.inf, -np.inf]])
    rows = [(None if i % 2 else "s", float(v), None) for i, v in enumerate(x)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "station string, v double, w int").repartition(6)
    probs = [0.25, 0.5, 0.9]
    got = {r["station"]: r for r in quantiles.exact_percentiles(df, ["v", "w"], probs, 1000, 200).collect()}
    assert set(got) == {None, "s", "none"}
    for station, part in ((None, x[1::2]), ("s", x[::2])):
        assert np.allclose(got[station]["v"], np.percentile(part, [25, 50, 90]), atol=1e-12)
    assert got["none"]["v"] is None and all(r["w"] is None for r in got.values())


def test_ranks_that_the_sketch_misses_are_found(spark, monkeypatch):
    """Brackets that enclose no wanted rank: the values are sought in the whole column."""
    df = spark.createDataFrame([("s", float(i)) for i in range(1000)], "station string, v double")
    right = quantiles._bracketed
    monkeypatch.setattr(quantiles, "_bracketed", lambda *args: materialise(
        right(*args).withColumn("low", F.lit(10.0)).withColumn("high", F.lit(20.0))))
    assert np.allclose(quantiles.exact_percentiles(df, ["v"], [0.5, 0.015]).first()["v"], [499.5, 14.985])


def _knn_by_hand(x, k=5):
    out = x.copy()
    used = [c for c in range(x.shape[1]) if np.isnan(x[:, c]).any()]
    for r in range(len(x)):
        for c in used:
            if not np.isnan(x[r, c]):
                continue
            found = []
            for d in range(len(x)):
                if np.isnan(x[d, c]):
                    continue
                both = [j for j in used if not np.isnan(x[r, j]) and not np.isnan(x[d, j])]
                if both:
                    found.append((len(used) / len(both) * sum((x[r, j] - x[d, j]) ** 2 for j in both), d))
            near = [x[d, c] for _, d in sorted(found)[:k]]
            out[r, c] = np.mean(near) if near else np.nanmean(x[:, c])
    return out


def test_knn(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 4)), 1)
    x[rng.random((60, 4)) < 0.25] = np.nan
    x[:, 3] = np.round(rng.normal(size=60), 1)
    x[7, :3] = np.nan
    df = spark.createDataFrame([("s", i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)],
                               "station string, row_id long, a double, b double, c double, d double")
    # Whole columns as one slice, and slices and blocks so small that most rows look beyond their own.
    for slice_rows, visit_rows in ((4096, 2048), (8, 5)):
        out = impute.impute_knn(df, list("abcd"), slice_rows=slice_rows, visit_rows=visit_rows)
        assert np.allclose(out.orderBy("row_id").toPandas()[list("abcd")].to_numpy(), _knn_by_hand(x), atol=1e-12)


def test_strategies_per_station(spark, rows):
    facts = spark.createDataFrame([("timed", 100, True), ("short", 5, True), ("plain", 100, False), ("long", 20_000, False)],
                                  "station string, rows long, has_timestamp boolean")
    assert rows(impute.choose_strategy(facts, "auto"), "station", "strategy") == [
        ("long", "median"), ("plain", "median"), ("short", "interpolate"), ("timed", "interpolate")]
    assert {r[1] for r in rows(impute.choose_strategy(facts, "knn"), "station", "strategy")} == {"knn"}
    df = spark.createDataFrame([
        ("timed", 0, 0, 1.0, "x"), ("timed", 1, 10, None, None), ("timed", 2, 40, 5.0, "y"),
        ("plain", 0, 0, 1.0, "q"), ("plain", 1, 0, None, None), ("plain", 2, 0, 3.0, "q")],
        "station string, row_id long, sec long, v double, c string").withColumn("ts", F.timestamp_seconds("sec"))
    chosen = spark.createDataFrame([("timed", "interpolate"), ("plain", "median")], "station string, strategy string")
    assert rows(impute.impute(df, ["v", "c"], chosen), "station", "row_id", "v", "c")[1::3] == [
        ("plain", 1, 2.0, "q"), ("timed", 1, 2.0, "x")]


def test_all_missing_column(spark, rows):
    df = spark.createDataFrame([("s", 0, None, None), ("s", 1, None, None)], "station string, row_id long, v double, c string")
    assert rows(impute.impute_median_mode(df, ["v", "c"]), "v", "c") == [(0.0, "missing")] * 2


def test_mode_takes_smallest(spark, rows):
    df = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "b"), ("s", "a"), ("s", None), ("s", None), ("s", None)],
                               "station string, c string")
    assert rows(quantiles.value_modes(df, ["c"]), "value") == [("a",)]


def test_outliers(spark):
    values = [float(v) for v in range(20)] + [500.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)] + [("t", i, 1.0) for i in range(5)],
                               "station string, row_id long, x double")
    x = np.array(values)
    q1, q3 = np.percentile(x, [25, 75])
    clip = outliers.treat_outliers(df, ["x"], "iqr", "clip").where("station = 's'").agg(F.max("x")).first()[0]
    assert clip == pytest.approx(q3 + 1.5 * (q3 - q1))
    wins = outliers.treat_outliers(df, ["x"], "iqr", "winsorize").where("station = 's'").orderBy("row_id").toPandas()["x"]
    assert np.allclose(wins, np.clip(x, *np.percentile(x, [1, 99])))
    assert outliers.treat_outliers(df, ["x"], "iqr", "none") is df
    report = outliers.outlier_report(df, ["x"], "z_score").collect()
    assert [(r["station"], r["outliers"]) for r in report] == [("s", 1)]
    assert report[0]["upper_bound"] == pytest.approx(x.mean() + 3 * x.std(ddof=1))


def test_sketches_follow_a_changed_set_of_files(spark):
    made = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("s")).alias("station"),
        F.concat(F.lit("f"), (F.col("id") % 4).cast("string")).alias("file"),
        F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, F.repeat((F.col("id") % 50).cast("string"), F.lit(40))).alias("b"),
        F.lit(None).cast("double").alias("c"))
    kept = materialise(profile.distinct_sketches(made, ["a", "b", "c"], ["file"]))
    assert kept.count() == 2 * 4 * 3
    for files in (["f0", "f1", "f2", "f3"], ["f1", "f2"], ["f3"]):
        about = {(r["station"], r["column"]): r for r in profile.profile_of_sketches(
            kept.where(F.col("file").isin(files))).collect()}
        exact = profile.column_profile(made.where(F.col("file").isin(files)), ["a", "b", "c"]).collect()
        assert len(about) == len(exact) == 6
        for want in exact:
            got = about[want["station"], want["column"]]
            assert all(got[f] == want[f] for f in ("dtype", "rows", "nulls", "null_ratio"))
            assert got["distinct_values"] == pytest.approx(want["distinct_values"], rel=0.04, abs=1)
    assert profile.profile_of_sketches(profile.distinct_sketches(made.where("false"), ["a"], ["file"])).count() == 0


def test_long_texts_count_by_hash(spark, rows):
    long, twin = "x" * 40, "x" * 39 + "y"
    import hashlib
    values = [long, long, twin, "#" + hashlib.md5(long.encode()).hexdigest(), "", None, None]
    df = spark.createDataFrame([("s", v) for v in values], "station string, a string")
    assert rows(profile.column_profile(df, ["a"]), "rows", "nulls", "distinct_values") == [(7, 2, 5 + 0)]


def test_duplicate_columns_need_equal_types(spark, rows):
    df = spark.createDataFrame([("s", 1, 1.0, 1, 2, None), ("s", 2, 2.0, 2, 1, None)],
                               "station string, a long, b double, c long, d long, e long")
    # d holds the same values in another order.
    assert rows(profile.duplicate_columns(df, list("abcde"))) == [("s", "a", "c")]


def test_duplicate_rows_hot_group(spark, rows):
    df = spark.createDataFrame([("s", "x")] * 5 + [("s", "y"), ("s", None), ("s", None)], "station string, v string")
    assert rows(profile.duplicate_rows(df, ["v"])) == [("s", 8, 5)]


def test_guard_and_status(spark, rows):
    stations = spark.createDataFrame([("none",), ("one",), ("two",), ("six",)], "station string")
    features = spark.createDataFrame([("one", "a"), ("two", "a"), ("two", "b")] + [("six", c) for c in "abcdef"],
                                     "station string, column string")
    guard = clean.feature_guard(features, stations)
    assert rows(guard, "station", "features", "status", "embeddings_skipped") == [
        ("none", 0, "Failed", True), ("one", 1, "Failed", True), ("six", 6, "Success", False),
        ("two", 2, "Success", True)]
    good, bad = clean.split_by_status(guard)
    assert (good.count(), bad.count()) == (2, 2)
    with pytest.raises(RuntimeError, match="2 station"):
        clean.split_by_status(guard, strict=True)


def test_all_values_decide_a_role(spark):
    """Dates in the first hundred rows do not make a time column of text."""
    from colweave.operators import roles as R
    rows = [("s", i, f"2024-01-{i % 28 + 1:02d}" if i < 100 else f"item {i % 50}") for i in range(1000)]
    df = spark.createDataFrame(rows, "station string, row_id long, note string")
    assert [r["role"] for r in R.column_roles(df, ["note"], ["row_id"]).collect()] == [R.CATEGORICAL]
