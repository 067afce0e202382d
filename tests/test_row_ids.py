"""Row ids of loaded rows: short, in file order, and one number where rows are compared."""
import contextlib
import io

from pyspark.sql import functions as F

from colweave.operators import clean, ordered, profile, quantiles
from colweave.session import materialise
from colweave.sources import discovery


def _plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def _loaded(spark, folder):
    for station in ("b + 5", "a b"):
        (folder / station).mkdir(parents=True)
        for name, shift in (("2 +x.csv", 0), ("1.csv", 3)):
            rows = "".join(f"{(k + shift) % 5},{(k + shift) % 5 / 2}\n" for k in range(40))
            (folder / station / name).write_text("v,w\n" + rows, encoding="utf-8")
    (_, loaded), = discovery.load_stations(spark, str(folder)).tables
    return materialise(loaded)


def test_loaded_rows_carry_no_paths(spark, tmp_path):
    rows = _loaded(spark, tmp_path / "data")
    assert rows.schema["row_id"].dataType.simpleString() == "struct<file:bigint,block:bigint,pos:bigint>"
    # Files in the order of their paths, every row with its own file's station.
    assert [(r["station"], r["file"], r["first"], r["n"]) for r in rows.groupBy("station", "row_id.file").agg(
        F.min_by("v", "row_id.pos").alias("first"), F.count("v").alias("n")).orderBy("file").collect()] == [
            ("a b", 1, 3, 40), ("a b", 2, 0, 40), ("b + 5", 3, 3, 40), ("b + 5", 4, 0, 40)]


def test_numbers_keep_the_order_of_row_ids_and_need_no_sort(spark, tmp_path):
    rows = _loaded(spark, tmp_path / "data")
    both = ordered.numbered(rows).withColumnRenamed("row_id", "number").join(
        rows.select("station", "v", "w", F.col("row_id").alias("id")), ["station", "v", "w"])
    assert both.select("number").distinct().count() == rows.count() == 160
    by_id = [(r["station"], r["v"]) for r in rows.orderBy("row_id").collect()]
    assert by_id == [(r["station"], r["v"]) for r in ordered.numbered(rows).orderBy("row_id").collect()]
    kept = clean.dedupe_rows(ordered.numbered(rows), ["v", "w"])
    assert "SortAggregate" not in _plan(kept)
    whole = clean.dedupe_rows(rows, ["v", "w"])
    assert [tuple(r) for r in kept.orderBy("row_id").select("station", "v", "w").collect()] == [
        tuple(r) for r in whole.orderBy("row_id").select("station", "v", "w").collect()]
    other = spark.createDataFrame([("s", 5), ("s", 3)], "station string, row_id long")
    assert ordered.numbered(other) is other


def test_numbers_over_splits_with_places_that_meet(spark):
    """Splits dealt out of order: a later one may have the smaller places."""
    rows = [("s", (f, b, p + shift), 1.0) for f, b, shift in ((1, 0, 90), (1, 50, 7), (2, 0, 0)) for p in (0, 4, 5)]
    df = spark.createDataFrame(rows, "station string, row_id struct<file:bigint,block:bigint,pos:bigint>, v double")
    got = ordered.numbered(df).join(df.select("v"), "v").select("row_id").distinct().orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == [0, 4, 5, 6, 10, 11, 12, 16, 17]


def test_repetitions_from_rows_told_apart_before(spark, rows):
    df = materialise(spark.createDataFrame(
        [("s", 0.0, None), ("s", -0.0, None), ("s", 1.0, "x"), ("u", 2.0, "y"), ("u", 2.0, "y"), ("t", None, None)],
        "station string, v double, w string"))
    kept = df.groupBy("station", "v", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("station").agg(F.count(F.lit(1)).alias("rows"))
    assert rows(profile.duplicate_rows(df, ["v", "w"], kept)) == rows(profile.duplicate_rows(df, ["v", "w"]))
    assert rows(profile.column_profile(df, ["v", "w"], written=True)) == rows(profile.column_profile(df, ["v", "w"]))
    assert "Expand" not in _plan(profile.column_profile(df, ["v"], written=True))


def test_percentiles_of_not_a_number_and_of_many_rows(spark):
    """Sketches leave NaN out, which sorts last; ranks that then miss are sought anew."""
    df = spark.range(40_000).select(F.lit("s").alias("station"), F.when(F.col("id") % 4 == 0, float("nan")).otherwise(
        (F.col("id") * 7919 % 40_009).cast("double")).alias("v"))
    got = quantiles.exact_percentiles(df, ["v"], [0.0, 0.25, 0.5, 0.9], accuracy=500).first()["v"]
    want = [r["v"] for r in df.orderBy("v").collect()]
    assert got[0] == want[0] and got[1] == (want[9999] + (want[10000] - want[9999]) * 0.75)
    assert got[2] == (want[19999] + want[20000]) / 2 and got[3] != got[3]
