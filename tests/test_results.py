import pytest

from colweave.sources import results
from colweave.sources.results import ResultStore


def tables(spark, rows, columns):
    df = spark.createDataFrame(rows, "station string, " + ", ".join(f"{c} double" for c in columns))
    return columns, {"cleaned": df, "comparison": df.groupBy("station").count().withColumnRenamed("count", "raw_rows")}


def test_column_sets_of_a_run_read_as_one(spark, tmp_path, rows):
    store = ResultStore(spark, str(tmp_path / "out"))
    with pytest.raises(KeyError):
        store.read("comparison")
    one = tables(spark, [("a", 1.0, 2.0), ("b", 3.0, 4.0)], ["x", "y"])
    two = tables(spark, [("c d/e", 5.0), ("c d/e", 6.0), (None, 7.0)], ["z"])
    store.save("first", [one, two], {"failures": spark.createDataFrame([("f", "why")], "station string, reason string")})
    assert rows(store.read("comparison"), "station", "raw_rows") == [("a", 1), ("b", 1), ("c d/e", 2), (None, 1)]
    wide = store.read("cleaned")
    assert sorted(wide.columns) == ["station", "x", "y", "z"] and wide.where("z IS NOT NULL").count() == 3
    assert rows(store.read("cleaned", columns=["y", "x"]), "station", "x") == [("a", 1.0), ("b", 3.0)]
    assert rows(store.read("failures"), "station", "reason") == [("f", "why")]


def test_a_save_replaces_nothing(spark, tmp_path, rows):
    store = ResultStore(spark, str(tmp_path / "out"))
    first = store.save("one", [tables(spark, [("a", 1.0)], ["x"])])
    store.save("two", [tables(spark, [("b", 2.0)], ["x"])])
    assert rows(store.read("cleaned", "one"), "station", "x") == [("a", 1.0)]
    assert rows(store.read("cleaned"), "station", "x") == [("b", 2.0)]  # the run saved last
    again = store.save("one", [tables(spark, [("a", 9.0)], ["x"])])
    assert rows(store.read("cleaned", "one"), "x") == [(9.0,)] and first != again
    assert {r["save"] for r in store.manifest().collect()} > {first, again}
    assert rows(store.runs(), "run") == [("one",), ("two",)]


def test_an_unpublished_save_is_not_seen(spark, tmp_path, rows):
    """Tables without a manifest file, as a job that died leaves them, change nothing."""
    store = ResultStore(spark, str(tmp_path / "out"))
    store.save("one", [tables(spark, [("a", 1.0)], ["x"])])
    broken = ["x"], {"cleaned": spark.createDataFrame([("b", 0.0)], "station string, x double"),
                     "comparison": spark.range(3).selectExpr("raise_error('lost') AS station", "id AS raw_rows")}
    with pytest.raises(Exception):
        store.save("one", [broken])
    assert rows(store.read("cleaned"), "station", "x") == [("a", 1.0)]
    assert rows(store.read("comparison"), "station") == [("a",)]


def test_names_as_folders():
    assert results.plain_name("station_1.a-b") == "station_1.a-b"
    names = ["a b", "a/b", "a_b", "..", "", "é", "_x", "a:b"]
    plain = [results.plain_name(n) for n in names]
    assert len(set(plain)) == len(names)
    assert all(set(p) <= set("abcdefghijklmnopqrstuvwxyz0123456789_.-") and not p.startswith(("_", ".")) for p in plain)
    assert results.column_set(["b", "a"]) == results.column_set(["a", "b"]) != results.column_set(["ab"])
