"""Independent parts of a run wait for each other no longer."""
import threading

import pytest

from colweave.session import side_by_side
from colweave.sources.results import ResultStore


def test_calls_run_together_in_order_of_their_results(spark):
    meet = threading.Barrier(3, timeout=60)
    assert side_by_side([lambda k=k: (meet.wait(), k)[1] for k in range(3)]) == [0, 1, 2]
    assert side_by_side([]) == [] and side_by_side([lambda: 7]) == [7]
    spark.sparkContext.setLocalProperty("colweave.test", "kept")
    try:
        assert side_by_side([lambda: spark.sparkContext.getLocalProperty("colweave.test")] * 2) == ["kept"] * 2
    finally:
        spark.sparkContext.setLocalProperty("colweave.test", None)


def test_the_first_error_is_raised(spark):
    def fail(text):
        raise ValueError(text)
    with pytest.raises(ValueError, match="first"):
        side_by_side([lambda: 1, lambda: fail("first"), lambda: fail("second")])


def test_tables_are_saved_together_and_shown_only_when_whole(spark, tmp_path, monkeypatch, rows):
    import colweave.sources.results as results
    sizes = []
    monkeypatch.setattr(results, "side_by_side", lambda calls: (sizes.append(len(calls)), side_by_side(calls))[1])
    store = ResultStore(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("s", 1), ("t", 2)], "station string, v int")
    store.save("a", [(["v"], {"x": one, "y": one})], {"z": one})
    assert sizes == [3] and rows(store.read("z", "a"), "station", "v") == [("s", 1), ("t", 2)]
    bad = spark.sql("SELECT 's' AS station, raise_error('no') AS v")
    with pytest.raises(Exception, match="no"):
        store.save("b", [(["v"], {"x": one, "y": bad})])
    assert [r["run"] for r in store.runs().collect()] == ["a"]
