import json

import numpy as np
import pytest

from colweave import Settings
from colweave.operators import similarity
from colweave.plans import stations
from colweave.plans.stations import export_run, run_folder, save_run


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(0)
    for name, n in (("alpha", 60), ("beta", 40)):
        (root / name).mkdir()
        base = rng.normal(size=n).cumsum()
        lines = ["time,load,heat,noise,twin,fixed,sparse,mode,target"]
        for i in range(n):
            heat = "" if i % 9 == 4 else f"{base[i] * 0.8 + rng.normal() * 0.1:.4f}"
            load = 400.0 if i == 30 else base[i]
            lines.append(f"2026-01-{1 + i // 24:02d} {i % 24:02d}:00:00,{load:.4f},{heat},{rng.normal():.4f},"
                         f"{base[i] * 2:.4f},3.5,{'1.0' if i % 7 == 0 else ''},{'on' if i % 3 else 'off'},{i % 2}.0")
        lines.append(lines[-1])
        (root / name / "readings.csv").write_text("\n".join(lines) + "\n")
    (root / "thin").mkdir()
    (root / "thin" / "t.csv").write_text("time,v\n2026-01-01,1.5\n2026-01-02,2.5\n2026-01-03,9.5\n")
    (root / "void").mkdir()
    (root / "void" / "e.csv").write_text("time,v\n")
    return root


def test_whole_folder(spark, folder, rows, tmp_path):
    runs, failures = run_folder(spark, str(folder), Settings(redundant_correlation_threshold=0.999, top_k_neighbors=1))
    reasons = dict(rows(failures, "station", "reason"))
    assert reasons == {"void": "No file has a row.", "thin": "Insufficient features (1) to build graph."}
    run = next(r for r in runs if "heat" in r.cleaned.columns)
    drops = {(r["station"], r["column"]): r["reason"] for r in run.drops.collect()}
    assert drops[("alpha", "sparse")].startswith("Excessive missingness")
    assert drops[("alpha", "fixed")].startswith("Constant")
    clean = {r["station"]: r for r in run.cleaning.collect()}
    assert clean["alpha"]["dropped_rows"] == 1 and clean["alpha"]["imputation_strategy"] == "interpolate"
    assert run.cleaned.where("heat is null").count() == 0
    roles = {(r["station"], r["column"]): r["role"] for r in run.roles.collect()}
    assert roles[("alpha", "time")] == "Timestamp" and roles[("beta", "mode")] == "Categorical Feature"
    assert roles[("alpha", "target")] == "Target Candidate"
    # The spike in 'load' is clipped, so the column follows its twin again.
    assert ("alpha", "load") in {(r["station"], r["column"]) for r in run.outliers.collect()}
    scaled = run.scaled.where("station = 'beta'").toPandas()
    assert abs(scaled["load"].mean()) < 1e-9 and scaled["load"].std(ddof=0) == pytest.approx(1.0)
    assert set(scaled["target"]) == {0.0, 1.0}
    features = {r["column"] for r in run.features.where("station = 'alpha'").collect()}
    assert {"load", "heat", "noise", "twin"} == features
    types = {(r["station"], r["graph_type"]) for r in run.metrics.collect()}
    assert len(types) == 8
    assert run.centralities.count() == 2 * 4 * 4
    assert run.run_reports.count() == 16
    report = {r["station"]: json.loads(r["v"]) for r in run.report.selectExpr("station", "to_json(struct(*)) v").collect()}
    assert sorted(report) == ["alpha", "beta"]
    assert report["alpha"]["rows"] == 61 and report["alpha"]["duplicate_rows"] == 1
    assert len(report["alpha"]["graph_structures"]) == 4
    assert run.tables["comparison"].count() == 2
    store = save_run(run, str(tmp_path / "out"))
    assert store.read("edges").count() == run.edges.count()
    assert sorted(store.read("cleaned", columns=[c for c in run.cleaned.columns if c not in ("station", "row_id", "_order_ts")]).columns) == sorted(
        c for c in run.cleaned.columns if c not in ("row_id", "_order_ts"))
    export_run(run, str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain" / "edges")).count() == run.edges.count()


def test_forest_and_kept_duplicates(spark, folder):
    cfg = Settings(outlier_method="isolation_forest", drop_duplicates=False, drop_redundant_columns=False,
                   missing_impute_strategy="median", top_k_neighbors=1)
    runs, _ = run_folder(spark, str(folder), cfg)
    run = next(r for r in runs if "heat" in r.cleaned.columns)
    clean = {r["station"]: r for r in run.cleaning.collect()}
    assert clean["alpha"]["dropped_rows"] == 0 and clean["alpha"]["imputation_strategy"] == "median"
    assert run.outliers.count() == 2
    assert run.cleaned.where("station = 'alpha'").count() == 61


def test_interpolation_without_a_time_fails_one_station(spark, rows):
    data = [(s, i, None if s == "bad" and i == 3 else f"2026-01-{i + 1:02d}", None if i == 4 else float(i * i))
            for s in ("bad", "good") for i in range(8)]
    df = spark.createDataFrame(data, "station string, row_id int, seen string, a double")
    found = spark.createDataFrame([(s, *r) for s in ("bad", "good") for r in (("seen", 0, "Timestamp"), ("a", 1, "Numeric Feature"))],
                                  "station string, column string, idx int, role string")
    drops = spark.createDataFrame([], "station string, column string, reason string")
    out, used, failed = stations._impute(df, ["seen", "a"], found, drops, similarity.row_counts(df),
                                         Settings(missing_impute_strategy="interpolate"), 1000)
    assert rows(failed, "station", "status") == [("bad", "Failed")]
    assert rows(used) == [("good", "interpolate")]
    assert rows(out.where("row_id = 4"), "station", "a") == [("good", 17.0)] and out.count() == 8


def test_cosine_ranks_the_top_k_graph(spark):
    rng = np.random.default_rng(2)
    rows = [("s", i, *map(float, r)) for i, r in enumerate(rng.normal(size=(60, 4)))]
    df = spark.createDataFrame(rows, "station string, row_id long, a double, b double, c double, d double")
    run = stations.run_stations(df, list("abcd"), Settings(top_k_similarity="cosine", top_k_neighbors=1, outlier_treatment="none"))
    x = np.array([r[2:] for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    unit = x / np.linalg.norm(x, axis=0)
    cosine = np.abs(unit.T @ unit) - np.eye(4)
    got = {(r["source"], r["target"]): r["weight"] for r in run.edges.where("graph_type = 'top_k'").collect()}
    assert got.keys() == {("abcd"[i], "abcd"[int(cosine[i].argmax())]) for i in range(4)}
    with pytest.raises(ValueError):
        Settings(top_k_similarity="angle")
