import numpy as np
import pytest
from pyspark.sql import functions as F

from colweave.operators import embed, graphs, iforest, layers, quality, similarity


def _features(spark, x, run="r"):
    return spark.createDataFrame([("s", run, f"n{i}", [float(v) for v in row]) for i, row in enumerate(x)],
                                 "station string, run string, node string, h array<double>")


def _links(spark, adj, run="r"):
    return spark.createDataFrame([("s", run, f"n{i}", f"n{j}", float(adj[i, j])) for i in range(len(adj))
                                  for j in range(len(adj)) if adj[i, j] != 0],
                                 "station string, run string, source string, target string, weight double")


def _matrix(df):
    return np.vstack([r["h"] for r in df.orderBy("node").collect()])


def _attention(x, adj, w, a, b):
    p = x @ np.array(w).T
    logit = (p @ a)[:, None] + (p @ b)[None, :] + np.sign(adj) * np.log1p(np.abs(adj))
    logit = np.where(logit >= 0, logit, 0.2 * logit)
    logit = np.where(np.abs(adj) + np.eye(len(adj)) > 0, logit, -np.inf)
    e = np.exp(logit - logit.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True) @ p


RING = np.array([[0, 1, 0, 0, 1], [1, 0, 1, 0, 0], [0, 1, 0, 1, 0], [0, 0, 1, 0, 1], [1, 0, 0, 1, 0]], dtype=float)


def test_models_on_a_ring(spark):
    rng = np.random.default_rng(0)
    x, w1, w2 = rng.normal(size=(5, 10)), rng.normal(size=(8, 10)), rng.normal(size=(4, 8))
    a = [rng.normal(size=8), rng.normal(size=8), rng.normal(size=4), rng.normal(size=4)]
    steps = [{"weights": w1, "a_src": a[0], "a_dst": a[1]}, {"weights": w2, "a_src": a[2], "a_dst": a[3]}]
    got = _matrix(layers.attention_model(_features(spark, x), _links(spark, RING), steps))
    hidden = _attention(x, RING, w1, a[0], a[1])
    want = _attention(np.where(hidden > 0, hidden, np.exp(np.minimum(hidden, 0)) - 1), RING, w2, a[2], a[3])
    assert got.shape == (5, 4) and np.allclose(got, want)

    v1, v2 = rng.normal(size=(8, 20)), rng.normal(size=(4, 16))
    b1, b2 = rng.normal(size=8), rng.normal(size=4)
    steps = [{"weights": v1, "bias": b1}, {"weights": v2, "bias": b2}]
    got = _matrix(layers.sampled_model(_features(spark, x), _links(spark, RING), steps, 10))
    deg = np.maximum(np.abs(RING).sum(axis=1, keepdims=True), 1)
    h = np.maximum(np.hstack([x, RING @ x / deg]) @ v1.T + b1, 0)
    assert np.allclose(got, np.hstack([h, RING @ h / deg]) @ v2.T + b2)


def test_sign_changes_attention(spark):
    rng = np.random.default_rng(42)
    x, w = rng.normal(size=(3, 4)), rng.normal(size=(2, 4))
    path = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], dtype=float)
    out = [_matrix(layers.attention_layer(_features(spark, x), _links(spark, s * path), w, [1, 0.5], [0.3, 1], 2))
           for s in (1, -1)]
    assert not np.allclose(*out)


def test_lonely_nodes_and_max(spark):
    x = np.array([[1.0, -2.0], [3.0, 4.0], [5.0, 6.0]])
    adj = np.array([[0, -0.5, 0.2], [0, 0, 0], [0, 0, 0]])
    got = _matrix(layers.sampled_layer(_features(spark, x), _links(spark, adj), None, None, 2, "max"))
    assert np.allclose(got, [[1, -2, 1.0, 1.2], [3, 4, 0, 0], [5, 6, 0, 0]])
    got = _matrix(layers.attention_layer(_features(spark, x), _links(spark, adj), None, [0, 0], [0, 0], 2))
    assert np.allclose(got[1:], x[1:])
    with pytest.raises(ValueError, match="Unknown aggregator"):
        layers.sampled_layer(_features(spark, x), _links(spark, adj), None, None, 2, "sum")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([("s", i, *map(float, r)) for i, r in enumerate(x)],
                               "station string, row_id long, " + ", ".join(f"{c} double" for c in cols)).cache()
    return x, cols, df


def _own(spark, cols):
    return spark.createDataFrame([("s", c, i) for i, c in enumerate(cols)], "station string, column string, idx int")


def test_node_features_are_principal_scores(spark, table):
    x, cols, df = table
    out = embed.node_features(similarity.gram_matrix(df, cols), _own(spark, cols), similarity.row_counts(df), cols)
    got = np.vstack([r["h"] for r in out.orderBy("node").collect()])
    raw = x.T - x.T.mean(axis=0)
    u, s, _ = np.linalg.svd(raw, full_matrices=False)
    assert got.shape == (6, 5)
    assert np.allclose(np.abs(got), np.abs(u[:, :5] * s[:5]), atol=1e-8)


def test_embedding_runs(spark, table):
    x, cols, df = table
    pairs = similarity.pearson_pairs(df, cols)
    edges = graphs.weighted_graph(pairs).unionByName(graphs.top_k_graph(pairs, 2))
    features = embed.node_features(similarity.gram_matrix(df, cols), _own(spark, cols), similarity.row_counts(df), cols)
    runs = embed.embedding_runs(features, edges, embed.feature_width(cols)).cache()
    reports = {r["run"]: r for r in embed.run_reports(runs).collect()}
    assert sorted(reports) == ["top_k_GAT", "top_k_GraphSAGE", "weighted_GAT", "weighted_GraphSAGE"]
    assert all(r["validation"] == "Stable" and r["final_loss"] >= 0 for r in reports.values())
    assert reports["top_k_GAT"]["graph_type"] == "top_k" and reports["top_k_GAT"]["model_name"] == "GAT"
    # Six nodes are fewer than eight dimensions.
    assert {len(r["embedding"]) for r in runs.collect()} == {5}
    two = features.where("node in ('c0', 'c1')")
    assert embed.embedding_runs(two, edges, 5).count() == 0


def test_health_and_quality(spark):
    rows = [("s", "flat", f"n{i}", [1.0, 2.0]) for i in range(3)]
    rows += [("s", "broken", "n0", [float("nan"), 1.0]), ("s", "broken", "n1", [2.0, float("inf")])]
    rows += [("s", "fine", "n0", [0.0, 0.0]), ("s", "fine", "n1", [3.0, 4.0]), ("s", "fine", "n2", [0.0, 4.0])]
    rows += [("s", "lone", "n0", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "station string, run string, node string, embedding array<double>")
    health = {r["run"]: r["validation"] for r in quality.embedding_health(df).collect()}
    assert health["flat"] == "Collapsed (Zero Variance)" and health["broken"] == "NaNs present (cleared)"
    assert health["fine"] == "Stable"
    assert quality.clear_not_finite(df).where("run = 'broken' and node = 'n1'").first()["embedding"] == [2.0, 0.0]
    got = {r["run"]: r for r in quality.embedding_quality(df.where("run <> 'broken'")).collect()}
    assert "lone" not in got
    fine, dist = got["fine"], np.array([5.0, 4.0, 3.0])
    assert fine["avg_pairwise_distance"] == pytest.approx(dist.mean())
    assert fine["std_pairwise_distance"] == pytest.approx(dist.std())
    assert fine["dimension_variance"] == pytest.approx((np.var([0, 3, 0]) + np.var([0, 4, 4])) / 2)
    assert fine["sparsity"] == pytest.approx(3 / 6)


@pytest.mark.parametrize("block", [1024, 7])
def test_distance_spread_by_tiles(spark, block):
    """All pairs of a run, whatever its blocks; equal distances spread by nothing; NULLs and other sizes stay out."""
    x = np.random.default_rng(6).normal(size=(60, 5)) + 1e3
    made = [("s", "many", f"n{i}", list(map(float, v))) for i, v in enumerate(x)]
    made += [("s", "many", "gap", [1.0, None, 2.0, 3.0, 4.0]), ("s", "many", "none", None), ("s", "many", "short", [1.0])]
    made += [("s", "two", "a", [0.0]), ("s", "two", "b", [0.1]), ("s", "one", "a", [0.0])]
    made += [("s", "same", f"n{i}", [1.0, 2.0]) for i in range(30)] + [("s", "empty", "a", []), ("s", "empty", "b", [])]
    made += [("s", "nan", "a", [float("nan")]), ("s", "nan", "b", [1.0])]
    df = spark.createDataFrame(made, "station string, run string, node string, embedding array<double>")
    got = {r["run"]: r for r in quality.distance_spread(df, block).collect()}
    assert sorted(got) == ["empty", "many", "nan", "same", "two"]
    dist = np.array([np.linalg.norm(a - b) for i, a in enumerate(x) for b in x[i + 1:]])
    assert got["many"]["avg_pairwise_distance"] == pytest.approx(dist.mean(), rel=1e-12)
    assert got["many"]["std_pairwise_distance"] == pytest.approx(dist.std(), rel=1e-9)
    assert got["two"]["avg_pairwise_distance"] == 0.1 and got["two"]["std_pairwise_distance"] == 0.0
    assert got["same"]["avg_pairwise_distance"] == 0.0 and got["same"]["std_pairwise_distance"] == 0.0
    assert got["empty"]["avg_pairwise_distance"] == 0.0
    assert np.isnan(got["nan"]["avg_pairwise_distance"])


def test_projection(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(7, 4))
    df = spark.createDataFrame([("s", "r", f"n{i}", list(map(float, r))) for i, r in enumerate(x)]
                               + [("s", "thin", f"n{i}", [float(i)]) for i in range(3)],
                               "station string, run string, node string, embedding array<double>")
    out = quality.project_2d(df).toPandas()
    got = out[out.run == "r"].sort_values("node")[["x", "y"]].to_numpy()
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
    assert np.allclose(out[out.run == "thin"]["y"], 0.0)


def test_isolation_forest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    x[:6] = [[9, 9], [-9, 9], [9, -9], [-9, -9], [0, 12], [12, 0]]
    df = spark.createDataFrame([("s", i, *map(float, r)) for i, r in enumerate(x)]
                               + [("t", i, float(i), 1.0) for i in range(40)],
                               "station string, row_id long, a double, b double").cache()
    forest = iforest.grow_forest(df, ["a", "b"])
    scores = iforest.anomaly_scores(df, ["a", "b"], forest).toPandas().sort_values(["station", "row_id"])
    s = scores[scores.station == "s"]["score"].to_numpy()
    assert set(np.argsort(-s)[:6]) == set(range(6)) and (s[:6] > 0.5).all()
    assert np.median(s) < 0.5
    by_key = iforest.anomaly_scores(df, ["a", "b"], forest, broadcast_nodes=0).toPandas().sort_values(["station", "row_id"])
    assert np.allclose(scores["score"], by_key["score"])
    treated, found = iforest.treat_by_forest(df, ["a", "b"], "clip")
    top = np.percentile(x[:, 0], 99)
    got = treated.where("station = 's' and row_id = 0").first()
    assert got["a"] == pytest.approx(top)
    calm = int(np.argmin(s))
    assert treated.where(f"station = 's' and row_id = {calm}").first()["a"] == x[calm, 0]
    assert found.where("station = 's'").first()["outliers"] == int((s > 0.5).sum())


def test_forest_of_rows_without_station(spark):
    rng = np.random.default_rng(8)
    rows = [(None if i % 4 == 0 else "s", i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    rows[0] = (None, 0, 40.0, 40.0)
    df = spark.createDataFrame(rows, "station string, row_id long, a double, b double")
    for nodes in (10 ** 6, 0):
        scored = iforest.with_scores(df, ["a", "b"], iforest.grow_forest(df, ["a", "b"]), nodes).toPandas()
        assert len(scored) == 400 and (scored["_score"] > 0).all()
        assert scored.set_index("row_id")["_score"].idxmax() == 0
        treated, found = iforest.treat_by_forest(df, ["a", "b"], "clip", broadcast_nodes=nodes)
        assert treated.count() == 400 and found.count() == 2
        assert treated.where("row_id = 0").first()["a"] < 40.0
