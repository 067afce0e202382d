import numpy as np
import pytest

from colweave.operators import centrality, graphs, learned, metrics, paths, similarity
from colweave.session import materialise

FEATS = ["feat1", "feat2", "feat3", "feat4"]


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.RandomState(42)
    x1 = rng.randn(100)
    return np.column_stack([x1, x1 * 0.9 + rng.randn(100) * 0.1, x1 * -0.8 + rng.randn(100) * 0.2, rng.randn(100)])


@pytest.fixture(scope="module")
def dummy(spark, matrix):
    return spark.createDataFrame([("s", *map(float, r)) for r in matrix], "station string, " + ", ".join(
        f"{c} double" for c in FEATS)).cache()


@pytest.mark.parametrize("wide_limit", [12, 0])
def test_pairs_match_numpy(dummy, matrix, wide_limit):
    want = np.corrcoef(matrix.T)
    for r in similarity.pearson_pairs(dummy, FEATS, wide_limit=wide_limit).collect():
        assert r["r"] == pytest.approx(want[r["i"], r["j"]], abs=1e-12)
    gram = matrix.T @ matrix
    for r in similarity.gram_matrix(dummy, FEATS, wide_limit).collect():
        assert r["g"] == pytest.approx(gram[r["i"], r["j"]], abs=1e-9)
    norm = np.sqrt(np.diag(gram))
    for r in similarity.cosine_pairs(dummy, FEATS, wide_limit).collect():
        assert r["r"] == pytest.approx((gram / np.outer(norm, norm))[r["i"], r["j"]], abs=1e-12)


def test_tiles_of_pairs_match_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 23)) + 1e3
    x[rng.random(x.shape) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(23)]
    df = spark.createDataFrame([("s" if k % 3 else None, *map(float, r)) for k, r in enumerate(x)],
                               "station string, " + ", ".join(f"{c} double" for c in cols))
    for station, rows in ((None, x[::3]), ("s", x[np.arange(90) % 3 > 0])):
        for centred in (False, True):
            sums = similarity.pair_sums(df, cols, centred, tile=5).where(
                "station IS NULL" if station is None else "station = 's'")
            got = {(r["i"], r["j"]): r for r in similarity.pairs_from_sums(sums, cols).collect()}
            assert sorted(got) == [(i, j) for i in range(23) for j in range(i + 1, 23)]
            for (i, j), r in got.items():
                both = ~np.isnan(rows[:, i]) & ~np.isnan(rows[:, j])
                want = np.corrcoef(rows[both, i], rows[both, j])[0, 1]
                assert r["r"] == pytest.approx(want, abs=1e-9 if not centred else 1e-4)


@pytest.mark.parametrize("wide_limit", [12, 0])
def test_undefined_pairs_are_zero(spark, wide_limit):
    df = spark.createDataFrame([("s", 1.0, 7.0, 1e9 + 1, None), ("s", 2.0, 7.0, 1e9 + 2, None), ("s", 4.0, 7.0, 1e9 + 4, 1.0)],
                               "station string, a double, fixed double, far double, lone double")
    got = {(r["source"], r["target"]): r["r"]
           for r in similarity.pearson_pairs(df, ["a", "fixed", "far", "lone"], wide_limit=wide_limit).collect()}
    assert got[("a", "far")] == pytest.approx(1.0)
    assert all(v == 0.0 for k, v in got.items() if k != ("a", "far"))


def test_correlation_graph(dummy):
    edges = graphs.correlation_graph(similarity.pearson_pairs(dummy, FEATS), 0.7)
    found = {(r["source"], r["target"]) for r in edges.collect()}
    assert {("feat1", "feat2"), ("feat1", "feat3")} <= found
    assert not any("feat4" in pair for pair in found)
    assert graphs.feature_nodes(dummy, FEATS, ("correlation",)).count() == 4


def test_top_k_graph(dummy, rows):
    edges = graphs.top_k_graph(similarity.pearson_pairs(dummy, FEATS), 2)
    assert rows(edges.groupBy("source").count(), "count") == [(2,)] * 4
    assert edges.where("source = target").count() == 0
    # More neighbours than there are nodes.
    assert graphs.top_k_graph(similarity.pearson_pairs(dummy, FEATS), 9).count() == 12


def test_top_k_ties(spark):
    pairs = spark.createDataFrame([("s", 0, 1, "a", "b", 0.5), ("s", 0, 2, "a", "c", -0.5), ("s", 1, 2, "b", "c", 0.0)],
                                  "station string, i int, j int, source string, target string, r double")
    got = {(r["source"], r["target"]) for r in graphs.top_k_graph(pairs, 1).collect()}
    assert got == {("a", "c"), ("b", "a"), ("c", "a")}


def test_weighted_graph(dummy):
    assert graphs.weighted_graph(similarity.pearson_pairs(dummy, FEATS)).count() == 6


def _descend_on_rows(x, epochs, lr, decay, l1):
    """The same loss on the rows themselves, differentiated numerically over free entries."""
    n = x.shape[1]
    corr = np.corrcoef(x.T) * (1 - np.eye(n))
    raw = np.arctanh(np.clip(corr, -1 + 1e-4, 1 - 1e-4))

    def loss(raw):
        a = np.tanh((raw + raw.T) / 2) * (1 - np.eye(n))
        return np.mean((x @ a - x) ** 2) + l1 * np.abs(a).sum()

    best, best_loss = None, np.inf
    m, v = np.zeros_like(raw), np.zeros_like(raw)
    for t in range(1, epochs + 1):
        now = loss(raw)
        if now < best_loss:
            best_loss, best = now, np.tanh((raw + raw.T) / 2) * (1 - np.eye(n))
        grad = np.zeros_like(raw)
        for i in range(n):
            for j in range(n):
                step = np.zeros_like(raw)
                step[i, j] = 1e-6
                grad[i, j] = (loss(raw + step) - loss(raw - step)) / 2e-6
        grad += decay * raw
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        raw = raw - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return best


def test_learned_graph(dummy, matrix):
    args = dict(epochs=30, lr=0.05, weight_decay=1e-4, l1_penalty=0.005)
    edges = learned.learned_graph(similarity.gram_matrix(dummy, FEATS), similarity.pearson_pairs(dummy, FEATS),
                                  similarity.row_counts(dummy), FEATS, **args).collect()
    want = _descend_on_rows(matrix, 30, 0.05, 1e-4, 0.005)
    got = np.zeros((4, 4))
    for r in edges:
        got[FEATS.index(r["source"]), FEATS.index(r["target"])] = r["weight"]
        assert r["source"] < r["target"] and abs(r["weight"]) <= 1.0
    upper = np.triu(np.where(np.abs(want) >= 0.05, want, 0.0), 1)
    assert np.allclose(got, upper, atol=1e-4)


def test_adjacency_views(dummy, rows):
    pairs = similarity.pearson_pairs(dummy, FEATS)
    nodes = graphs.feature_nodes(dummy, FEATS, ("weighted",))
    cells = graphs.adjacency_cells(nodes, graphs.weighted_graph(pairs))
    grid = np.zeros((4, 4))
    for r in cells.collect():
        grid[r["source_idx"], r["target_idx"]] = r["weight"]
    assert np.allclose(grid, grid.T) and np.allclose(np.diag(grid), 0.0)
    wide = graphs.adjacency_matrix(nodes, graphs.weighted_graph(pairs), FEATS).orderBy("idx").toPandas()[FEATS]
    assert np.allclose(wide.to_numpy(), grid)
    assert cells.transform(graphs.binarised).where("linked = 1").count() == 12
    signs = graphs.edge_features(graphs.weighted_graph(pairs)).where("source = 'feat1' and target = 'feat3'").first()
    assert signs["sign"] == "negative" and signs["abs_weight"] == -signs["weight"]


# Hand-made graphs: (graph_type, directed, node count, edges as (source, target, weight)).
SHAPES = {
    "path": ("weighted", False, 5, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)]),
    "split": ("weighted", False, 6, [(0, 1, 0.5), (2, 3, 0.5), (3, 4, -0.5), (2, 4, 0.5)]),
    "ring": ("top_k", True, 4, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0)]),
    "oneway": ("top_k", True, 3, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (1, 0, 1.0)]),
    "alone": ("weighted", False, 1, []),
    "loose": ("weighted", False, 3, []),
}


@pytest.fixture(scope="module")
def shapes(spark):
    nodes = [(s, t, f"n{i}", i) for s, (t, _, n, _) in SHAPES.items() for i in range(n)]
    edges = [(s, t, f"n{a}", f"n{b}", w, d) for s, (t, d, _, es) in SHAPES.items() for a, b, w in es]
    return (spark.createDataFrame(nodes, "station string, graph_type string, node string, idx int").cache(),
            spark.createDataFrame(edges, "station string, graph_type string, source string, target string, "
                                         "weight double, directed boolean").cache())


@pytest.mark.parametrize("row_nodes", [200, 0])
def test_metrics(shapes, row_nodes):
    got = {r["station"]: r for r in metrics.graph_metrics(*shapes, row_nodes).collect()}
    names = ("node_count", "edge_count", "density", "avg_degree", "connected_components", "isolated_nodes",
             "clustering_coefficient", "diameter", "radius")
    want = {
        "path": (5, 4, 0.4, 1.6, 1, 0, 0.0, 4.0, 2.0),
        "split": (6, 4, 4 / 15, 4 / 3, 3, 1, 0.5, 1.0, 1.0),
        "ring": (4, 4, 1 / 3, 2.0, 1, 0, 0.0, 3.0, 3.0),
        # One pair is linked both ways: 2/4, 2/4 and 2/2 directed triangles.
        "oneway": (3, 4, 4 / 6, 8 / 3, 1, 0, (2 / 4 + 2 / 4 + 2 / 2) / 3, 1.0, 1.0),
        "alone": (1, 0, 0.0, 0.0, 1, 1, 0.0, -1.0, -1.0),
        "loose": (3, 0, 0.0, 0.0, 3, 3, 0.0, -1.0, -1.0),
    }
    for name, values in want.items():
        assert [got[name][k] for k in names] == pytest.approx(list(values)), name
    assert got["ring"]["warnings"] == ["Small Graph Warning: Graph contains only 4 nodes."]
    assert got["oneway"]["warnings"][0].startswith("Disconnected Graph: Diameter")
    assert got["loose"]["warnings"][1] == "Degenerate Graph: No edges exist."
    assert len(got["loose"]["warnings"]) == 5


@pytest.mark.parametrize("row_nodes", [200, 0])
def test_components(shapes, row_nodes):
    nodes, edges = shapes
    got = paths.components(nodes, paths.links(nodes, edges), row_nodes).where("station = 'split'").orderBy("idx").collect()
    assert [r["label"] for r in got] == [0, 0, 2, 2, 2, 5]


def _lengths(n, edges, directed):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0.0)
    for a, b, w in edges:
        d[a, b] = min(d[a, b], 1 / (abs(w) + 1e-6))
        if not directed:
            d[b, a] = min(d[b, a], 1 / (abs(w) + 1e-6))
    link = d.copy()
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    return link, d


def _by_hand(n, edges, directed):
    link, d = _lengths(n, edges, directed)
    close, between = np.zeros(n), np.zeros(n)

    def walks(s, t):
        if s == t:
            return [[s]]
        return [[s, *rest] for u in range(n) if u != s and np.isfinite(link[s, u])
                and abs(link[s, u] + d[u, t] - d[s, t]) < 1e-9 for rest in walks(u, t)]

    for t in range(n):
        reach = [s for s in range(n) if s != t and np.isfinite(d[s, t])]
        if reach:
            close[t] = len(reach) / sum(d[s, t] for s in reach) * len(reach) / (n - 1)
    for s in range(n):
        for t in range(n):
            if s != t and np.isfinite(d[s, t]):
                ways = walks(s, t)
                for way in ways:
                    for v in way[1:-1]:
                        between[v] += 1 / len(ways)
    return close, between / ((n - 1) * (n - 2)) if n > 2 else between


def _power(n, edges, directed):
    a = np.zeros((n, n))
    for s, t, w in edges:
        a[s, t] = abs(w)
        if not directed:
            a[t, s] = abs(w)
    x = np.full(n, 1 / n)
    for _ in range(1000):
        y = x + a.T @ x
        y = y / (np.linalg.norm(y) or 1)
        done = np.abs(y - x).sum() < n * 1e-5
        x = y
        if done:
            break
    out = a.sum(axis=1)
    p = np.full(n, 1 / n)
    for _ in range(1000):
        y = 0.85 * ((a / np.where(out == 0, 1, out)[:, None]).T @ p + p[out == 0].sum() / n) + 0.15 / n
        done = np.abs(y - p).sum() < n * 1e-5
        p = y
        if done:
            break
    return x, p


@pytest.fixture(scope="module")
def random_graphs(spark):
    rng = np.random.default_rng(5)
    found = {}
    for name, n, directed, share in (("dense", 7, False, 0.7), ("sparse", 9, False, 0.25), ("arcs", 8, True, 0.3)):
        edges = [(a, b, float(np.round(rng.uniform(-1, 1), 1)) or 0.5) for a in range(n) for b in range(n)
                 if (a != b if directed else a < b) and rng.random() < share]
        found[name] = ("top_k" if directed else "weighted", directed, n, edges)
    nodes = [(s, t, f"n{i}", i) for s, (t, _, n, _) in found.items() for i in range(n)]
    edges = [(s, t, f"n{a}", f"n{b}", w, d) for s, (t, d, _, es) in found.items() for a, b, w in es]
    return found, spark.createDataFrame(nodes, "station string, graph_type string, node string, idx int").cache(), \
        spark.createDataFrame(edges, "station string, graph_type string, source string, target string, weight double, "
                                     "directed boolean").cache()


@pytest.mark.parametrize("block", [512, 3])
def test_centralities(random_graphs, block):
    found, nodes, edges = random_graphs
    got = centrality.centralities(nodes, edges, block).toPandas()
    for name, (_, directed, n, es) in found.items():
        part = got[got.station == name].sort_values("idx")
        close, between = _by_hand(n, es, directed)
        eigen, rank = _power(n, es, directed)
        degree = np.bincount([v for a, b, _ in es for v in (a, b)], minlength=n) / (n - 1)
        for column, want in (("degree_centrality", degree), ("closeness_centrality", close),
                             ("betweenness_centrality", between), ("eigenvector_centrality", eigen), ("pagerank", rank)):
            assert np.allclose(part[column], want, atol=1e-9), (name, column)


def test_path_sums_of_ties_and_long_rings(spark, rows):
    """A square has two equally short ways, a far node none, a ring many hops; forms by pairs agree."""
    square = [("s", a, b, d) for x, y, d in ((0, 1, 0.1), (1, 3, 0.2), (0, 2, 0.2), (2, 3, 0.1 + 1e-17))
              for a, b in ((x, y), (y, x))]
    ring = [("r", a, b, 1.0) for i in range(400) for a, b in ((i, (i + 1) % 400), ((i + 1) % 400, i))]
    ordered = spark.createDataFrame([(s, "weighted", a, b, d) for s, a, b, d in square + ring],
                                    "station string, graph_type string, s int, t int, distance double")
    nodes = spark.createDataFrame([(s, "weighted", f"n{i}", i) for s, n in (("s", 5), ("r", 400)) for i in range(n)],
                                  "station string, graph_type string, node string, idx int")
    sums = materialise(paths.path_sums(nodes, ordered, 60))
    assert rows(sums.where("station = 's'"), "idx", "flow", "others") == [(i, 1.0, 3) for i in range(4)]
    # From each source one node lies opposite and halves its two ways: 199 * 198 + 199 shares a node.
    got = sums.where("station = 'r'").toPandas()
    assert len(got) == 400 and np.allclose(got["flow"], 199 * 198 + 199)
    assert np.allclose(got["total"], 2 * sum(range(1, 200)) + 200)
    few = nodes.where("station = 's'")
    pairs = centrality.length_sums(paths.shortest_lengths(few, ordered.where("station = 's'")))
    assert rows(pairs, "idx", "total", "others") == rows(sums.where("station = 's'"), "idx", "total", "others")
    assert paths.path_sums(nodes, ordered.where("false")).count() == 0


def test_power_iterations_by_joins(random_graphs):
    found, nodes, edges = random_graphs
    keep = "station = 'arcs'"
    ordered = centrality.with_distance(paths.links(nodes.where(keep), edges.where(keep)))
    for run, name in ((centrality.eigenvector, "eigenvector_centrality"), (centrality.pagerank, "pagerank")):
        rows = run(nodes.where(keep), ordered).orderBy("idx").toPandas()[name]
        joins = run(nodes.where(keep), ordered, row_links=0).orderBy("idx").toPandas()[name]
        assert np.allclose(rows, joins, atol=1e-12)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_both_forms_agree_on_missing(spark, rows, offset):
    nan = float("nan")
    values = [(1.0, 2.0, 5.0), (2.0, nan, 1.0), (3.0, 7.0, None), (4.0, 6.0, 2.0), (nan, 1.0, 8.0), (6.0, 9.0, 4.0)]
    df = spark.createDataFrame([(s, *[v if v is None else v + offset for v in r]) for s in ("s", None) for r in values],
                               "station string, a double, b double, c double")
    cols = ["a", "b", "c"]
    for find, name in ((similarity.pearson_pairs, "r"), (similarity.gram_matrix, "g"), (similarity.cosine_pairs, "r")):
        got = {limit: {(r["station"], r["i"], r["j"]): r[name] for r in find(df, cols, wide_limit=limit).collect()}
               for limit in (12, 0)}
        assert got[12].keys() == got[0].keys() and {k[0] for k in got[0]} == {"s", None}
        assert all(v == v for v in got[12].values())
        if find is similarity.pearson_pairs or offset == 0.0:
            assert got[0] == pytest.approx(got[12], abs=1e-9)
    both = [(r[0], r[1]) for r in values if r[0] == r[0] and r[1] == r[1]]
    want = np.corrcoef(np.array(both).T)[0, 1]
    found = {(r["station"], r["i"], r["j"]): r["r"] for r in similarity.pearson_pairs(df, cols, wide_limit=0).collect()}
    assert found[(None, 0, 1)] == pytest.approx(want, abs=1e-9)


def _graph(spark, name, n, links, directed=False):
    nodes = spark.createDataFrame([("s", name, f"n{i}", i) for i in range(n)], "station string, graph_type string, node string, idx int")
    edges = spark.createDataFrame([("s", name, f"n{a}", f"n{b}", 1.0, directed) for a, b in links],
                                  "station string, graph_type string, source string, target string, weight double, directed boolean")
    return nodes, edges


def _clustering_by_hand(n, links, directed):
    out = np.zeros((n, n), dtype=int)
    for a, b in links:
        out[a, b] = 1
        if not directed:
            out[b, a] = 1
    np.fill_diagonal(out, 0)
    if directed:
        both = out + out.T
        total, mutual = both.sum(axis=1), (out * out.T).sum(axis=1)
        found = np.diag(np.linalg.matrix_power(both, 3)) / 2
        room = total * (total - 1) - 2 * mutual
    else:
        total = out.sum(axis=1)
        found, room = np.diag(np.linalg.matrix_power(out, 3)), total * (total - 1)
    return float(np.mean(np.where(room > 0, found / np.maximum(room, 1), 0.0)))


@pytest.mark.parametrize("directed", [False, True])
def test_triangles_of_hubs_and_complete_graphs(spark, directed):
    rng = np.random.default_rng(3)
    hub = [(0, i) for i in range(1, 40)] + [tuple(map(int, p)) for p in rng.integers(1, 40, (60, 2)) if p[0] != p[1]]
    every = [(a, b) for a in range(7) for b in range(7) if (a != b if directed else a < b)]
    one_way = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    if not directed:
        hub = sorted({(min(p), max(p)) for p in hub})
    for n, links in ((40, sorted(set(hub))), (7, every), (6, one_way), (2, [(0, 1)]), (3, [])):
        nodes, edges = _graph(spark, "g", n, links, directed)
        got = metrics.clustering(nodes, paths.links(nodes, edges)).first()["clustering_coefficient"]
        assert got == pytest.approx(_clustering_by_hand(n, links, directed), abs=1e-12), (n, directed)


def test_sweeps_agree_with_lengths_in_a_row(spark):
    rng = np.random.default_rng(6)
    for directed in (False, True):
        for n, m in ((60, 70), (60, 400), (5, 20), (30, 0)):
            links = sorted({tuple(map(int, p)) for p in rng.integers(0, n, (m, 2)) if p[0] != p[1]})
            nodes, edges = _graph(spark, "g", n, links, directed)
            near = paths.two_way(paths.links(nodes, edges)) if not directed else paths.links(nodes, edges)
            keys = ["station", "graph_type"]
            rows = [sorted(tuple(r) for r in paths.reaches(nodes, near, keys, limit, block=7).select("idx", "far", "reached", "least").collect())
                    for limit in (200, 0)]
            assert rows[0] == rows[1] and len(rows[0]) == n


def test_extent_of_large_graphs(spark):
    """A ring and a random graph of thousands of nodes, without a row per pair."""
    n = 5000
    ring = [(i, (i + 1) % n) for i in range(n)]
    nodes, edges = _graph(spark, "g", n, ring)
    found = metrics.extent(nodes, paths.links(nodes, edges), metrics.basic_counts(nodes, paths.links(nodes, edges))).first()
    assert (found["diameter"], found["radius"], found["connected_components"], found["partial"]) == (2500.0, 2500.0, 1, False)
    rng = np.random.default_rng(1)
    links = sorted({(min(p), max(p)) for p in map(tuple, rng.integers(0, n, (20_000, 2)).tolist()) if p[0] != p[1]})
    nodes, edges = _graph(spark, "g", n, links)
    found = metrics.extent(nodes, paths.links(nodes, edges), metrics.basic_counts(nodes, paths.links(nodes, edges))).first()
    near = [[] for _ in range(n)]
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    far, labels = [], {}
    for start in range(n):
        seen, front, hops = {start}, [start], 0
        while front:
            front = [v for v in {w for u in front for w in near[u]} if v not in seen]
            seen.update(front)
            hops += bool(front)
        labels.setdefault(min(seen), []).append(hops)
        if start >= 40 and min(seen) == 0:  # a sample is enough for the bounds below
            break
    main = labels[0]
    assert max(main) <= found["diameter"] and found["radius"] <= min(main)
    assert found["diameter"] <= 2 * found["radius"]
