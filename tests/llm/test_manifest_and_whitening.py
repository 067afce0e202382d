import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from colweave.llm import merkle, whitening
from colweave.llm.queries import op11_merkle, op13_whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, place int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text) to the multiset of results, tree by tree in plain Python."""
    trees = {}
    for doc_id, source, lang, n_chars, text in rows:
        struck = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        found = n_chars + 1 if struck and n_chars is not None else n_chars
        leaf, held = (H(*(field(v) for v in (doc_id, source, lang, n, text))) for n in (n_chars, found))
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, held, doc_id))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            yield ("".join(nodes[i & ~1:i]), "".join(nodes[i + 1:(i & ~1) + 2]))
            i >>= 1

    ordered = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: levels([leaf for _, _, leaf, _, _ in sorted(trees[lang], key=lambda r: r[:3])]) for lang in ordered}
    top = levels([built[lang][-1][0] for lang in ordered])
    out = []
    for j, lang in enumerate(ordered):
        for i, (_, _, leaf, held, doc_id) in enumerate(sorted(trees[lang], key=lambda r: r[:3])):
            steps = [*path(built[lang], i), *path(top, j)]
            node = held
            for before, after in steps:
                node = H(before, node, after)
            out.append((doc_id, leaf, built[lang][-1][0], top[-1][0], H(*(x for step in steps for x in step)), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest(spark, rows, height):
    df = spark.createDataFrame([(d, t, lang, s, n, "clash", "clash", 1) for d, s, lang, n, t in rows], DOCS)
    got = merkle.manifest(merkle.document_leaves(df), height)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(got["proof"]),
                                                "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_against_brute_force(spark, height):
    rows = [(i, f"s{i % 3}", ["en", "de", "é", "Z", ""][min(4, i % 7)], i * 3, f"text {i}") for i in range(77)]
    rows += [(None, "s", None, 5, "no id"), (None, None, None, None, None), (1 << 60, "s", None, 7, "ünï\ncode"), (8, "s", "one", None, ""),
             (9, "s", "two", 1, "a"), (9, "s", "two", 1, "a"), (9, "s", "two", 1, "b"), (10, "s", "en", 4, "x " * 200_000)]
    assert manifest(spark, rows, height) == brute_manifest(rows)


def test_manifest_of_one_tree_of_one_leaf_and_of_none(spark):
    single = [(3, "s", "en", 1, "a")]
    got = manifest(spark, single, 10)
    assert got == brute_manifest(single)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == H("")
    assert manifest(spark, [], 10) == []


def test_many_languages_reduce_in_superblocks_too(spark):
    rows = [(i, "s", f"l{i % 41}", 1, "t") for i in range(120)]
    assert manifest(spark, rows, 1) == brute_manifest(rows)


def test_tampering_is_seen_and_nothing_else(spark):
    got = op11_merkle(spark, SF).collect()
    assert len(got) == 200
    for r in got:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


def test_levels_and_paths():
    nodes = [H(str(i)) for i in range(5)]
    levels = merkle.reduce_levels(nodes, merkle.levels_of(5))
    assert [len(x) for x in levels] == [5, 3, 2, 1]
    assert all(merkle.fold(node, merkle.local_path(levels, i)) == levels[-1][0] for i, node in enumerate(nodes))
    assert [step[0] for step in merkle.local_path(levels, 4)] == ["=", "=", "<"]
    assert [merkle.levels_of(n) for n in (0, 1, 2, 3, 4, 5, 1024, 1025)] == [0, 0, 1, 2, 2, 3, 10, 11]


# ---- whitening ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n long, component int, label int"


def whole(vectors):
    return [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 5)) * [3, 1, 0.5, 0.1, 2] + [0, 9, -4, 0, 1]
    rows = [(i, [float(c) for c in v], 7, 7, 7) for i, v in enumerate(base)]
    rows += [(5, rows[5][1], 7, 7, 7), (None, rows[6][1], 7, 7, 7)]
    bad = [(900, None, 1, 1, 1), (901, [1.0, None, 1.0, 1.0, 1.0], 1, 1, 1), (902, [1.0, float("nan"), 1.0, 1.0, 1.0], 1, 1, 1),
           (903, [1.0, float("-inf"), 1.0, 1.0, 1.0], 1, 1, 1)]
    got = whitening.whiten(spark.createDataFrame(rows + bad, VECTORS)).collect()
    x = whole([r[1] for r in rows])
    n, sums = len(x), [sum(col) for col in zip(*x)]
    y = [[n * a - s for a, s in zip(r, sums)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n ** 3)) for j in range(5)] for i in range(5)])
    values, axes = np.linalg.eigh(v)
    assert len(got) == 5 * n
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["explained"] == pytest.approx(values[::-1][r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    for k in range(1, 6):
        want = sorted(((rows[i][0], sum(a * a for a in y[i]), float(np.array(y[i], float) / n @ axes[:, -k] / np.sqrt(values[-k])))
                       for i in range(n)), key=str)
        have = sorted(((r["vec_id"], int(r["deviation"]), r["whitened"]) for r in by[k]), key=str)
        assert [h[:2] for h in have] == [w[:2] for w in want]
        a, b = np.array([h[2] for h in have]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_square_sums_are_exact_for_any_size():
    rng = np.random.default_rng(1)
    for top in (3, 1 << 20, 1 << 40, 1 << 61):
        z = rng.integers(-top, top, size=(1024, 3))
        z[0] = -top
        assert whitening.square_sums(z) == [sum(int(v) ** 2 for v in col) for col in z.T]
    big = np.array([[1 << 70, -5]], dtype=object)
    assert whitening.square_sums(big) == [1 << 140, 25]
    assert whitening.square_sums(np.zeros((0, 2), dtype=np.int64)) == [0, 0]


def test_whitening_of_edges(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], VECTORS)).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, []), (2, [])]) == []
    # Equal vectors: nothing varies.
    got = run([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(0, None, None, None)] * 4
    # Two vectors: one direction; shorter vectors are padded with zeros.
    got = run([(1, [1.0, 0.0, 0.0]), (2, []), (3, [1.0])])
    assert {r["component"] for r in got} == {1, 2, 3}
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert got[0]["identity_error"] < 1e-9
    # Huge entries stay exact or are held at the bound; sums pass 64 bits.
    got = run([(1, [3e15, 1.0]), (2, [-3e15, 2.0]), (3, [3e38, 1.0])])
    assert len(got) == 6 and all(r["deviation"] is not None for r in got)
    held = [min(1 << 62, int(1024 * float(np.float32(c)))) + 100_000 for c in (3e15, -3e15, 3e38)]
    assert {int(r["deviation"]) for r in got if r["vec_id"] == 1} == {
        (3 * held[0] - sum(held)) ** 2 + (3 * 101024 - (2 * 101024 + 102048)) ** 2}


def test_whitening_query(spark):
    got = op13_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    first = got.first()
    assert first["identity_error"] <= 1e-4 and got.count() == 8 * first["n"]


def test_deviation_past_38_digits(spark):
    rows = [(1, [3e15]), (2, [-3e15]), (3, [3e38])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], VECTORS)).collect()
    held = [min(1 << 62, int(1024 * float(np.float32(v[0])))) + 100_000 for _, v in rows]
    want = {i: (3 * x - sum(held)) ** 2 for (i, _), x in zip(rows, held)}
    assert want[2] > 10 ** 38 and {r["vec_id"]: r["deviation"] for r in got} == want
